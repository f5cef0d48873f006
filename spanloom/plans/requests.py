"""Registered queries of requests: contexts, budgets, conflicts, logs, targets, call graphs, anchors, sessions and sinks.

The driver's tables become small files, symbols and logs, one for each row or key, so each operator runs over whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import paths as P
from ..operators import anchors, backups, board, callgraph, dedupe, diffs, edits, fit, govern, lineage, logs, patching, retrieve
from . import context
from .catalog import _SPANS, _TOKENS, _points, _query, _spans, _t

# --- the context of a request: symbols in files of 60 lines, one for each brand


def _tree(spark, d) -> tuple[DataFrame, DataFrame]:
    part = _t(spark, d, "part")
    file = F.concat(F.lit("src/"), F.replace("p_brand", F.lit("#"), F.lit("_")), F.when(F.col("p_brand").endswith("1"), ".rs").otherwise(".py"))
    found = part.select(file.alias("file"), F.col("p_name").alias("name"), F.concat_ws("::", "p_type", "p_partkey").alias("qualified_name"), F.col("p_size").cast("long").alias("start_line"), (F.col("p_size") + F.col("p_partkey") % 4).cast("long").alias("end_line"))
    body = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("line "), i.cast("string"), F.lit(" of "), F.col("file"))), "\n")
    return found, found.select("file").distinct().withColumn("content", body)


_ASKED = ["red", "bolt", "small::9"]
_CONTEXT = f"""WITH RECURSIVE n AS (SELECT 'src/' || replace(p_brand, '#', '_') || CASE WHEN ends_with(p_brand, '1') THEN '.rs' ELSE '.py' END AS file, p_name AS name, p_type || '::' || p_partkey AS qn, CAST(p_size AS BIGINT) AS s, CAST(p_size + p_partkey % 4 AS BIGINT) AS e FROM part),
q(query) AS (VALUES {", ".join(f"('{t}')" for t in _ASKED)}), w AS (SELECT query, regexp_extract_all(query, '[a-z0-9]+') AS w FROM q),
c AS (SELECT query, n.*, CASE WHEN lower(name) = query THEN 3 WHEN starts_with(lower(name), query) THEN 2 WHEN list_contains(regexp_split_to_array(lower(name), '[^A-Za-z0-9]'), query) THEN 1 ELSE 0 END AS score FROM n, w
 WHERE contains(lower(name), query) OR contains(lower(qn), query) OR len(list_filter(w, lambda t: NOT contains(lower(name), t))) = 0 OR len(list_filter(w, lambda t: NOT contains(lower(qn), t))) = 0),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, file, s, qn) AS r FROM c) WHERE r <= 40),
b AS (SELECT file, s, e, max(e) OVER (PARTITION BY file ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM k),
g AS (SELECT file, s, e, sum(CASE WHEN m IS NULL OR s > m THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM b),
p AS (SELECT file, min(s) AS s, max(e) AS e FROM g GROUP BY file, g),
t AS (SELECT file || ':' || s || '-' || e AS id, '// File: ' || file || ' (lines ' || s || '-' || e || ')' || chr(10) || array_to_string(list_transform(range(s, least(e, 60) + 1), lambda i: 'line ' || i || ' of ' || file), chr(10)) || chr(10) || chr(10) AS content FROM p),
i AS (SELECT id, content, CAST({_TOKENS.format(t="content")} AS BIGINT) AS tokens, row_number() OVER (ORDER BY id) AS rn FROM t),
f AS (SELECT id, content, tokens, rn, tokens <= 700 AS ok, CASE WHEN tokens <= 700 THEN 700 - tokens ELSE 700 END AS remain FROM i WHERE rn = 1
 UNION ALL SELECT i.id, i.content, i.tokens, i.rn, i.tokens <= f.remain, CASE WHEN i.tokens <= f.remain THEN f.remain - i.tokens ELSE f.remain END FROM f JOIN i ON i.rn = f.rn + 1)"""


@_query(_CONTEXT + " SELECT CAST(row_number() OVER (ORDER BY rn) AS INT) AS pos, id, tokens, content FROM f WHERE ok")
def flagship(spark, d):
    found, files = _tree(spark, d)
    asked = spark.createDataFrame([(t,) for t in _ASKED], "query string")
    return context.context(found, files, asked, budget=700, top=40, vocab=None, piece_tokens=0)


@_query(_CONTEXT + " SELECT CAST(sum(tokens) AS BIGINT) AS total_tokens, count(*) AS n_items, 'B' AS tier FROM f WHERE ok")
def context_json(spark, d):
    one = context.as_json(flagship(spark, d), "model", 700, "B")
    shape = "model string, budget int, total_tokens bigint, tier string, items array<struct<id: string, tokens: bigint, content: string>>, ok boolean"
    return one.select(F.from_json("json", shape).alias("j")).select("j.total_tokens", F.size("j.items").cast("long").alias("n_items"), "j.tier")


# --- budgets


def _turns(spark, d):
    c = _t(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("bucket"), F.col("turn").alias("id"), F.col("text").alias("content"), X.token_count(F.col("text")).alias("tokens"), F.when(F.col("role") == "user", 200).otherwise(100).alias("level"), F.lit(1.0).alias("relevance"), (F.col("turn") % 5 == 3).alias("hard"), (F.col("turn") % 3 * 6).cast("long").alias("min_tokens"))


@_query(f"""WITH RECURSIVE i AS (SELECT conv_id AS bucket, turn AS id, CAST({_TOKENS.format(t="text")} AS BIGINT) AS t, CASE WHEN role = 'user' THEN 200 ELSE 100 END AS level, turn % 5 = 3 AS firm, CAST(turn % 3 * 6 AS BIGINT) AS m FROM conversations),
h AS (SELECT *, greatest(m, 1) AS need, row_number() OVER (PARTITION BY bucket ORDER BY level DESC, id) AS rn FROM i WHERE firm),
r AS (SELECT bucket, CAST(0 AS BIGINT) AS rn, CAST(80 AS BIGINT) AS remain, NULL::BIGINT AS id, CAST(0 AS BIGINT) AS got, CAST(0 AS BIGINT) AS t, false AS missing FROM (SELECT DISTINCT bucket FROM i)
 UNION ALL SELECT h.bucket, h.rn, CASE WHEN h.need <= r.remain THEN r.remain - least(h.t, h.need) ELSE r.remain END, h.id, CASE WHEN h.need <= r.remain THEN least(h.t, h.need) ELSE -1 END, h.t, r.missing OR h.need > r.remain FROM r JOIN h ON h.bucket = r.bucket AND h.rn = r.rn + 1),
e AS (SELECT bucket, min(remain) AS remain, bool_or(missing) AS missing FROM r GROUP BY bucket),
o AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY level DESC, id) AS rn FROM i WHERE NOT firm),
f AS (SELECT bucket, CAST(0 AS BIGINT) AS rn, remain, NULL::BIGINT AS id, CAST(-1 AS BIGINT) AS got, missing FROM e
 UNION ALL SELECT o.bucket, o.rn, f.remain - CASE WHEN f.missing THEN 0 WHEN o.t <= f.remain THEN o.t WHEN o.m > 0 AND o.m <= f.remain THEN o.m ELSE 0 END, o.id, CASE WHEN f.missing THEN -1 WHEN o.t <= f.remain THEN o.t WHEN o.m > 0 AND o.m <= f.remain THEN o.m ELSE -1 END, f.missing FROM f JOIN o ON o.bucket = f.bucket AND o.rn = f.rn + 1),
l AS (SELECT bucket, min(remain) AS remain FROM f GROUP BY bucket),
x AS (SELECT r.bucket, r.id, r.rn, r.got, r.t, greatest(least(r.t - r.got, l.remain - coalesce(sum(r.t - r.got) OVER (PARTITION BY r.bucket ORDER BY r.rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 0) AS more FROM r JOIN l USING (bucket) WHERE r.rn > 0 AND r.got >= 0),
a AS (SELECT bucket, id, CAST(got + more AS BIGINT) AS tokens, 0 AS turn, rn FROM x UNION ALL SELECT bucket, id, got, 1, rn FROM f WHERE rn > 0 AND got >= 0)
SELECT bucket, id, tokens, row_number() OVER (PARTITION BY bucket ORDER BY turn, rn) AS pos FROM a""")
def budget_fit_hard(spark, d):
    return fit.budget_fit(_turns(spark, d), 80)


_TAGGED = f"t AS (SELECT CAST(doc_id AS VARCHAR) AS id, CASE lang WHEN 'de' THEN 'tests' WHEN 'fr' THEN 'interfaces' ELSE 'code' END AS bucket, CAST({_TOKENS.format(t='text')} AS BIGINT) AS tokens, CAST(n_chars % 3 AS INT) AS level FROM documents)"
_CAPS = "CASE bucket WHEN 'code' THEN 900 WHEN 'interfaces' THEN 500 ELSE 300 END"


def _tagged(spark, d):
    doc = _t(spark, d, "documents")
    tags = F.when(F.col("lang") == "de", F.array(F.lit("interface"), F.lit("test"))).when(F.col("lang") == "fr", F.array(F.lit("interface"))).otherwise(F.array(F.lit("code")))
    return doc.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"), X.token_count(F.col("text")).alias("tokens"), (F.col("n_chars") % 3).cast("int").alias("level"), F.lit(1.0).alias("relevance"), tags.alias("tags"))


_BUCKETS = f"""WITH RECURSIVE {_TAGGED}, i AS (SELECT *, {_CAPS} AS cap, row_number() OVER (PARTITION BY bucket ORDER BY level DESC, id) AS rn FROM t),
f AS (SELECT bucket, id, tokens, rn, tokens <= cap AS ok, CASE WHEN tokens <= cap THEN cap - tokens ELSE cap END AS remain FROM i WHERE rn = 1
 UNION ALL SELECT i.bucket, i.id, i.tokens, i.rn, i.tokens <= f.remain, CASE WHEN i.tokens <= f.remain THEN f.remain - i.tokens ELSE f.remain END FROM f JOIN i ON i.bucket = f.bucket AND i.rn = f.rn + 1)"""


@_query(_BUCKETS + " SELECT bucket, id, tokens, row_number() OVER (PARTITION BY bucket ORDER BY rn) AS pos FROM f WHERE ok")
def bucketed_fit(spark, d):
    return fit.bucketed_fit(_tagged(spark, d), fit.parse_caps("code=900, interfaces=500,tests=300"))[0]


@_query(_BUCKETS + " SELECT id, bucket, 'bucket-cap-exceeded' AS reason FROM f WHERE NOT ok")
def bucketed_refusals(spark, d):
    return fit.bucketed_fit(_tagged(spark, d), fit.parse_caps("code=900,interfaces=500,tests=300"))[1]


@_query(f"WITH {_TAGGED}, s AS (SELECT *, sum(tokens) OVER (PARTITION BY bucket ORDER BY tokens DESC, id DESC ROWS UNBOUNDED PRECEDING) AS s FROM t) SELECT bucket, id, tokens FROM s WHERE s <= 5000")
def tail_trimmed(spark, d):
    placed = _tagged(spark, d).select("id", "tokens", F.when(F.array_contains("tags", "test"), "tests").when(F.array_contains("tags", "interface"), "interfaces").otherwise("code").alias("bucket"))
    return fit.trim_tail(placed, 5000).select("bucket", "id", "tokens")


@_query(f"WITH {_TAGGED}, s AS (SELECT *, sum(tokens) OVER (ORDER BY id DESC ROWS UNBOUNDED PRECEDING) AS s FROM t) SELECT id, 'mixed' AS bucket, 'budget-overflow' AS reason FROM s WHERE s > 4200")
def overflow_refusals(spark, d):
    return fit.overflow(_tagged(spark, d), 4000)[1]


@_query(None)
def distinct_items(spark, d):
    return dedupe.distinct(_turns(spark, d).withColumn("proximity", F.lit(0.0))).withColumnsRenamed({"bucket": "conv_id", "id": "turn"})


@_query("SELECT event_id, bit_count(xor(event_id * 7919, user_id * 104729)) <= 12 AS near, CAST(1000 * user_id + 100 * hour(ts) + 10 * minute(ts) AS DOUBLE) AS composite FROM events")
def vote_distance(spark, d):
    e = _t(spark, d, "events")
    return e.select("event_id", dedupe.votes_close(F.col("event_id") * 7919, F.col("user_id") * 104729, 12).alias("near"), dedupe.composite(F.col("user_id"), F.hour("ts"), F.minute("ts")).alias("composite"))


@_query("SELECT doc_id, regexp_matches(lower(text), 'trait |interface |pub fn |pub struct |pub enum ') AS interface FROM documents")
def interface_contents(spark, d):
    return _t(spark, d, "documents").select("doc_id", dedupe.is_interface(F.col("text")).alias("interface"))


# --- conflicts: one for each customer, of a few shapes by its key


def _conflicted(spark, d):
    c, k = _t(spark, d, "customer"), F.col("c_custkey") % 5
    theirs = F.when(k == 0, F.concat(F.lit("  "), "c_name", F.lit("\n"))).when(k == 1, F.lit("")).when(k == 2, F.concat("c_name", F.lit("\nmore\n"))).when(k == 3, F.concat("c_mktsegment", F.lit("\n"))).otherwise(F.lit("open (\n"))
    base = F.when(k == 3, F.concat(F.lit("||||||| base\n"), "c_name", F.lit("\n"))).otherwise("")
    text = F.concat(F.lit("top\n<<<<<<< ours\n"), "c_name", F.lit("\n"), base, F.lit("=======\n"), theirs, F.lit(">>>>>>> theirs\nend\n"))
    return c.select(F.col("c_custkey").cast("string").alias("file"), text.alias("content"))


_CONFLICTS = """WITH c AS (SELECT c_custkey, c_custkey % 5 AS k, c_name || chr(10) AS ours, CASE c_custkey % 5 WHEN 0 THEN '  ' || c_name || chr(10) WHEN 1 THEN '' WHEN 2 THEN c_name || chr(10) || 'more' || chr(10) WHEN 3 THEN c_mktsegment || chr(10) ELSE 'open (' || chr(10) END AS theirs FROM customer),
s AS (SELECT *, 5 + 4 + length(' ours') + 5 AS head, CAST(CASE k WHEN 0 THEN 0.40 + 0.25 + 0.10 WHEN 1 THEN 0.25 + 0.10 WHEN 2 THEN 0.25 + 0.20 * 0.5 + 0.10 WHEN 3 THEN 0.10 + 0.05 ELSE 0.0 END AS DOUBLE) AS score FROM c)"""


@_query(_CONFLICTS + " SELECT CAST(c_custkey AS VARCHAR) AS file, CAST(2 AS BIGINT) AS start_line, CAST(5 + CASE WHEN k = 3 THEN 2 ELSE 0 END + CASE k WHEN 1 THEN 0 WHEN 2 THEN 2 ELSE 1 END AS BIGINT) AS end_line, 'ours' AS ours_meta, 'theirs' AS theirs_meta, ours, theirs, CASE WHEN k = 3 THEN ours END AS base, round(score, 5) AS confidence FROM s")
def conflict_scores(spark, d):
    out = govern.conflict_scores(govern.conflict_blocks(_conflicted(spark, d)))
    return out.select("file", "start_line", "end_line", "ours_meta", "theirs_meta", "ours", "theirs", "base", F.round(F.col("confidence").cast("double"), 5).alias("confidence"))


@_query(_CONFLICTS + " SELECT CAST(c_custkey AS VARCHAR) AS file, CASE k WHEN 0 THEN 'whitespace-only' WHEN 1 THEN 'addition-only-theirs-empty' WHEN 2 THEN 'superset-theirs-contains-ours' WHEN 3 THEN 'disjoint-insertions' END AS reason, CASE k WHEN 0 THEN ours WHEN 1 THEN ours WHEN 2 THEN theirs WHEN 3 THEN ours || theirs END AS resolved FROM s")
def conflicts_resolved(spark, d):
    return _resolved(spark, d).select("file", "reason", "resolved")


def _resolved(spark, d):
    return govern.resolve(govern.conflict_scores(govern.conflict_blocks(_conflicted(spark, d))), "smart", 0.12)


@_query(_CONFLICTS + " SELECT CAST(c_custkey AS VARCHAR) AS file, 'top' || chr(10) || CASE k WHEN 0 THEN ours WHEN 1 THEN ours WHEN 2 THEN theirs ELSE ours || theirs END || 'end' || chr(10) AS content FROM s WHERE k < 4")
def conflicts_spliced(spark, d):
    return govern.splice(_conflicted(spark, d), _resolved(spark, d)).select("file", F.col("content").cast("string").alias("content"))


@_query(_CONFLICTS + " SELECT CAST(c_custkey AS VARCHAR) AS file, CAST(1 AS BIGINT) AS conflicts, CAST(CASE WHEN k < 4 THEN 1 ELSE 0 END AS BIGINT) AS auto_resolved, CAST(CASE WHEN k < 4 THEN 0 ELSE 1 END AS BIGINT) AS interactive_required FROM s")
def conflict_counts(spark, d):
    return govern.conflict_summary(_resolved(spark, d))


# --- logs


@_query("""WITH x AS (SELECT user_id AS log, event_id AS seq, event_type, 'app/' || event_type || '.py' AS file, CAST(hour(ts) AS BIGINT) AS line FROM events)
SELECT log, seq * 4 AS seq, file, line, ['f_' || event_type] AS symbols, CASE WHEN event_type = 'error' THEN 'AssertionError' ELSE 'call ' || event_type END AS message, 'error' AS severity FROM x""")
def pytest_sites(spark, d):
    e = _t(spark, d, "events")
    rows = F.array(F.format_string('  File "app/%s.py", line %d, in f_%s x', "event_type", F.hour("ts"), "event_type"), F.format_string("    call %s", "event_type"), F.when(F.col("event_type") == "error", "AssertionError").otherwise("done"), F.lit(""))
    lines = e.select(F.col("user_id").alias("log"), "event_id", F.posexplode(rows).alias("i", "line")).select("log", (F.col("event_id") * 4 + F.col("i")).alias("line_no"), "line")
    return logs.signals(lines, "pytest")


@_query("SELECT user_id AS log, event_id AS seq, '/app/' || event_type || '.js' AS file, CAST(hour(ts) AS BIGINT) AS line, 'Jest test failure' AS message, 'error' AS severity FROM events WHERE event_type <> 'click'")
def jest_sites(spark, d):
    line = F.when(F.col("event_type") == "click", "not at all").otherwise(F.format_string("    at run (/app/%s.js:%d:7)", "event_type", F.hour("ts")))
    lines = _t(spark, d, "events").select(F.col("user_id").alias("log"), F.col("event_id").alias("line_no"), line.alias("line"))
    return logs.signals(lines, "jest").drop("symbols")


@_query("""WITH x AS (SELECT user_id AS log, event_id AS seq, '/app/' || event_type || '.js' AS file, CAST(hour(ts) AS BIGINT) AS line FROM events)
SELECT log, file, line, CASE WHEN count(*) > 1 THEN ['run'] ELSE ['run'] END AS symbols, 'Jest test failure' AS message, 'error' AS severity FROM x GROUP BY ALL""")
def merged_sites(spark, d):
    lines = _t(spark, d, "events").select(F.col("user_id").alias("log"), F.col("event_id").alias("line_no"), F.format_string("    at run (/app/%s.js:%d:7) at run x", "event_type", F.hour("ts")).alias("line"))
    found = logs.signals(lines.withColumn("line", F.regexp_replace("line", " at run x$", "")), "jest")
    return logs.merged(found.withColumn("symbols", F.array(F.lit("run"))))


# --- scores, targets, texts


@_query("""SELECT p_partkey, CAST(least(100 + CASE WHEN p_size % 2 = 0 THEN 30 ELSE 0 END + CASE p_type WHEN 'SMALL' THEN 20 WHEN 'LARGE' THEN 25 WHEN 'PROMO' THEN 15 ELSE 0 END + CASE WHEN p_brand = 'Brand#1' THEN 50 ELSE 0 END, 255) - CASE WHEN contains(p_brand, '5') THEN 30 ELSE 0 END AS INT) AS level,
CAST(CASE WHEN p_name = 'red rod' THEN 1.0 WHEN starts_with(p_name, 'red rod') THEN 0.9 WHEN contains(p_name, 'red rod') THEN 0.7 END AS DOUBLE) AS relevance, round(CASE WHEN p_brand = 'Brand#1' THEN greatest(1.0 - least(abs(p_size - 10) / 1000.0, 0.6), 0.4) ELSE 0.7 END, 5) AS nearness FROM part""")
def symbol_ranks(spark, d):
    part = _t(spark, d, "part")
    kind = F.when(F.col("p_type") == "SMALL", "function").when(F.col("p_type") == "LARGE", "class").when(F.col("p_type") == "PROMO", "module").otherwise("constant")
    file = F.regexp_replace("p_brand", "5", "test5")
    level = X.symbol_level(kind, F.when(F.col("p_size") % 2 == 0, "public"), file, "Brand#1")
    relevance = X.symbol_relevance(F.col("p_name"), F.col("p_name"), F.lit("red rod")).cast("double")
    return part.select("p_partkey", level.cast("int").alias("level"), F.when(F.col("p_name").contains("red rod"), F.round(relevance, 5)).alias("relevance"), F.round(X.symbol_nearness(F.col("p_brand"), F.col("p_size"), "Brand#1", 10).cast("double"), 5).alias("nearness"))


@_query("""SELECT p_partkey, least(a, b) AS first_start, greatest(a, b) AS first_end, CAST(p_size AS BIGINT) AS second_start, CAST(p_size + greatest(p_partkey % 7 - 1, 0) AS BIGINT) AS second_end, p_size % 3 = 0 AS hard FROM (SELECT *, CAST(p_size AS BIGINT) AS a, CAST(p_partkey % 50 + 1 AS BIGINT) AS b FROM part)""")
def target_spans(spark, d):
    spec = F.format_string("src/a:b.rs: %s%d-%d, %d+%d", F.when(F.col("p_size") % 3 == 0, "!").otherwise(""), "p_size", F.col("p_partkey") % 50 + 1, "p_size", F.col("p_partkey") % 7)
    t = _t(spark, d, "part").select("p_partkey", X.target_spans(spec).alias("t"))
    return t.select("p_partkey", *[F.col("t")[i][c].alias(f"{n}_{c}") for i, n in ((0, "first"), (1, "second")) for c in ("start", "end")], F.col("t")[0]["hard"].alias("hard"))


@_query("""WITH s AS (SELECT p_partkey, CAST(p_size AS BIGINT) AS s FROM part)
SELECT p_partkey, CASE WHEN s <= 21 AND s + 2 >= 19 THEN least(s, 20) || '-' || greatest(s + 2, 20) WHEN s < 20 THEN s || '-' || (s + 2) || ',20-20' ELSE '20-20,' || s || '-' || (s + 2) END AS ranges FROM s""")
def strict_targets(spark, d):
    spec = F.format_string("a.rs:20,%d-%d", "p_size", F.col("p_size") + 2)
    return _t(spark, d, "part").select("p_partkey", F.array_join(F.transform(P.strict_ranges(spec), lambda r: F.concat_ws("-", r["start"], r["end"])), ",").alias("ranges"))


@_query("""WITH x AS (SELECT p_partkey, p_type AS w, CAST(p_partkey % 4 AS INT) AS k FROM part)
SELECT p_partkey, w || chr(10) || '  ' || w || chr(10) || chr(10) || w AS dedented, repeat(' ', k) || w || chr(10) || repeat(' ', k) || '  ' || w || chr(10) || chr(10) || repeat(' ', k) || w AS squeezed FROM x""")
def indents(spark, d):
    part = _t(spark, d, "part").select("p_partkey", F.col("p_type").alias("w"), F.repeat(F.lit(" "), (F.col("p_partkey") % 4).cast("int")).alias("p"))
    text = lambda blank: F.concat("p", "w", F.lit("\n"), "p", F.lit("  "), "w", F.lit(blank), "p", "w")
    return part.select("p_partkey", X.dedented(text("\n\n")).alias("dedented"), X.squeezed_blank_lines(text("\n\n  \n\n")).alias("squeezed"))


@_query("SELECT p_partkey, '```' || CASE WHEN p_size % 2 = 0 THEN 'py' ELSE 'rs' END || chr(10) || CASE WHEN p_size % 2 = 0 THEN '# ' ELSE '// ' END || 'src/a.' || CASE WHEN p_size % 2 = 0 THEN 'py' ELSE 'rs' END || ':' || p_size || '-' || (p_size + 1) || chr(10) || p_name || chr(10) || '```' AS fenced, '>>> src/a.' || CASE WHEN p_size % 2 = 0 THEN 'py' ELSE 'rs' END || ':' || p_size || '-' || (p_size + 1) || chr(10) || p_name AS plain FROM part")
def snippets(spark, d):
    path = F.when(F.col("p_size") % 2 == 0, "src/a.py").otherwise("src/a.rs")
    args = (path, F.col("p_size"), F.col("p_size") + 1, F.col("p_name"))
    return _t(spark, d, "part").select("p_partkey", X.snippet(*args, True, True).alias("fenced"), X.snippet(*args, False, True).alias("plain"))


_BITS = " | ".join(f"(CASE WHEN 2 * sum((h >> {b}) & 1) >= count(*) THEN 1::BIGINT << {b} ELSE 0 END)" for b in range(0, 40))


@_query(f"WITH x AS (SELECT user_id, event_id * 1299709 + user_id AS h FROM events) SELECT user_id, {_BITS} AS votes FROM x GROUP BY user_id")
def voted_bits(spark, d):
    e = _t(spark, d, "events").groupBy("user_id").agg(F.collect_list(F.col("event_id") * 1299709 + F.col("user_id")).alias("h"))
    return e.select("user_id", X.voted_bits(F.col("h")).bitwiseAND(F.lit((1 << 40) - 1)).alias("votes"))


@_query("""WITH RECURSIVE x AS (SELECT conv_id, list(turn * 7919 % 101 ORDER BY turn) AS h FROM conversations GROUP BY conv_id HAVING count(*) >= 3),
f AS (SELECT conv_id, h, 0 AS i, CASE WHEN h[3] <= h[1] THEN 3 ELSE 1 END AS p FROM x
 UNION ALL SELECT conv_id, h, i + 1, CASE WHEN p < i + 2 THEN CASE WHEN h[i + 4] = list_min(h[i + 2:i + 4]) THEN i + 4 WHEN h[i + 3] = list_min(h[i + 2:i + 4]) THEN i + 3 ELSE i + 2 END WHEN h[i + 4] <= h[p] THEN i + 4 ELSE p END FROM f WHERE i + 4 <= len(h))
SELECT conv_id, list(h[p] ORDER BY i) AS prints FROM f GROUP BY conv_id""")
def winnowed(spark, d):
    rows = F.transform(F.array_sort(F.collect_list(F.struct("turn"))), lambda x: x["turn"] * 7919 % 101)
    c = _t(spark, d, "conversations").groupBy("conv_id").agg(rows.alias("h")).where(F.size("h") >= 3)
    return c.select("conv_id", X.winnowed(F.col("h"), 3).alias("prints"))


# --- paths and bytes


@_query("""WITH u AS (SELECT page_id, split_part(split_part(split_part(url, '://', 2), '?', 1), '#', 1) AS path FROM pages)
SELECT page_id, path AS file, CAST(page_id % 90 AS BIGINT) AS "start", CAST(page_id % 90 + 5 AS BIGINT) AS "end", '/r/' || path AS resolved, path AS relative, false AS same FROM u""")
def item_places(spark, d):
    path = F.split_part(F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    u = _t(spark, d, "pages").select("page_id", path.alias("path")).withColumn("at", P.item_place(F.format_string("%s:%d-%d", "path", F.col("page_id") % 90, F.col("page_id") % 90 + 5)))
    full = P.resolved(F.col("path"), "/r/")
    return u.select("page_id", F.col("at.file").alias("file"), F.col("at.start").alias("start"), F.col("at.end").alias("end"), full.alias("resolved"), P.relative(full, "/r").alias("relative"), P.same_file(F.col("path"), F.concat(F.col("path"), F.lit("x")), "/r").alias("same"))


@_query("SELECT page_id, CASE WHEN page_id % 4 = 0 THEN NULL WHEN page_id % 4 = 1 THEN NULL WHEN page_id % 4 = 2 THEN 'a/' || page_id ELSE 'b' END AS path FROM pages")
def inner_paths(spark, d):
    k = F.col("page_id") % 4
    path = F.when(k == 0, F.concat(F.lit("/a/"), F.col("page_id"))).when(k == 1, F.concat(F.lit("a/../"), F.col("page_id"))).when(k == 2, F.concat(F.lit("./a//"), F.col("page_id"))).otherwise("b/.")
    return _t(spark, d, "pages").select("page_id", P.repo_relative(path).alias("path"))


@_query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN [] ELSE ['trait ' || p_type, 'impl ' || p_type || ' for', p_type || '::' || p_name] END AS queries FROM part")
def trait_queries(spark, d):
    text = F.when(F.col("p_size") % 3 == 0, F.concat("p_type", F.lit(":: "))).otherwise(F.concat(F.lit(" "), "p_type", F.lit(" :: "), "p_name"))
    return _t(spark, d, "part").select("p_partkey", P.trait_queries(text).alias("queries"))


@_query("""SELECT p_partkey, CAST(4 AS BIGINT) AS lines, CAST(strlen(p_name) + 1 AS BIGINT) AS "start", CAST(strlen(p_name) + 1 + strlen(p_type) AS BIGINT) AS "end", CAST(2 AS BIGINT) AS line, CAST(3 AS BIGINT) AS line_of_break FROM part""")
def line_bytes(spark, d):
    t = F.concat("p_name", F.lit("\n"), "p_type", F.lit("\r\n"), "p_brand", F.lit("\n"))
    at = _t(spark, d, "part").select("p_partkey", t.alias("t"), P.open_line_count(t).alias("lines"), P.line_bytes(t, F.lit(2), F.lit(2)).alias("b"))
    t = F.col("t")
    return at.select("p_partkey", "lines", F.col("b.start").alias("start"), F.col("b.end").alias("end"), P.line_of_byte(t, F.col("b.start")).alias("line"), P.line_of_byte(t, F.col("b.end") + 1).alias("line_of_break"))


# --- calls and anchors: one file for each supplier, with functions of six lines


def _sources(spark, d):
    body = F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: F.concat(F.lit("pub fn f_"), i.cast("string"), F.lit("(x: u8) {\n    g_"), ((i * 7 + F.col("s_nationkey")) % 30).cast("string"), F.lit("(x);\n    if (x) {\n    }\n}\n\n")))
    return _t(spark, d, "supplier").select(F.format_string("src/s%d.rs", "s_suppkey").alias("file"), F.array_join(body, "").alias("content"))


_FILES = "f AS (SELECT s_suppkey, 'src/s' || s_suppkey || '.rs' AS file, s_nationkey AS n, CAST(s_suppkey * 11 % 180 + 1 AS BIGINT) AS line FROM supplier), i AS (SELECT unnest(range(30)) AS i)"


def _marks(spark, d):
    return _t(spark, d, "supplier").select(F.col("s_suppkey").alias("point_id"), F.format_string("src/s%d.rs", "s_suppkey").alias("file"), (F.col("s_suppkey") * 11 % 180 + 1).cast("long").alias("line"))


@_query(f"WITH {_FILES} SELECT s_suppkey AS point_id, 'f_' || ((line - 1) // 6) AS owner FROM f")
def call_owners(spark, d):
    return callgraph.owners(callgraph.number_lines(_sources(spark, d)), _marks(spark, d))


@_query(f"""WITH {_FILES}, c AS (SELECT s_suppkey, 'f_' || i AS name, line, i * 6 + 1 AS pl FROM f, i UNION ALL SELECT s_suppkey, 'g_' || ((i * 7 + n) % 30), line, i * 6 + 2 FROM f, i),
a AS (SELECT s_suppkey AS point_id, 'f_' || ((line - 1) // 6) AS name, 0 AS hop FROM f UNION ALL SELECT s_suppkey, name, 1 FROM c WHERE abs(pl - line) <= 20)
SELECT point_id, name, CAST(min(hop) AS INT) AS hop FROM a GROUP BY ALL""")
def call_hops(spark, d):
    lines, marks = callgraph.number_lines(_sources(spark, d)), _marks(spark, d)
    own = callgraph.owners(lines, marks).select("point_id", F.col("owner").alias("name"), F.lit(0).alias("hop"))
    return own.unionByName(callgraph.calls_near(lines, marks, 20).withColumn("hop", F.lit(1))).groupBy("point_id", "name").agg(F.min("hop").alias("hop"))


@_query(f"""WITH {_FILES}, c AS (SELECT 'f_' || i AS name, i * 6 + 1 AS pl FROM f, i WHERE s_suppkey = 3 UNION SELECT 'g_' || ((i * 7 + n) % 30), i * 6 + 2 FROM f, i WHERE s_suppkey = 3) SELECT DISTINCT name FROM c WHERE abs(pl - 100) <= 120 ORDER BY name LIMIT 50""")
def call_names(spark, d):
    return callgraph.call_names(callgraph.number_lines(_sources(spark, d)), callgraph.parse_spec("depth=2 edges=1 anchor=src/s3.rs:100"))


@_query(f"""WITH {_FILES}, c AS (SELECT 'f_' || i AS name, i * 6 + 1 AS pl FROM i UNION SELECT 'g_' || ((i * 7 + n) % 30), i * 6 + 2 FROM f, i WHERE s_suppkey = 3), h AS (SELECT 'f_16' AS name, 0 AS hop UNION ALL SELECT name, 1 FROM c WHERE abs(pl - 100) <= 128), m AS (SELECT name, min(hop) AS hop FROM h GROUP BY name),
o AS (SELECT file || ':' || line AS id, 'f_' || ((line - 1) // 6) AS owner FROM f)
SELECT id, CAST(floor(least(100::FLOAT * (1::FLOAT + coalesce(CAST(1 / (1 + hop) AS FLOAT) * 0.12::FLOAT, 0::FLOAT)), 255::FLOAT)) AS INT) AS level FROM o LEFT JOIN m ON name = owner""")
def call_levels(spark, d):
    items = _marks(spark, d).select(F.concat_ws(":", "file", "line").alias("id"), "file", F.col("line").alias("start"), F.lit(100).alias("level"))
    return callgraph.raised_by_calls(items, callgraph.number_lines(_sources(spark, d)), "src/s3.rs", 100).select("id", "level")


@_query(f"WITH {_FILES} SELECT file, 'f_' || i AS name, 'src::s' || s_suppkey || '::f_' || i AS qualified_name, CAST(i * 6 + 1 AS BIGINT) AS \"start\", CAST(i * 6 + 5 AS BIGINT) AS \"end\", 'function' AS kind FROM f, i")
def file_functions(spark, d):
    return anchors.functions(_sources(spark, d)).drop("confidence")


@_query(f"""WITH {_FILES}, t AS (SELECT max(s_suppkey) AS top FROM f), p AS (SELECT s_suppkey, line, (line - 1) // 6 AS i, (line - 1) % 6 AS o, s_suppkey + 3 > top AS gone FROM f, t)
SELECT s_suppkey AS point_id, CASE WHEN gone THEN 'NotAFile' WHEN o < 5 THEN 'Good' ELSE 'OutsideScope' END AS status, CASE WHEN gone THEN NULL WHEN o < 5 THEN 'f_' || i END AS name, CASE WHEN gone THEN NULL WHEN o < 5 AND o > 0 THEN CAST(o AS BIGINT) END AS "offset", CASE WHEN gone OR o < 5 THEN NULL ELSE 'f_' || i END AS nearest FROM p""")
def anchor_why(spark, d):
    sources = _sources(spark, d)
    marks = _marks(spark, d).withColumn("file", F.format_string("src/s%d.rs", F.col("point_id") + 3))  # the last ones name no file
    found = anchors.why(anchors.hints(marks, anchors.functions(sources), sources))
    shape = "status string, offset bigint, function struct<name: string>, nearest_functions array<struct<name: string>>"
    return found.select("point_id", F.from_json("json", shape).alias("j")).select("point_id", "j.status", F.col("j.function.name").alias("name"), "j.offset", F.get("j.nearest_functions", F.lit(0))["name"].alias("nearest"))


# --- edits, differences, patches


@_query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'new' ELSE p_name END || chr(13) || chr(10) || p_type || chr(13) || chr(10) AS content, CASE WHEN p_size % 2 = 0 THEN 0 ELSE 1 END AS n_problems FROM part""")
def edits_replaced(spark, d):
    part = _t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("file"), F.concat("p_name", F.lit("\r\n"), "p_type", F.lit("\r\n")).alias("content"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("another line").alias("old"))
    spec = F.concat(F.lit("FILE: "), "file", F.lit("\nREPLACE lines 1:\nOLD:\n```\n"), "old", F.lit("\n```\nNEW:\n```\nnew\n```\n"))
    ops = edits.parse_specs(part.select(F.col("file").alias("spec"), spec.alias("text")))
    out = edits.apply_edits(part.select("file", "content"), ops.where("error is null")).join(part.select("file", F.col("content").alias("was")), "file")
    return out.select(F.col("file").cast("long").alias("p_partkey"), F.coalesce("content", "was").alias("content"), F.size("problems").alias("n_problems"))


@_query("""SELECT p_partkey, '--- a/f' || p_partkey || chr(10) || '+++ b/f' || p_partkey || chr(10) || '@@ -' || greatest(p_size - 2, 1) || ',' || (least(p_size + 4, 60) - greatest(p_size - 2, 1) + 1) || ' +' || greatest(p_size - 2, 1) || ',' || (least(p_size + 4, 60) - greatest(p_size - 2, 1) + 1) || ' @@' || chr(10)
 || coalesce(array_to_string(list_transform(range(greatest(p_size - 2, 1), p_size + 1), lambda i: ' l' || i || chr(10)), ''), '') || '+' || p_name || chr(10) || '-l' || (p_size + 1) || chr(10) || coalesce(array_to_string(list_transform(range(p_size + 2, least(p_size + 4, 60) + 1), lambda i: ' l' || i || chr(10)), ''), '') AS patch FROM part""")
def unified_diffs(spark, d):
    line = lambda f: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), f), "\n")
    old = line(lambda i: F.concat(F.lit("l"), i.cast("string")))
    new = line(lambda i: F.when(i == F.col("p_size") + 1, F.col("p_name")).otherwise(F.concat(F.lit("l"), i.cast("string"))))
    pairs = _t(spark, d, "part").select("p_partkey", F.format_string("f%d", "p_partkey").alias("file"), F.concat(old, F.lit("\n")).alias("old"), F.concat(new, F.lit("\n")).alias("new"))
    return diffs.diff(pairs).select(F.substring("file", 2, 20).cast("long").alias("p_partkey"), "patch")


_OUTPUT = """WITH o AS (SELECT user_id AS log, event_id AS line_no, event_type, 'src/e' || event_id || '.rs' AS path FROM events),
c AS (SELECT log, line_no, CASE event_type WHEN 'click' THEN 'preimage_mismatch' WHEN 'view' THEN 'index_required' WHEN 'purchase' THEN 'outside_repo' WHEN 'error' THEN 'other' END AS kind, path FROM o WHERE event_type IN ('click', 'view', 'purchase', 'error'))"""


def _output(spark, d):
    p = F.concat(F.lit("src/e"), F.col("event_id").cast("string"), F.lit(".rs"))
    t = F.col("event_type")
    line = F.when(t == "click", F.concat(F.lit("error: "), p, F.lit(": patch does not apply"))).when(t == "view", F.concat(F.lit("error: "), p, F.lit(": does not match index"))).when(t == "purchase", F.concat(p, F.lit(" is outside repository"))).when(t == "error", F.lit("fatal: lost")).otherwise(F.concat(F.lit("patching file "), p))
    return _t(spark, d, "events").select(F.col("user_id").alias("log"), F.col("event_id").alias("line_no"), line.alias("line"))


@_query(_OUTPUT + " SELECT log, line_no, kind, CASE WHEN kind <> 'other' THEN path END AS path, CASE WHEN kind = 'other' THEN 'unknown:0:0 fatal; lost' ELSE path || ':0:0 ' || kind END AS summary FROM c")
def patch_conflicts(spark, d):
    found = patching.conflicts(_output(spark, d))
    return found.select("log", "line_no", "kind", "path", patching.summary_line(F.col("kind"), F.col("path"), F.col("message")).alias("summary"))


@_query("SELECT user_id AS log, event_id AS line_no, 'src/e' || event_id || '.rs' AS path FROM events WHERE event_type NOT IN ('click', 'view', 'purchase', 'error')")
def patched_files(spark, d):
    return patching.applied_files(_output(spark, d))


@_query("SELECT event_id, CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 4 WHEN 'purchase' THEN 3 ELSE 5 END AS code FROM events")
def exit_codes(spark, d):
    t = F.col("event_type")
    said = F.when(t == "click", "a conflict in git").when(t == "view", "no repo").when(t == "purchase", "bad syntax").otherwise("lost")
    return _t(spark, d, "events").select("event_id", patching.exit_code(said).alias("code"))


# --- sessions, boards, sinks


@_query("SELECT o_custkey AS id, CAST(sum(CASE WHEN o_orderstatus <> 'P' THEN o_orderkey ELSE 0 END) AS BIGINT) AS payload_bytes, CAST(sum(o_orderkey) AS BIGINT) AS bytes FROM orders GROUP BY 1")
def session_sizes(spark, d):
    name = F.when(F.col("o_orderstatus") == "P", F.when(F.col("o_orderkey") % 2 == 0, "DONE").otherwise("manifest.json")).otherwise("a.rs")
    return backups.session_sizes(_t(spark, d, "orders").select(F.col("o_custkey").alias("id"), name.alias("name"), F.col("o_orderkey").alias("size")))


@_query("WITH r AS (SELECT o_orderkey AS id, o_orderdate AS ts, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS nth FROM orders WHERE o_orderstatus <> 'P') SELECT id FROM r WHERE nth > 500 OR ts < TIMESTAMP '1993-01-01'")
def sessions_doomed(spark, d):
    rows = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"), (F.col("o_orderstatus") != "P").alias("done"))
    return backups.doomed(rows, 500, "1993-01-01").select("id")


@_query("""WITH i AS (SELECT l_returnflag AS name, l_orderkey * 10 + l_linenumber AS pos, 'f' || (l_partkey % 40) || '.rs:1-' || l_linenumber AS id, 'f' || (l_partkey % 40) || '.rs' AS path, CAST(l_quantity AS BIGINT) AS tokens FROM lineitem), b AS (SELECT name, CAST(sum(100 + CAST(replace(replace(path, 'f', ''), '.rs', '') AS BIGINT)) AS BIGINT) AS base FROM (SELECT DISTINCT name, path FROM i) GROUP BY name)
SELECT name, count(*) AS items_count, CAST(sum(tokens) AS BIGINT) AS actual_tokens, any_value(base) AS baseline_tokens, round(any_value(base) / sum(tokens), 9) AS cef, round(1 - count(DISTINCT id) / count(*), 9) AS dcr FROM i JOIN b USING (name) GROUP BY name""")
def board_scores(spark, d):
    li = _t(spark, d, "lineitem")
    path = F.format_string("f%d.rs", F.col("l_partkey") % 40)
    items = li.select(F.col("l_returnflag").alias("name"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.concat(path, F.lit(":1-"), F.col("l_linenumber").cast("string")).alias("id"), F.col("l_quantity").cast("long").alias("tokens"))
    whole = spark.range(40).select(F.format_string("f%d.rs", "id").alias("path"), (F.col("id") + 100).alias("tokens"))
    return board.scores(items, whole).withColumns({"cef": F.round("cef", 9), "dcr": F.round("dcr", 9)})


@_query("SELECT p_brand AS file, p_name AS name, p_type || '::' || p_partkey AS qualified_name, CAST(p_size AS BIGINT) AS start_line FROM part")
def symbols_stored(spark, d):
    from ..sources import files

    part = _t(spark, d, "part")
    empty = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in files.SYMBOLS.split(", ")}
    own = {"file": F.col("p_brand"), "name": F.col("p_name"), "qualified_name": F.concat_ws("::", "p_type", "p_partkey"), "start_line": F.col("p_size").cast("long")}
    path = lineage.folder(spark, "symbols")
    files.write_symbols(part.select(*[own.get(c, e).alias(c) for c, e in empty.items()]), path)
    return files.read_symbols(spark, path).select("file", "name", "qualified_name", "start_line")


@_query("SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS BIGINT) AS files, o_orderstatus = 'F' AS success, o_orderpriority AS engine FROM orders")
def sessions_stored(spark, d):
    from ..sources import files

    o = _t(spark, d, "orders")
    path = lineage.folder(spark, "sessions")
    files.append_sessions(o.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderdate").cast("string").alias("timestamp"), (F.col("o_orderstatus") == "F").alias("success"), F.col("o_custkey").alias("files"), F.col("o_orderpriority").alias("engine")), path)
    return files.read_sessions(spark, path).select("id", "files", "success", "engine")


@_query(f"""WITH t AS (SELECT doc_id, CAST({_TOKENS.format(t="text")} AS BIGINT) AS n FROM documents) SELECT doc_id AS chunk_id, 'chunk_' || lpad(CAST(doc_id AS VARCHAR), CAST(greatest(length(CAST(doc_id AS VARCHAR)), 3) AS INT), '0') || '.txt' AS file, n AS token_count FROM t""")
def chunk_manifest(spark, d):
    doc = _t(spark, d, "documents")
    none = F.lit(None).cast("string")
    rows = doc.select(F.col("doc_id").alias("chunk_id"), none.alias("symbol_path"), none.alias("source_file"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), X.token_count(F.col("text")).alias("token_count"), F.col("text").alias("content"))
    path = lineage.folder(spark, "chunks")
    return context.write_manifest(rows, path)


@_query(f"WITH x AS ({_SPANS}), f AS (SELECT p_partkey, p_name FROM part) SELECT k AS p_partkey, id, substr(p_name, CAST(s % 5 + 1 AS INT), CAST(e % 4 + 1 AS INT)) AS body FROM x JOIN f ON p_partkey = k")
def byte_slices(spark, d):
    spans = _spans(spark, d).select(F.col("key").alias("file"), "id", (F.col("start") % 5).alias("byte_start"), (F.col("start") % 5 + F.col("end") % 4 + 1).alias("byte_end"))
    files = _t(spark, d, "part").select(F.col("p_partkey").alias("file"), F.col("p_name").alias("content"))
    return retrieve.sliced(spans, files).select(F.col("file").alias("p_partkey"), "id", "body")


@_query("SELECT p_partkey AS point_id, CASE WHEN p_size % 2 = 0 THEN 'rust' ELSE 'python' END AS lang FROM part WHERE (p_size % 2 = 0 OR p_size % 3 = 0) AND (p_size % 5 = 0 OR p_size % 7 <> 0)")
def language_filter(spark, d):
    part = _points(spark, d)
    named = part.select("point_id", F.when(F.col("line") % 2 == 0, "rust").when(F.col("line") % 3 == 0, "python").otherwise("go").alias("lang"), F.when(F.col("line") % 5 == 0, F.lit(None).cast("string")).when(F.col("line") % 7 != 0, "public").otherwise("private").alias("visibility"))
    return retrieve.selected(named, ["Rust", "python", "go"], False).select("point_id", "lang")


@_query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'crlf' ELSE 'lf' END AS ends FROM part")
def line_ends(spark, d):
    k = F.col("p_size") % 3
    text = F.when(k == 0, F.concat("p_name", F.lit("\r\n"), "p_type", F.lit("\r\n"))).when(k == 1, F.concat("p_name", F.lit("\r\n"), "p_type", F.lit("\n"))).otherwise(F.col("p_name"))
    return _t(spark, d, "part").select("p_partkey", F.when(X.line_end(text) == "\r\n", "crlf").otherwise("lf").alias("ends"))


@_query("SELECT o_custkey AS id, count(*) AS files, array_to_string(list(o_orderkey ORDER BY o_orderkey)[1:3], ',') AS sample FROM orders GROUP BY 1")
def session_samples(spark, d):
    from ..sources import files

    paths = F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("original_path"))))
    m = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(paths.alias("files"))
    return files.sample_paths(m).withColumn("sample", F.array_join(F.transform("sample", lambda x: x.cast("string")), ","))


@_query("""WITH p AS (SELECT p_partkey, 'src/' || p_type || '/' || p_name AS file, p_size FROM part) SELECT p_partkey, CAST(row_number() OVER (ORDER BY file = 'src/PROMO/red rod' DESC, starts_with(file, 'src/PROMO/') AND file <> 'src/PROMO/red rod' DESC, file, p_size, p_partkey) AS INT) AS nth FROM p""")
def piece_order(spark, d):
    p = _t(spark, d, "part").select("p_partkey", F.concat_ws("/", F.lit("src"), "p_type", "p_name").alias("file"), F.struct("p_size", "p_partkey").alias("start"))
    return context.in_reading_order(p, "src/PROMO/red rod").select("p_partkey", "nth")
