"""Registered queries over the driver's tables, each with its SQL for DuckDB.

The tables stand in for the engine's relations: parts are symbols, line items are spans and edits, events are log signals
and sessions, pages are files. Each query runs an operator over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import edits, fit, govern, logs, retrieve, symbols

_Q: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
TERMS = ["ring", "red widget", "small", "bolt blue", "gear", "economy::1", "promo 7"]
HISTORY = [f"{kind}::7" for kind in ("ECONOMY", "SMALL", "MEDIUM", "PROMO", "STANDARD", "LARGE")]


def _query(sql: str | None):
    def add(f):
        _Q[f.__name__] = f, sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import requests  # noqa: F401  registers the others

    return {k: f for k, (f, _) in _Q.items()}


def oracle_sql() -> dict[str, str]:
    queries()
    return {k: sql for k, (_, sql) in _Q.items() if sql}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def context_fit(spark: SparkSession, d: str) -> DataFrame:
    """Documents ranked for a query's words, exact copies dropped, fitted to a budget for each language."""
    docs = _t(spark, d, "documents")
    words = F.array(*[F.lit(w) for w in ("the", "der", "de", "que")])
    scored = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("bucket"), X.token_count(F.col("text")).alias("tokens"), F.size(F.array_intersect(F.array_distinct(X.words(F.col("text"))), words)).alias("level"), F.lit(1.0).alias("relevance"), F.sha2("text", 256).alias("h"))
    first = scored.groupBy("h").agg(F.min("id").alias("id"))
    return fit.budget_fit(scored.join(first, ["h", "id"]).drop("h"), 3000)


_LINES = "CASE WHEN {t} = '' THEN 0 ELSE length({t}) - length(replace({t}, chr(10), '')) + CASE WHEN ends_with({t}, chr(10)) THEN 0 ELSE 1 END END"
_TOKENS = r"len(regexp_extract_all({t}, '[A-Za-z0-9_]+|[^ \t\n\r\f\x0bA-Za-z0-9_]'))"
_ASCII = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _ASCII + ", '[a-z0-9]+')"


@_query("SELECT doc_id, CAST(" + _LINES.format(t="text") + " AS BIGINT) AS n_lines FROM documents")
def line_counts(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.line_count(F.col("text")).alias("n_lines"))


@_query(r"""SELECT page_id, ext, CASE ext WHEN 'html' THEN NULL WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' END AS lang FROM
(SELECT page_id, lower(regexp_extract(split_part(split_part(url, '#', 1), '?', 1), '\.([^./]+)$', 1)) AS ext FROM pages)""")
def ext_lang_map(spark, d):
    path = F.split_part(F.split_part("url", F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1))
    return _t(spark, d, "pages").select("page_id", X.extension(path).alias("ext"), X.language_of(path).alias("lang"))


@_query("SELECT doc_id, CAST(" + _TOKENS.format(t="text") + " AS BIGINT) AS tokens FROM documents")
def token_counts(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.token_count(F.col("text")).alias("tokens"))


def _symbols(spark, d):
    return _t(spark, d, "part").select(F.col("p_name").alias("name"), F.concat(F.lit("src/"), "p_brand").alias("file"), F.col("p_size").alias("start_line"), F.concat_ws("::", "p_type", "p_partkey").alias("qualified_name"))


def _values(terms):
    return ", ".join(f"('{t}')" for t in terms)


_LOOKUP = f"""WITH q(query) AS (VALUES {_values(TERMS)}),
n AS (SELECT p_name AS name, 'src/' || p_brand AS file, p_size AS start_line, p_type || '::' || p_partkey AS qualified_name FROM part), w AS (SELECT query, regexp_extract_all(lower(query), '[a-z0-9]+') AS w FROM q),
c AS (SELECT query, n.* FROM n, w WHERE starts_with(file, 'src/') OR contains(lower(name), lower(query)) OR contains(lower(qualified_name), lower(query)) OR len(list_filter(w, lambda t: NOT contains(lower(name), t))) = 0 OR len(list_filter(w, lambda t: NOT contains(lower(qualified_name), t))) = 0),
s AS (SELECT *, CASE WHEN lower(name) = query THEN 3 WHEN length(query) >= 2 AND starts_with(lower(name), query) THEN 2 WHEN list_contains(regexp_split_to_array(lower(name), '[^A-Za-z0-9]'), query) THEN 1 ELSE 0 END AS semantic,
 CASE WHEN starts_with(file, 'src/Brand#1') THEN 1 ELSE 0 END AS scope,
 CASE WHEN file <> 'src/Brand#11' THEN 0 WHEN abs(start_line - 10) <= 20 THEN 2 WHEN abs(start_line - 10) <= 100 THEN 1 ELSE 3 END AS proximity, CASE WHEN list_contains({HISTORY}, qualified_name) THEN 1 ELSE 0 END AS history FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY semantic DESC, scope DESC, proximity DESC, history DESC, file, start_line, qualified_name) AS rank FROM s)"""


@_query(_LOOKUP + " SELECT query, name, file, qualified_name, semantic, scope, proximity, history, CAST(rank AS INT) AS rank FROM r WHERE rank <= 8")
def symbol_lookup_topk(spark, d):
    q = spark.createDataFrame([(t,) for t in TERMS], "query string")
    out = retrieve.lookup(_symbols(spark, d), q, 8, "src/Brand#11", 10, "src/Brand#1", HISTORY)
    return out.select("query", "name", "file", "qualified_name", "semantic", "scope", "proximity", "history", "rank")


_SPANS = "SELECT l_partkey AS k, l_orderkey * 10 + l_linenumber AS id, day(l_shipdate) AS s, day(l_shipdate) + CAST(l_quantity AS INT) AS e FROM lineitem"


def _spans(spark, d):
    li = _t(spark, d, "lineitem")
    return li.select(F.col("l_partkey").alias("key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.dayofmonth("l_shipdate").alias("start"), (F.dayofmonth("l_shipdate") + F.col("l_quantity").cast("int")).alias("end"))


@_query(f"""WITH x AS ({_SPANS}), b AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM x),
i AS (SELECT *, sum(CASE WHEN m IS NULL OR s > m + 3 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e, id ROWS UNBOUNDED PRECEDING) AS g FROM b)
SELECT k AS "key", min(s) AS "start", max(e) AS "end", count(*) AS n FROM i GROUP BY k, g""")
def coalesce_ranges(spark, d):
    return retrieve.coalesce_ranges(_spans(spark, d), ["key"], 2)


@_query(f'SELECT k AS "key", id, greatest(s - 5, 1) AS "start", e + 5 AS "end" FROM ({_SPANS})')
def expand_context(spark, d):
    return retrieve.expand(_spans(spark, d), 5)


@_query("SELECT doc_id, array_to_string(list_slice(string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\\n$', ''), chr(10)), 2, 3), chr(10)) AS body FROM documents")
def line_slice(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.line_slice(F.col("text"), 2, 3).alias("body"))


@_query(r"""WITH l AS (SELECT doc_id, generate_subscripts(a, 1) AS i, unnest(a) AS x FROM (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS a FROM documents)),
n AS (SELECT doc_id, i, trim(regexp_replace(regexp_replace(x, '//.*$', ''), '\s+', ' ', 'g')) AS x FROM l),
t AS (SELECT d.doc_id, coalesce(string_agg(x, ' ' ORDER BY i) FILTER (x <> ''), '') AS norm FROM documents d LEFT JOIN n USING (doc_id) GROUP BY d.doc_id)
SELECT min(doc_id) AS first_id, count(*) AS copies FROM t GROUP BY norm""")
def exact_dups(spark, d):
    return fit.exact_classes(_t(spark, d, "documents")).select("first_id", "copies")


@_query(r"""WITH l AS (SELECT doc_id, generate_subscripts(a, 1) AS i, unnest(a) AS x FROM (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS a FROM documents)),
n AS (SELECT doc_id, i, trim(regexp_replace(regexp_replace(x, '//.*$', ''), '\s+', ' ', 'g')) AS x FROM l),
t AS (SELECT d.doc_id, coalesce(string_agg(x, ' ' ORDER BY i) FILTER (x <> ''), '') AS norm FROM documents d LEFT JOIN n USING (doc_id) GROUP BY d.doc_id)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS first_id, count(*) OVER (PARTITION BY norm) AS copies FROM t""")
def exact_dup_members(spark, d):
    return fit.exact_groups(_t(spark, d, "documents"))


def _grams_sql(table: str, key: str, n: int) -> str:
    """Distinct (key, g): runs of n words of each text."""
    run = " || ' ' || ".join(["x", *[f"lead(x, {i}) OVER v" for i in range(1, n)]])
    return f"(SELECT DISTINCT {key}, g FROM (SELECT {key}, {run} AS g FROM (SELECT {key}, generate_subscripts(a, 1) AS i, unnest(a) AS x FROM (SELECT {key}, {_WORDS.format(t='text')} AS a FROM {table})) WINDOW v AS (PARTITION BY {key} ORDER BY i)) WHERE g IS NOT NULL)"


@_query(f"""WITH s AS (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS h, count(*) AS n FROM {_grams_sql('documents', 'doc_id', 4)} GROUP BY doc_id),
f AS (SELECT min(doc_id) AS doc_id, any_value(n) AS n FROM s GROUP BY h), e AS MATERIALIZED (SELECT x.doc_id, n, g FROM {_grams_sql('documents', 'doc_id', 4)} x JOIN f USING (doc_id)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2)
SELECT a, b, round(c / (na + nb - c), 9) AS jaccard FROM p WHERE c / (na + nb - c) >= 0.7""")
def jaccard_pairs(spark, d):
    return fit.jaccard_pairs(_t(spark, d, "documents")).withColumn("jaccard", F.round("jaccard", 9))


@_query(f"""WITH s AS (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS h FROM {_grams_sql('documents', 'doc_id', 4)} GROUP BY doc_id),
o AS (SELECT doc_id, coalesce(h, 'own ' || doc_id) AS h, coalesce(text, '') AS text FROM documents LEFT JOIN s USING (doc_id)), c AS (SELECT h, min(doc_id) AS representative, count(DISTINCT text) AS texts FROM o GROUP BY h)
SELECT doc_id, representative, texts FROM o JOIN c USING (h)""")
def jaccard_members(spark, d):
    return fit.jaccard_members(_t(spark, d, "documents"))


@_query(f"SELECT doc_id, item_id, count(*) AS shared FROM {_grams_sql('documents', 'doc_id', 8)} x JOIN {_grams_sql('benchmark', 'item_id', 8)} b USING (g) GROUP BY 1, 2")
def shared_shingles(spark, d):
    grams = lambda t, c: _t(spark, d, t).select(c, F.explode(X.shingles(X.words(F.col("text")), 8)).alias("g"))
    return grams("documents", "doc_id").join(grams("benchmark", "item_id"), "g").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))


_TERMS_SQL = r"list_filter(regexp_extract_all(" + _ASCII.format(t="text") + r", '[\p{L}\p{N}_]+'), lambda t: strlen(t) >= 2 AND NOT list_contains(" + str(fit.STOPWORDS) + ", t))"


@_query(f"SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct({_TERMS_SQL})) AS term FROM documents) GROUP BY term")
def doc_freq(spark, d):
    return fit.doc_freq(_t(spark, d, "documents"))


_NOVELTY = f"""WITH e AS (SELECT doc_id, unnest({_TERMS_SQL}) AS term FROM documents), f AS (SELECT term, count(DISTINCT doc_id) AS df FROM e GROUP BY term),
s AS (SELECT min(df) AS least, (SELECT count(*) FROM documents) AS n FROM f),
r AS (SELECT doc_id, df, row_number() OVER (PARTITION BY doc_id ORDER BY df, term) AS r FROM e JOIN f USING (term)),
m AS (SELECT doc_id, avg(CASE WHEN n > least THEN ln(n / df) / ln(n / least) ELSE 0 END) AS v FROM r, s WHERE r <= 16 GROUP BY doc_id),
v AS (SELECT d.doc_id, coalesce(v, 0.0) AS novelty FROM documents d LEFT JOIN m USING (doc_id))"""


@_query(_NOVELTY + " SELECT doc_id, round(novelty, 6) AS novelty FROM v")
def novelty_scores(spark, d):
    return fit.novelty(_t(spark, d, "documents")).withColumn("novelty", F.round("novelty", 6))


@_query(_NOVELTY + " SELECT doc_id, 'novelty-floor<0.50' AS reason FROM v WHERE round(novelty, 6) < 0.5")
def novelty_refusals(spark, d):
    return fit.novelty(_t(spark, d, "documents")).where(F.round("novelty", 6) < 0.5).select("doc_id", F.format_string("novelty-floor<%.2f", F.lit(0.5)).alias("reason"))


def _items(spark, d):
    c = _t(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("bucket"), F.col("turn").alias("id"), X.token_count(F.col("text")).alias("tokens"), F.when(F.col("role") == "user", 200).otherwise(100).alias("level"), F.lit(1.0).alias("relevance"))


_FIT = f"""WITH RECURSIVE i AS (SELECT conv_id AS bucket, turn AS id, CAST({_TOKENS.format(t="text")} AS BIGINT) AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN role = 'user' THEN 200 ELSE 100 END DESC, turn) AS rn FROM conversations),
f AS (SELECT bucket, id, tokens, rn, tokens <= 120 AS ok, CASE WHEN tokens <= 120 THEN 120 - tokens ELSE 120 END AS remain FROM i WHERE rn = 1
 UNION ALL SELECT i.bucket, i.id, i.tokens, i.rn, i.tokens <= f.remain, CASE WHEN i.tokens <= f.remain THEN f.remain - i.tokens ELSE f.remain END FROM f JOIN i ON i.bucket = f.bucket AND i.rn = f.rn + 1)"""


@_query(_FIT + " SELECT bucket, id, tokens, row_number() OVER (PARTITION BY bucket ORDER BY rn) AS pos FROM f WHERE ok")
def budget_fit(spark, d):
    return fit.budget_fit(_items(spark, d), 120)


@_query(_FIT + " SELECT bucket, id, CASE WHEN tokens > 60 THEN 'bucket-cap-exceeded' ELSE 'budget-overflow' END AS reason FROM f WHERE NOT ok")
def budget_refusals(spark, d):
    items = _items(spark, d)
    return fit.refusals(items, fit.budget_fit(items, 120), 60)


def _signals(spark, d):
    e = _t(spark, d, "events")
    severity = F.when(F.col("value") > 90, "error").when(F.col("value") > 50, "warn").otherwise("info")
    return e.select(F.col("user_id").alias("file"), F.hour("ts").alias("line"), F.col("event_id").alias("seq"), F.col("event_type").alias("symbol"), severity.alias("severity"), F.when(F.col("value") > 20, F.col("props")).otherwise("").alias("message"))


_SIGNALS = "x AS (SELECT user_id AS file, hour(ts) AS line, event_id AS seq, event_type AS symbol, CASE WHEN value > 90 THEN 2 WHEN value > 50 THEN 1 ELSE 0 END AS sev, CASE WHEN value > 20 THEN props ELSE '' END AS message FROM events)"


@_query(f"WITH {_SIGNALS} SELECT file, CAST(line AS INT) AS line, count(*) AS n, array_to_string(list_sort(list(DISTINCT symbol)), ',') AS symbols, ['info', 'warn', 'error'][max(sev) + 1] AS severity, coalesce(arg_min(message, seq) FILTER (message <> ''), '') AS message FROM x GROUP BY file, line")
def signal_merge(spark, d):
    return retrieve.merge_signals(_signals(spark, d)).withColumn("symbols", F.concat_ws(",", "symbols"))


@_query("""WITH o AS (SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS b,
 first_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM events)
SELECT event_id, coalesce(b, a) AS owner FROM o""")
def asof_owner(spark, d):
    e = _t(spark, d, "events")
    return retrieve.owner_asof(e, "user_id", ["ts", "event_id"], F.col("event_type") == "purchase", F.col("event_id")).select("event_id", "owner")


@_query("""WITH x AS (SELECT event_id, user_id, hour(ts) AS line, event_id AS n, event_type = 'purchase' AS own FROM events),
o AS (SELECT *, last_value(CASE WHEN own THEN struct_pack(o := event_id, a := line) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY line, n ROWS UNBOUNDED PRECEDING) AS b,
 first_value(CASE WHEN own THEN struct_pack(o := event_id, a := line) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY line, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM x)
SELECT event_id, coalesce(CASE WHEN line - b.a <= 2 THEN b.o END, CASE WHEN a.a - line <= 2 THEN a.o END) AS owner FROM o""")
def asof_owner_within(spark, d):
    e = _t(spark, d, "events").select("event_id", "user_id", F.hour("ts").alias("line"), "event_type")
    return retrieve.owner_asof(e, "user_id", ["line", "event_id"], F.col("event_type") == "purchase", F.col("event_id"), 2).select("event_id", "owner")


_BOOST = """WITH i AS (SELECT event_id AS id, user_id AS file, hour(ts) AS s, hour(ts) + 1 AS e FROM events), x AS (SELECT user_id AS file, hour(ts) AS line, CASE WHEN value > 90 THEN 3.0::FLOAT WHEN value > 50 THEN 1.5::FLOAT ELSE 1.0::FLOAT END AS w FROM events),
b AS (SELECT id, CAST(sum(CAST(least(w / CAST(1 + greatest(s - line, line - e, 0) AS FLOAT), 2.0::FLOAT) AS DOUBLE)) AS FLOAT) AS boost FROM i JOIN x USING (file) GROUP BY id)
SELECT id, CAST(boost AS DOUBLE) AS boost FROM b"""
_RAISED = _BOOST.rsplit("SELECT id,", 1)[0] + """, m AS (SELECT id, boost, least(1.0::FLOAT + 0.15::FLOAT * boost, 1.5::FLOAT) AS m, least(0.05::FLOAT * boost, 0.5::FLOAT) AS a FROM b)
SELECT id, CAST(boost AS DOUBLE) AS boost, CAST(floor(least(100::FLOAT * m + a * 255.0::FLOAT, 255.0::FLOAT)) AS INT) AS level, round(CAST(least(0.7::FLOAT * m + a * 0.1::FLOAT, 1.0::FLOAT) AS DOUBLE), 5) AS relevance, round(CAST(least(0.5::FLOAT * m + a * 0.1::FLOAT, 1.0::FLOAT) AS DOUBLE), 5) AS proximity FROM m"""


@_query(_RAISED)
def signal_boost(spark, d):
    e = _t(spark, d, "events")
    f = lambda x: F.lit(x).cast("float")
    items = e.select(F.col("event_id").cast("string").alias("id"), F.col("user_id").alias("file"), F.hour("ts").alias("start"), (F.hour("ts") + 1).alias("end"), F.lit(100).alias("level"), f(0.7).alias("relevance"), f(0.5).alias("proximity"))
    out = retrieve.signal_boost(items, _signals(spark, d))
    return out.select(F.col("id").cast("long").alias("id"), F.col("boost").cast("double").alias("boost"), "level", *[F.round(F.col(c).cast("double"), 5).alias(c) for c in ("relevance", "proximity")])


@_query("""WITH e AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem UNION SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey FROM lineitem),
h1 AS (SELECT DISTINCT dst AS node FROM e WHERE src = 'p1'), h2 AS (SELECT DISTINCT dst AS node FROM e JOIN h1 ON src = node),
a AS (SELECT 'p1' AS node, 0 AS hop UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2) SELECT node, CAST(min(hop) AS INT) AS hop FROM a GROUP BY node""")
def hops(spark, d):
    li = _t(spark, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))
    return retrieve.hops(li.unionByName(li.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), spark.createDataFrame([("p1",)], "node string"), 2)


def _points(spark, d):
    return _t(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_partkey").alias("point_id"), F.col("p_size").alias("line"))


@_query(f"""WITH x AS ({_SPANS}), p AS (SELECT p_partkey AS k, p_size AS line FROM part), b AS (SELECT k, max(struct_pack(s := s, e := e, id := id)) AS b FROM p JOIN x USING (k) WHERE s <= line AND line <= e GROUP BY k)
SELECT p.k AS point_id, b.b.id AS name, b.b.s AS "start", b.b.e AS "end" FROM p LEFT JOIN b USING (k)""")
def enclosing_span(spark, d):
    return retrieve.enclosing_span(_points(spark, d), _spans(spark, d).withColumnRenamed("id", "name"), "key")


@_query(f"""WITH x AS ({_SPANS}), j AS (SELECT p_partkey AS point_id, id AS name, greatest(s - p_size, p_size - e, 0) AS distance, s FROM part JOIN x ON k = p_partkey),
r AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY distance, s, name) AS rank FROM j) SELECT point_id, name, distance, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3""")
def nearest_k(spark, d):
    return retrieve.nearest_spans(_points(spark, d), _spans(spark, d).withColumnRenamed("id", "name"), "key").select("point_id", "name", "distance", "rank")


@_query(f"""WITH t AS (SELECT doc_id, CAST({_TOKENS.format(t="text")} AS BIGINT) AS n FROM documents), k AS (SELECT *, CASE WHEN n <= 128 THEN least(n, 1) ELSE CAST(ceil((n - 128) / 96) AS BIGINT) + 1 END AS k FROM t)
SELECT doc_id, c AS chunk, c * 96 AS "start", least(c * 96 + 128, n) AS "end" FROM (SELECT doc_id, n, unnest(range(k)) AS c FROM k)""")
def token_chunks(spark, d):
    return fit.token_chunks(_t(spark, d, "documents"))


@_query(f"""WITH RECURSIVE i AS (SELECT conv_id, turn, CAST({_TOKENS.format(t="text")} AS BIGINT) AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
f AS (SELECT conv_id, turn, tokens, rn, tokens AS s, CAST(0 AS BIGINT) AS pack FROM i WHERE rn = 1
 UNION ALL SELECT i.conv_id, i.turn, i.tokens, i.rn, CASE WHEN f.s + i.tokens > 100 AND f.s > 0 THEN i.tokens ELSE f.s + i.tokens END, f.pack + CASE WHEN f.s + i.tokens > 100 AND f.s > 0 THEN 1 ELSE 0 END FROM f JOIN i ON i.conv_id = f.conv_id AND i.rn = f.rn + 1)
SELECT conv_id, turn, tokens, pack FROM f""")
def greedy_pack(spark, d):
    c = _t(spark, d, "conversations").select("conv_id", "turn", X.token_count(F.col("text")).alias("tokens"))
    return fit.greedy_pack(c, 100, "conv_id", "turn")


def _index(spark, d):
    o = _t(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), F.col("o_orderdate").alias("ts"), (F.col("o_orderstatus") != "P").alias("done"), (F.col("o_orderstatus") == "F").alias("success"), F.col("o_orderpriority").alias("engine"))


@_query("SELECT o_orderkey AS id, o_custkey AS owner FROM orders WHERE o_orderstatus = 'F' AND lower(o_orderpriority) = '1-urgent' AND o_orderdate >= TIMESTAMP '1996-01-01'")
def session_list(spark, d):
    return govern.sessions(_index(spark, d), "1-URGENT", True, F.to_timestamp(F.lit("1996-01-01"))).select("id", "owner")


@_query("WITH r AS (SELECT o_orderkey AS id, o_custkey AS owner, o_orderdate AS ts, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS nth FROM orders) SELECT id, owner, CAST(nth AS INT) AS nth FROM r WHERE nth > 3 OR ts < TIMESTAMP '1993-01-01'")
def retention(spark, d):
    return govern.retention(_index(spark, d), 3, "1993-01-01").select("id", "owner", "nth")


@_query("""WITH b AS (SELECT s_suppkey AS path, s_nationkey AS x FROM supplier), c AS (SELECT c_custkey + 5 AS path, c_nationkey AS x FROM customer)
SELECT path, CASE WHEN c.x IS NULL THEN 'missing' WHEN b.x IS NULL THEN 'new' ELSE 'changed' END AS state FROM b FULL JOIN c USING (path) WHERE b.x IS DISTINCT FROM c.x""")
def restore_conflicts_whole(spark, d):
    b = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("path"), F.col("s_nationkey").alias("sum"))
    c = _t(spark, d, "customer").select((F.col("c_custkey") + 5).alias("path"), F.col("c_nationkey").alias("sum"))
    return govern.restore_conflicts(b, c)


@_query(f"""WITH x AS ({_SPANS}), r AS (SELECT *, max(struct_pack(e := e, id := id)) OVER (PARTITION BY k ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x)
SELECT k AS file, id, reach.id AS other FROM r WHERE s <= reach.e""")
def edit_overlap(spark, d):
    return govern.edit_overlaps(_spans(spark, d).withColumnRenamed("key", "file"))


@_query("""WITH u AS (SELECT split_part(split_part(split_part(url, '://', 2), '?', 1), '#', 1) AS path, CAST(""" + _LINES.format(t="html") + """ AS BIGINT) AS lines FROM pages),
x AS (SELECT lines, string_split(path, '/') AS p FROM u), y AS (SELECT lines, p, unnest(range(1, len(p) + 1)) AS depth FROM x)
SELECT array_to_string(p[1:depth], '/') AS prefix, depth, count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines FROM y GROUP BY 1, 2""")
def path_rollup(spark, d):
    p = F.split_part(F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    return retrieve.path_rollup(_t(spark, d, "pages").select(p.alias("path"), X.line_count(F.col("html")).alias("lines")))


@_query("""SELECT l_returnflag AS name, sum(CAST(l_quantity AS BIGINT)) AS actual, sum(CAST(l_linenumber AS BIGINT)) AS baseline, count(*) AS items, count(DISTINCT l_partkey) AS distinct_items, round(sum(CAST(l_linenumber AS BIGINT)) / sum(CAST(l_quantity AS BIGINT)), 9) AS cef, round(1 - count(DISTINCT l_partkey) / count(*), 9) AS dcr FROM lineitem GROUP BY 1""")
def scoreboard(spark, d):
    li = _t(spark, d, "lineitem").select(F.col("l_returnflag").alias("name"), F.col("l_quantity").cast("long").alias("actual"), F.col("l_linenumber").cast("long").alias("baseline"), F.col("l_partkey").alias("item"))
    return fit.scoreboard(li, ["name"]).withColumns({"cef": F.round("cef", 9), "dcr": F.round("dcr", 9)})


@_query(r"""SELECT page_id, name FROM (SELECT page_id, unnest(regexp_extract_all(html, '([A-Za-z_][A-Za-z0-9_]*)[ \t]*\(', 1)) AS name FROM pages) WHERE name NOT IN ('if', 'for', 'while', 'match')""")
def call_scan(spark, d):
    return retrieve.calls(_t(spark, d, "pages").select(F.col("page_id").alias("file"), F.lit(1).alias("line"), F.col("html").alias("text"))).select(F.col("file").alias("page_id"), "name")


_LOG = "SELECT user_id AS log, event_id AS line_no, CASE WHEN event_type = 'purchase' THEN 'error[E1]: lost ' || props WHEN event_type = 'click' THEN '' ELSE '  --> src/' || event_type || '.rs:' || hour(ts) || ':5' END AS line FROM events"


@_query(f"""WITH x AS ({_LOG}), s AS (SELECT *, last_value(CASE WHEN starts_with(line, 'error') OR line = '' THEN line END IGNORE NULLS) OVER (PARTITION BY log ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS head FROM x)
SELECT log, line_no AS seq, split_part(substr(line, 7), ':', 1) AS file, CAST(split_part(line, ':', 2) AS BIGINT) AS line, coalesce(head, '') AS message, CASE WHEN coalesce(head, '') = '' THEN 'info' ELSE 'error' END AS severity FROM s WHERE line LIKE '  -->%'""")
def log_sites(spark, d):
    line = F.when(F.col("event_type") == "purchase", F.concat(F.lit("error[E1]: lost "), "props")).when(F.col("event_type") == "click", "").otherwise(F.format_string("  --> src/%s.rs:%d:5", "event_type", F.hour("ts")))
    lines = _t(spark, d, "events").select(F.col("user_id").alias("log"), F.col("event_id").alias("line_no"), line.alias("line"))
    return logs.signals(lines, "rustc").drop("symbols")


@_query(r"""WITH l AS (SELECT doc_id, text, CASE WHEN text = '' THEN [] ELSE string_split(regexp_replace(text, '\n$', ''), chr(10)) END AS l FROM documents)
SELECT doc_id, CASE WHEN len(l) >= 2 THEN array_to_string(list_concat(['top', l[1]], l[3:]), chr(10)) || CASE WHEN ends_with(text, chr(10)) THEN chr(10) ELSE '' END END AS content, CASE WHEN len(l) >= 2 THEN 0 ELSE 1 END AS n_problems FROM l""")
def edits_applied(spark, d):
    files = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file"), F.col("text").alias("content"))
    spec = F.format_string("FILE: %s\nDELETE lines 2\nINSERT at 0:\nNEW:\n```\ntop\n```\n", "file")
    ops = edits.parse_specs(files.select(F.col("file").alias("spec"), spec.alias("text")))
    out = edits.apply_edits(files, ops.where("error is null"))
    return out.select(F.col("file").cast("long").alias("doc_id"), "content", F.size("problems").alias("n_problems"))


@_query("""SELECT 'src/p' || p_partkey || '.rs' AS file, 'function' AS kind, 'f_' || p_partkey AS name, CAST(strlen(p_type) + 5 AS BIGINT) AS byte_start, CAST(strlen(p_type) + 5 + strlen('pub fn f_' || p_partkey || '() { /* ' || p_name || ' */ }') AS BIGINT) AS byte_end, CAST(2 AS BIGINT) AS start_line, CAST(2 AS BIGINT) AS end_line, 'public' AS visibility, p_type AS doc FROM part
UNION ALL SELECT 'src/p' || p_partkey || '.py', 'function', 'g_' || p_partkey, 0, strlen('def g_' || p_partkey || '(): pass'), 1, 1, 'public', NULL FROM part""")
def symbols_of_sources(spark, d):
    part = _t(spark, d, "part")
    rust = part.select(F.format_string("src/p%d.rs", "p_partkey").alias("path"), F.format_string("/// %s\npub fn f_%d() { /* %s */ }\n", "p_type", "p_partkey", "p_name").alias("content"))
    python = part.select(F.format_string("src/p%d.py", "p_partkey").alias("path"), F.format_string("def g_%d(): pass\n", "p_partkey").alias("content"))
    return symbols.extract(rust.unionByName(python)).drop("lang", "qualified_name")


@_query(f"""WITH x AS ({_SPANS}), p AS (SELECT p_partkey AS id, p_partkey + 5 AS k, p_size AS line FROM part), f AS (SELECT p_partkey AS k, true AS there FROM part), b AS (SELECT k, max(struct_pack(s := s, e := e, id := x.id)) AS b FROM p JOIN x USING (k) WHERE s <= line AND line <= e GROUP BY k), n AS (SELECT k, count(*) AS n FROM x GROUP BY k)
SELECT p.id AS point_id, CASE WHEN there IS NULL THEN 'not_a_file' WHEN b.b IS NOT NULL THEN 'good' ELSE 'outside_scope' END AS status, b.b.id AS name, CASE WHEN there AND b.b IS NULL THEN CAST(least(coalesce(n, 0), 3) AS INT) END AS n_nearest FROM p LEFT JOIN f USING (k) LEFT JOIN b USING (k) LEFT JOIN n USING (k)""")
def anchor_hints_whole(spark, d):
    points = _points(spark, d).select("point_id", (F.col("key") + 5).alias("file"), "line")
    spans = _spans(spark, d).withColumnsRenamed({"id": "name", "key": "file"})
    out = retrieve.anchor_hints(points, spans, _points(spark, d).select(F.col("key").alias("file")))
    return out.select("point_id", "status", "name", F.when(F.col("status") == "outside_scope", F.coalesce(F.size("nearest"), F.lit(0))).alias("n_nearest"))


@_query("""WITH u AS (SELECT split_part(split_part(split_part(url, '://', 2), '?', 1), '#', 1) AS path, CAST(""" + _LINES.format(t="html") + """ AS BIGINT) AS lines FROM pages),
x AS (SELECT lines, string_split(path, '/') AS p FROM u), y AS (SELECT lines, p, unnest(range(1, len(p) + 1)) AS depth FROM x),
n AS (SELECT p[1:depth] AS parts, bool_or(depth < len(p)) AS dir, max(CASE WHEN depth = len(p) THEN lines END) AS lines FROM y GROUP BY 1),
l AS (SELECT *, parts[-1] = max(parts[-1]) OVER (PARTITION BY parts[1:len(parts) - 1]) AS ends FROM n), k AS (SELECT *, unnest(range(1, len(parts) + 1)) AS d FROM l),
b AS (SELECT k.parts, k.dir, k.lines, string_agg(CASE WHEN d = len(k.parts) THEN CASE WHEN a.ends THEN '└─ ' ELSE '├─ ' END WHEN a.ends THEN '   ' ELSE '│  ' END, '' ORDER BY d) AS bars FROM k JOIN l a ON a.parts = k.parts[1:d] GROUP BY 1, 2, 3)
SELECT array_to_string(parts, '/') AS path, bars || parts[-1] || CASE WHEN dir THEN '/' WHEN lines IS NULL THEN '' ELSE ':' || lines END AS text FROM b""")
def tree_drawn(spark, d):
    p = F.split_part(F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    files = _t(spark, d, "pages").select(p.alias("path"), X.line_count(F.col("html")).alias("lines"))
    return retrieve.tree_lines(files).select(F.array_join("parts", "/").alias("path"), "text")


@_query(None)
def representatives(spark, d):
    items = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.length("text").alias("level"), F.lit(1.0).alias("relevance"), F.lit(0.0).alias("proximity"))
    return fit.representatives(items).select(F.col("id").alias("doc_id"))
