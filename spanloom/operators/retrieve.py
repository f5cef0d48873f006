"""Lookup, spans, joins by interval, signals, call graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X

#: Bytes of queries that are broadcast at once.
BLOCK_BYTES = 4_000_000


def lookup(symbols: DataFrame, queries: DataFrame, k: int = 8, anchor_file: str | None = None, anchor_line: int | None = None, scope: str | None = None, history: list[str] | None = None, kinds: list[str] | None = None) -> DataFrame:
    """The k best symbols for each query: (query, symbol's columns, semantic, scope, proximity, history, rank).

    A candidate's name or qualified name contains the query or all of its tokens, or the symbol is in the anchor's directory (an
    anchor without one has all symbols in it). kinds, where given, are the only ones to count. A blank query finds nothing. The
    union of candidate sets is one predicate, so no pair comes twice. Queries are measured and go out in blocks of about
    BLOCK_BYTES, each broadcast by itself.
    """
    asked = queries.select("query").distinct().where(F.trim("query") != "")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("query") + 16), F.lit(0)).alias("n")).first().n
    blocks = size // BLOCK_BYTES + 1
    block = lambda i: asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == i) if blocks > 1 else asked
    q, names = X.ascii_lower(F.trim("query")), [X.ascii_lower(F.col(c)) for c in ("name", "qualified_name")]
    folder = (anchor_file or "").rpartition("/")[0]
    near = F.lit(False) if anchor_file is None else F.lit(True) if not folder else F.col("file").startswith(folder + "/")
    holds = lambda n: n.contains(q) | F.forall(X.words(F.col("query")), lambda t: n.contains(t))
    hit = reduce(lambda a, b: a | b, map(holds, names), near)
    if kinds is not None:
        symbols = symbols.where(F.col("kind").isin(kinds))
    pairs = reduce(DataFrame.unionByName, [symbols.join(F.broadcast(block(i)), F.coalesce(hit, F.lit(False))) for i in range(blocks)])
    scored = pairs.withColumns({"semantic": X.semantic_score(F.col("name"), F.trim("query")), "scope": X.scope_score(F.col("file"), F.lit(scope)), "proximity": X.proximity_score(F.col("file"), F.col("start_line"), F.lit(anchor_file), F.lit(anchor_line)) if anchor_file else F.lit(0), "history": F.col("qualified_name").isin(history or []).cast("int")})
    order = Window.partitionBy("query").orderBy(F.desc("semantic"), F.desc("scope"), F.desc("proximity"), F.desc("history"), "file", "start_line", "qualified_name")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(k, 1))


def selected(symbols: DataFrame, languages: list[str], include_private: bool = True) -> DataFrame:
    """Symbols of the languages asked for that have a parser; without private ones those public or without a visibility."""
    out = symbols.where(F.col("lang").isin([x for x in ("rust", "python") if x in {y.lower() for y in languages}]))
    return out if include_private else out.where("visibility is null or visibility = 'public'")


def sliced(spans: DataFrame, files: DataFrame) -> DataFrame:
    """spans (file, id, byte_start, byte_end) with body, their bytes of the file's content; cut to its end, null where a character is parted."""
    both = spans.join(files.select("file", "content"), "file")
    size = F.octet_length("content").cast("long")
    return both.withColumn("body", X.byte_slice(F.col("content"), F.least(F.col("byte_start").cast("long"), size), F.least(F.col("byte_end").cast("long"), size))).drop("content")


def expand(spans: DataFrame, context: int) -> DataFrame:
    return spans.withColumn("start", F.greatest(F.col("start") - context, F.lit(1))).withColumn("end", F.col("end") + context)


def coalesce_ranges(spans: DataFrame, keys: list[str], within: int = 0) -> DataFrame:
    """(keys, start, end, n): ranges that overlap or lie at most within + 1 apart become one."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("__new", F.when(F.col("start") > before + within + 1, 1).when(before.isNull(), 1).otherwise(0))
    island = opened.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("__island")


def _levels(spans: DataFrame) -> int:
    """How many levels of halved lines it takes until the whole range of spans is one node."""
    top = spans.agg(F.coalesce(F.max(F.greatest(F.abs(F.col("start")), F.abs(F.col("end")))), F.lit(0)).alias("m")).first().m
    return int(top).bit_length() + 1


def _in_blocks(spans: DataFrame, levels: int) -> DataFrame:
    """spans with (level, node) of the fewest aligned blocks of 2 ** level lines that make up start .. end: a row a block, two a level at most."""
    each = spans.where("start <= end").select("*", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level"))
    first = F.floor((F.col("start").cast("long") + one - 1) / one).cast("long")
    past = F.floor((F.col("end").cast("long") + 1) / one).cast("long")
    each = each.withColumns({"first": first, "past": past}).where("first < past")
    lower, upper = each.where("pmod(first, 2) = 1").withColumn("node", F.col("first")), each.where("pmod(past, 2) = 1").withColumn("node", F.col("past") - 1)
    return lower.unionByName(upper).drop("first", "past")


def _containing(points: DataFrame, spans: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """point_id, line and spans' columns of spans around each point, with the first k in order for certain.

    A point lies in one block of each level, and a span in few, so they meet by equality. Of a block's spans only the first k
    can be among a point's first k, so a crowded file costs no more than k spans a block. Points and spans grow with the input
    while the plan's guess of exploded rows stays small, so here and below they meet by merge joins at every size.
    """
    levels = _levels(spans)
    placed = _in_blocks(spans, levels)
    first = placed.withColumn("nth", F.row_number().over(Window.partitionBy(key, "level", "node").orderBy(*order))).where(F.col("nth") <= k).drop("nth")
    each = points.where("line is not null").select(key, "point_id", "line", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"))
    each = each.withColumn("node", F.floor(F.col("line").cast("long") / F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level"))).cast("long"))
    return each.join(first.hint("merge"), [key, "level", "node"]).drop("level", "node")


def _beside(points: DataFrame, spans: DataFrame, key: str, k: int, after: bool) -> DataFrame:
    """point_id, line and spans' columns of the k nearest spans that begin after each point's line, or that end before it.

    Spans are numbered in order and each point counts those it has passed, so they meet by number.
    """
    own, order = ("start", ["start", "name"]) if after else ("end", ["end", F.desc("start"), F.desc("name")])
    numbered = spans.where("start <= end").withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))
    rows = numbered.select(key, F.col(own).cast("long").alias("at"), F.lit(0 if after else 1).alias("turn"), F.lit(None).cast(points.schema["point_id"].dataType).alias("point_id"), F.lit(1).alias("one"))
    rows = rows.unionByName(points.where("line is not null").select(key, F.col("line").cast("long").alias("at"), F.lit(1 if after else 0).alias("turn"), "point_id", F.lit(0).alias("one")))
    passed = F.sum("one").over(Window.partitionBy(key).orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0))
    wanted = F.sequence(F.col("passed") + 1, F.col("passed") + k) if after else F.sequence(F.col("passed") - k + 1, F.col("passed"))
    asked = rows.withColumn("passed", passed).where("one = 0").select(key, "point_id", F.col("at").alias("line"), F.explode(wanted).alias("nth"))
    return asked.join(numbered.hint("merge"), [key, "nth"]).drop("nth")


def nearest_spans(points: DataFrame, spans: DataFrame, key: str, k: int = 3) -> DataFrame:
    """The k spans of the point's key that are nearest to its line, with distance and rank; ties by start, then name.

    Candidates are the k first around the point, the k first after it and the k last before it, each found in time linear in
    the key's rows.
    """
    slim, kept = points.select(key, "point_id", "line"), spans.select(key, "name", "start", "end")
    near = _containing(slim, kept, key, [F.col("start"), F.col("name")], k).unionByName(_beside(slim, kept, key, k, True)).unionByName(_beside(slim, kept, key, k, False))
    d = near.withColumn("distance", X.distance_to_span(F.col("line"), F.col("start"), F.col("end")))
    w = Window.partitionBy("point_id").orderBy("distance", "start", "name")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def enclosing_span(points: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """(point_id, name, start, end): the innermost span around each point, the one that starts last; null without one."""
    order = [F.desc("start"), F.desc("end"), F.desc("name")]
    inside = _containing(points.select(key, "point_id", "line"), spans.select(key, "name", "start", "end"), key, order, 1)
    best = inside.groupBy("point_id").agg(F.max(F.struct("start", F.col("end"), "name")).alias("b"))
    return points.select("point_id").join(best.hint("merge"), "point_id", "left").select("point_id", F.col("b.name").alias("name"), F.col("b.start").alias("start"), F.col("b.end").alias("end"))


def owner_asof(rows: DataFrame, key: str, order: list[str], is_owner: Column, owner: Column, within: int | None = None) -> DataFrame:
    """rows with owner: the last owner at or before each row of its key, else the first one after.

    within: owners further off by order's first column do not count. Both ways are running frames, so a key costs a sort.
    """
    value = F.when(is_owner, F.struct(owner.alias("owner"), F.col(order[0]).alias("at")))
    frame = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    before = F.last(value, ignorenulls=True).over(frame(Window.partitionBy(key).orderBy(*order)))
    after = F.last(value, ignorenulls=True).over(frame(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])))
    near = lambda c: c if within is None else F.when(F.abs(c["at"] - F.col(order[0])) <= within, c)
    found = rows.withColumn("__before", before).withColumn("__after", after)
    return found.withColumn("owner", F.coalesce(near(F.col("__before"))["owner"], near(F.col("__after"))["owner"])).drop("__before", "__after")


def merge_signals(signals: DataFrame) -> DataFrame:
    """(file, line, n, symbols, severity, message): signals of a file's line as one, the gravest and the first message."""
    some = F.when(F.col("message") != "", F.struct("seq", "message"))
    return signals.groupBy("file", "line").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("symbol")).alias("symbols"), X.severity_name(F.max(X.severity_rank(F.col("severity")))).alias("severity"), F.coalesce(F.min(some)["message"], F.lit("")).alias("message"))


def signal_boost(items: DataFrame, signals: DataFrame) -> DataFrame:
    """items (id, file, start, end, level, relevance, proximity) raised by the signals near them, in single precision.

    Signals of one line and weight are counted first, so an item meets each line of its file that has any once.
    """
    f = lambda x: F.lit(x).cast("float")
    d = X.distance_to_span(F.col("line"), F.col("start"), F.col("end"))
    near = (F.col("weight") / (d + 1)).cast("float")  # a quotient is a double until then
    one = F.least(near, f(2.0))
    lines = signals.groupBy("file", "line", X.severity_weight(F.col("severity")).alias("weight")).agg(F.count("*").alias("n"))
    total = items.select("id", "file", "start", "end").join(lines, "file").groupBy("id").agg(F.sum(one.cast("double") * F.col("n")).cast("float").alias("boost"))
    out = items.join(total, "id", "left").withColumn("boost", F.coalesce("boost", f(0.0)))
    mult, add = F.least(f(1.0) + f(0.15) * F.col("boost"), f(1.5)), F.least(f(0.05) * F.col("boost"), f(0.5))
    raised = lambda c: F.least(F.col(c) * mult + add * f(0.1), f(1.0))
    hit = (F.col("boost") > 0) & ~F.col("id").startswith("__")
    return out.withColumns({"level": F.when(hit, F.floor(F.least(F.col("level").cast("float") * mult + add * f(255.0), f(255.0))).cast("int")).otherwise(F.col("level")), "relevance": F.when(hit, raised("relevance")).otherwise(F.col("relevance")), "proximity": F.when(hit, raised("proximity")).otherwise(F.col("proximity"))})


def hops(edges: DataFrame, start: DataFrame, depth: int = 2) -> DataFrame:
    """(node, hop): the least number of edges from any node of start, up to depth; breadth first, by joins."""
    seen = start.select("node").distinct().withColumn("hop", F.lit(0))
    edge = edges.select("src", "dst").distinct()
    for hop in range(1, depth + 1):
        new = edge.join(seen.where(F.col("hop") == hop - 1).select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        seen = seen.unionByName(new.join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(hop)))
    return seen


def calls(lines: DataFrame) -> DataFrame:
    """(file, line, name): identifiers before an opening bracket, control words apart."""
    names = F.regexp_extract_all("text", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)[ \t]*\("), F.lit(1))
    return lines.select("file", "line", F.explode(names).alias("name")).where(~F.col("name").isin("if", "for", "while", "match"))


def path_rollup(files: DataFrame) -> DataFrame:
    """(prefix, depth, files, lines) of every directory above each file."""
    parts = F.split("path", "/")
    up = files.select("lines", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("prefix")))).alias("p"))
    return up.groupBy(F.col("p.prefix").alias("prefix"), F.col("p.depth").cast("long").alias("depth")).agg(F.count("*").alias("files"), F.sum("lines").alias("lines"))


def anchor_hints(points: DataFrame, spans: DataFrame, files: DataFrame, k: int = 3) -> DataFrame:
    """(point_id, status, name, start, end, nearest) of points (point_id, file, line): good with the innermost span around it,
    outside_scope with the k nearest spans of its file, or not_a_file.
    """
    inside = enclosing_span(points, spans, "file")
    near = nearest_spans(points, spans, "file", k).groupBy("point_id").agg(F.array_sort(F.collect_list(F.struct("rank", "name", "start", F.col("end"), "distance"))).alias("nearest"))
    there = points.select("point_id", "file").join(files.select("file").distinct().withColumn("there", F.lit(True)).hint("merge"), "file", "left").select("point_id", "there")
    status = F.when(F.col("there").isNull(), "not_a_file").when(F.col("name").isNotNull(), "good").otherwise("outside_scope")
    out = inside.join(there.hint("merge"), "point_id").join(near.hint("merge"), "point_id", "left").withColumn("status", status)
    return out.select("point_id", "status", "name", "start", "end", F.when(F.col("status") == "outside_scope", F.col("nearest")).alias("nearest"))


def tree_lines(files: DataFrame) -> DataFrame:
    """(parts, text) of files (path, lines), a row for each file and directory; ordered by parts the texts are the drawn tree."""
    parts = F.split("path", "/")
    each = files.select("lines", parts.alias("all"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth"))
    nodes = each.groupBy(F.slice("all", F.lit(1), F.col("depth")).alias("parts")).agg(F.max(F.size("all") > F.col("depth")).alias("is_dir"), F.max(F.when(F.size("all") == F.col("depth"), F.col("lines"))).alias("lines"))
    above = lambda c: F.slice(c, F.lit(1), F.size(c) - 1)
    nodes = nodes.withColumn("parent", above(F.col("parts")))
    last = nodes.groupBy("parent").agg(F.max(F.element_at("parts", -1)).alias("last"))
    nodes = nodes.join(last, "parent").withColumn("is_last", F.element_at("parts", -1) == F.col("last")).drop("last")
    name = F.element_at("parts", -1)
    label = F.when(F.col("is_dir"), F.concat(name, F.lit("/"))).when(F.col("lines").isNull(), name).otherwise(F.concat_ws(":", name, F.col("lines").cast("string")))
    up = nodes.select("parts", "is_dir", "lines", "is_last", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("d"))
    up = up.withColumn("key", F.slice("parts", F.lit(1), F.col("d"))).join(nodes.select(F.col("parts").alias("key"), F.col("is_last").alias("ends")), "key")
    own = F.col("d") == F.size("parts")
    bar = F.when(own, F.when(F.col("ends"), "└─ ").otherwise("├─ ")).otherwise(F.when(F.col("ends"), "   ").otherwise("│  "))
    drawn = up.groupBy("parts", "is_dir", "lines").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("d", bar.alias("bar")))), lambda x: x["bar"]), "").alias("bars"))
    return drawn.select("parts", F.concat("bars", label).alias("text"))
