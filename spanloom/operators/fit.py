"""Duplicates, novelty, budgets, chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import lineage

#: Words of code that carry no novelty.
STOPWORDS = ["fn", "function", "struct", "impl", "implementation", "module", "class", "pub", "public", "trait", "interface", "method", "test", "assert", "std", "fmt", "debug", "display", "derive", "clone", "copy", "eq"]


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.sha2(X.squeezed(F.col("text")), 256).alias("h"))


def exact_classes(docs: DataFrame) -> DataFrame:
    """(h, first_id, copies): a row for each class of rows whose squeezed texts are equal, by hash."""
    return _hashed(docs).groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))


def exact_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, first_id, copies) for every row: the class it is in. A merge join, so that a large class can be split."""
    own, classes = _hashed(docs), exact_classes(docs)
    return own.join(classes.withColumnRenamed("h", "k").hint("merge"), F.col("h").eqNullSafe(F.col("k"))).select("doc_id", "first_id", "copies")


def jaccard_pairs(docs: DataFrame, threshold: float = 0.7, n: int = 4, apart: str | None = None) -> DataFrame:
    """(a, b, jaccard) for pairs of distinct texts, a and b the least ids of theirs, from shared shingles.

    apart: a boolean column; rows where it holds stand for themselves alone. Sets are stored once, in the shared folder.

    Prefix filter: a pair over the threshold shares one of the first (1 - threshold) |set| + 1 shingles in the order of
    corpus frequency, rarest first, so common shingles never join.
    """
    own = F.when(F.col(apart), F.col("doc_id")) if apart else F.lit(None).cast("int")
    sets = docs.select("doc_id", own.alias("own"), X.shingles(X.words(F.col("text")), n).alias("s")).where(F.size("s") > 0)
    sets = sets.groupBy(F.sha2(F.array_join(F.array_sort("s"), "\n"), 256).alias("h"), "own").agg(F.min(F.struct("doc_id", F.transform("s", lambda x: F.xxhash64(x)).alias("s"))).alias("m"))
    sets = lineage.cut(sets.select(F.col("m.doc_id").alias("doc_id"), F.col("m.s").alias("s")))
    each = sets.select("doc_id", F.size("s").alias("n"), F.explode("s").alias("g"))
    freq = each.groupBy("g").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("df", "g"))
    prefix = each.join(freq, "g").withColumn("r", rank).where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1).where("df > 1")
    a, b = prefix.select("g", F.col("doc_id").alias("a"), F.col("n").alias("na")), prefix.select("g", F.col("doc_id").alias("b"), F.col("n").alias("nb"))
    near = a.join(b, "g").where("a < b").where((F.least("na", "nb") >= threshold * F.greatest("na", "nb"))).select("a", "b").distinct()
    sa, sb = sets.select(F.col("doc_id").alias("a"), F.col("s").alias("x")), sets.select(F.col("doc_id").alias("b"), F.col("s").alias("y"))
    return near.join(sa, "a").join(sb, "b").select("a", "b", X.jaccard(F.col("x"), F.col("y")).alias("jaccard")).where(F.col("jaccard") >= threshold)


def jaccard_members(docs: DataFrame, n: int = 4) -> DataFrame:
    """(doc_id, representative, texts) for every row: the id that stands in jaccard_pairs for its set of shingles, and how many
    different texts have that set, which are alike at 1.0. A text without shingles stands for itself.
    """
    s = X.shingles(X.words(F.col("text")), n)
    h = F.when(F.size(s) > 0, F.sha2(F.array_join(F.array_sort(s), "\n"), 256)).otherwise(F.concat(F.lit("own "), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    own = docs.select("doc_id", h.alias("h"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("t"))
    classes = own.groupBy("h", "t").agg(F.min("doc_id").alias("m")).groupBy("h").agg(F.min("m").alias("representative"), F.count("*").alias("texts"))
    return own.join(classes.hint("merge"), "h").select("doc_id", "representative", "texts")


def terms(t):
    """Runs of letters, digits and _ of two bytes or more, with A-Z lower-cased, without stop words."""
    return F.filter(F.regexp_extract_all(X.ascii_lower(t), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: (F.octet_length(w) >= 2) & ~w.isin(STOPWORDS))


def doc_freq(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def novelty(docs: DataFrame, top: int = 16) -> DataFrame:
    """(doc_id, novelty): the mean of a text's `top` highest inverse document frequencies, as a share of the highest there is.

    Occurrences count, so a term that comes twice takes two of the places. Where all terms are in all texts novelty is 0.
    """
    each = docs.select("doc_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    each = lineage.cut(each)  # a row for each term of a text, for both uses
    df = each.groupBy("term").agg(F.count("*").alias("df"))
    stats = df.agg(F.min("df").alias("least")).crossJoin(docs.agg(F.count("*").alias("n")))  # one row
    w = Window.partitionBy("doc_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    ranked = each.join(df, "term").withColumn("before", F.coalesce(F.sum("tf").over(w), F.lit(0))).where(F.col("before") < top)
    taken = F.least(F.col("tf"), top - F.col("before"))
    high = F.log(F.col("n") / F.col("least"))
    one = F.when(F.col("n") > F.col("least"), F.log(F.col("n") / F.col("df")) / high).otherwise(0.0)
    mean = ranked.crossJoin(F.broadcast(stats)).groupBy("doc_id").agg((F.sum(taken * one) / F.sum(taken)).alias("novelty"))
    return docs.select("doc_id").join(mean, "doc_id", "left").select("doc_id", F.coalesce("novelty", F.lit(0.0)).alias("novelty"))


def budget_fit(items: DataFrame, budget: int | dict[str, int], key: str = "bucket") -> DataFrame:
    """(key, id, tokens, pos): in each bucket the items that fit, with the tokens each may have.

    budget: one for every bucket, or each bucket's own. Order is by level, relevance and, where there is one, proximity, then
    id. Items with hard (a boolean column, if there is one) come first: each reserves min_tokens (a column, if there is one), at
    least one. Then the others: an item that still fits is taken whole, one with min_tokens that fit is cut to them, else it is
    passed over. If a hard item finds no room, none but hard items stay. What is left goes to the hard items, in order, up to
    their whole tokens. Ids are unique in a bucket.

    What room there is only falls, so of items of one size those taken are the first in order, and no more than the budget has
    room for. The others are dropped before the fold, so a task holds some budget * log(budget) rows of each kind, not a bucket.
    """
    by = [c for c in ("level", "relevance", "proximity") if c in items.columns]
    order = [*[F.desc(c) for c in by], F.asc("id")]
    room = F.element_at(F.create_map(*[F.lit(x) for kv in budget.items() for x in kv]), F.col(key)) if isinstance(budget, dict) else F.lit(budget)
    hard = F.coalesce(F.col("hard"), F.lit(False)) if "hard" in items.columns else F.lit(False)
    least = F.coalesce(F.col("min_tokens"), F.lit(0)).cast("long") if "min_tokens" in items.columns else F.lit(0).cast("long")
    slim = items.select(key, "id", F.col("tokens").cast("long").alias("tokens"), *by, hard.alias("hard"), F.when(hard, F.greatest(least, F.lit(1))).otherwise(least).alias("least"), room.cast("long").alias("room"))
    need = F.when(F.col("hard"), F.col("least")).when((F.col("least") > 0) & (F.col("least") < F.col("tokens")), F.col("least")).otherwise(F.col("tokens"))
    # a hard item that needs more than there is still says that one has no room
    slim = slim.withColumn("need", need).where("need <= room or hard")
    rank = F.row_number().over(Window.partitionBy(key, "hard", "tokens", "least").orderBy(*order))
    most = max(budget.values(), default=0) if isinstance(budget, dict) else budget
    some = slim.where("tokens > 0").withColumn("nth", rank).where(F.col("nth") <= most + 1).where((F.col("nth") - 1) * F.least("need", "tokens") <= F.col("room"))
    held = some.drop("nth").unionByName(slim.where("tokens <= 0"))  # empty items take no room

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([*by, "id"], ascending=[*(False for _ in by), True], kind="stable")
        left, given, missing = int(rows.room.iloc[0]), [], False
        for i, (t, m, firm) in enumerate(zip(rows.tokens.tolist(), rows.least.tolist(), rows.hard.tolist())):
            if firm:
                missing |= m > left
                if m <= left:
                    given.append((i, min(t, m)))
                    left -= min(t, m)
        firm_count = len(given)
        if not missing:
            for i, (t, m, firm) in enumerate(zip(rows.tokens.tolist(), rows.least.tolist(), rows.hard.tolist())):
                take = -1 if firm else t if t <= left else m if 0 < m <= left else -1
                if take >= 0:
                    given.append((i, take))
                    left -= take
                if take >= 0 and take < t and left == 0:
                    break
        for j in range(firm_count):
            i, n = given[j]
            more = min(left, int(rows.tokens.iloc[i]) - n)
            given[j], left = (i, n + more), left - more
        at = [i for i, _ in given]
        return pd.DataFrame({key: rows[key].iloc[at].to_numpy(), "id": rows.id.iloc[at].to_numpy(), "tokens": [n for _, n in given], "pos": range(1, len(at) + 1)})

    kind = dict(slim.dtypes)
    return held.groupBy(key).applyInPandas(fold, f"{key} {kind[key]}, id {kind['id']}, tokens long, pos long")


def trim_tail(items: DataFrame, most: int, key: str = "bucket") -> DataFrame:
    """items (key, id, tokens) of each bucket up to `most` tokens: the smallest go first, of equal ones the least id.

    No more than `most` items of a token or more can stay, so the others are dropped before any sum; empty ones stay where all
    others do.
    """
    order = Window.partitionBy(key).orderBy(F.desc("tokens"), F.desc("id"))
    some = items.where("tokens > 0")
    first = some.withColumn("__nth", F.row_number().over(order)).where(F.col("__nth") <= most + 1)
    kept = first.withColumn("__sum", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("__sum") <= most)
    full = some.groupBy(key).agg(F.sum("tokens").alias("__all")).where(F.col("__all") > most)
    return kept.drop("__nth", "__sum").unionByName(items.where("tokens <= 0").join(full.select(key), key, "left_anti").select(items.columns))


def overflow(items: DataFrame, caps_total: int, tolerance: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Of items (id, tokens) of all buckets, those within the sum of caps and a tolerance, and refusals (id, bucket, reason) of the others.

    Items go by id, the least first, until the rest fits: down to the id at which the sum from above is too much, which is among
    the first as many as there are tokens.
    """
    most = caps_total + int(caps_total * tolerance)
    first = items.where("tokens > 0").select("id", "tokens").orderBy(F.desc("id")).limit(most + 1)  # a top-k
    summed = first.withColumn("sum", F.sum("tokens").over(Window.orderBy(F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)))
    cut = summed.where(F.col("sum") > most).agg(F.max("id").alias("__cut"))  # one row
    both = items.crossJoin(F.broadcast(cut))
    gone = F.coalesce(F.col("id") <= F.col("__cut"), F.lit(False))
    return both.where(~gone).drop("__cut"), both.where(gone).select("id", F.lit("mixed").alias("bucket"), F.lit("budget-overflow").alias("reason"))


def refusals(items: DataFrame, fitted: DataFrame, cap: int, key: str = "bucket") -> DataFrame:
    """(key, id, reason) of what was not taken."""
    left = items.join(fitted.select(key, "id"), [key, "id"], "left_anti")
    return left.select(key, "id", F.when(F.col("tokens") > cap, "bucket-cap-exceeded").otherwise("budget-overflow").alias("reason"))


#: The buckets, and the tags that lead to them before code does.
BUCKETS, BUCKET_TAGS = ("code", "interfaces", "tests"), (("test", "tests"), ("interface", "interfaces"))


def parse_caps(spec: str) -> dict[str, int]:
    """Caps of code=N,interfaces=N,tests=N; a bucket not named has none to spend."""
    caps = dict.fromkeys(BUCKETS, 0)
    for part in filter(None, (p.strip() for p in spec.split(","))):
        name, eq, value = (x.strip() for x in part.partition("="))
        if not eq or name not in caps or not value.isascii() or not value.isdigit():
            raise ValueError(f"not a bucket's cap: {part}")
        caps[name] = int(value)
    return caps


def bucketed_fit(items: DataFrame, caps: dict[str, int], novelty_least: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(fitted, refused) of items (id, content, tokens, level, relevance, tags): each bucket filled up to its cap.

    An item's bucket is tests, else interfaces, else code by its tags. With novelty_least, less novel items are refused first,
    by document frequencies of all items. refused: (id, bucket, reason). Buckets come as code, interfaces, tests, and within
    each in the order of budget_fit(). What is over the sum of caps and 5 % is refused as budget-overflow.
    """
    bucket = F.lit("code")
    for tag, name in reversed(BUCKET_TAGS):
        bucket = F.when(F.array_contains("tags", tag), name).otherwise(bucket)
    placed = items.withColumn("bucket", F.when(F.col("tags").isNull(), "code").otherwise(bucket))
    dull = None
    if novelty_least is not None:
        scores = novelty(placed.select(F.col("id").alias("doc_id"), F.col("content").alias("text"))).withColumnRenamed("doc_id", "id")
        placed = placed.join(scores, "id")
        low = F.col("novelty") < novelty_least
        dull = placed.where(low).select("id", "bucket", F.format_string("novelty-floor<%.2f", F.lit(float(novelty_least))).alias("reason"))
        placed = placed.where(~low)
    fitted = trim_caps(budget_fit(placed, caps), caps)
    refused = placed.join(fitted.select("id", "bucket"), ["id", "bucket"], "left_anti").select("id", "bucket", F.lit("bucket-cap-exceeded").alias("reason"))
    fitted, over = overflow(fitted, sum(caps.values()))
    refused = refused.unionByName(over)
    return fitted, refused if dull is None else dull.unionByName(refused)


def trim_caps(fitted: DataFrame, caps: dict[str, int]) -> DataFrame:
    """trim_tail() of each bucket to its cap; those within it, as budget_fit() leaves them, stay as they are."""
    room = F.element_at(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]), F.col("bucket"))
    w = Window.partitionBy("bucket").orderBy(F.desc("tokens"), F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    return fitted.withColumn("__sum", F.sum("tokens").over(w)).where(F.col("__sum") <= room).drop("__sum")


def representatives(items: DataFrame, threshold: float = 0.7, preserve: str | None = None) -> DataFrame:
    """items (id, content, level, relevance, proximity) without copies and near-copies: in order of priority an item stays unless one that stays is like it.

    Likeness is the Jaccard of runs of four words; texts of fewer words only fall to equal ones. preserve: a boolean column of
    items that always stay. Each round decides all items whose better neighbours are decided, so the result is that of the
    sequential order; rounds are as many as the longest chain of neighbours, and each one's lineage is cut.
    """
    order = F.struct(-F.col("level"), -F.col("relevance"), -F.col("proximity"), F.col("id"))
    safe = F.coalesce(F.col(preserve), F.lit(False)) if preserve else F.lit(False)
    ranked = items.select(order.alias("doc_id"), F.col("content").alias("text"), safe.alias("safe"), F.sha2(X.squeezed(F.col("content")), 256).alias("h"))
    first = ranked.groupBy("h").agg(F.min("doc_id").alias("doc_id"))
    ranked = ranked.join(first, ["h", "doc_id"], "left_semi")
    grams = X.shingles(X.words(F.col("text")), 4)
    sets = ranked.select("doc_id", "safe", F.size(grams).alias("n"), F.when(F.col("safe") | (F.size(grams) == 0), F.col("doc_id")).alias("own"), F.sha2(F.array_join(F.array_sort(grams), "\n"), 256).alias("set"))
    nodes = lineage.cut(sets.groupBy("set", "own").agg(F.min("doc_id").alias("doc_id"), F.bool_or("safe").alias("safe")).select("doc_id", "safe"))
    edges = lineage.cut(jaccard_pairs(ranked, threshold, apart="safe").select("a", "b").join(nodes.where("safe").select(F.col("doc_id").alias("b")), "b", "left_anti"))
    stay, left = nodes.where("safe").select("doc_id"), nodes.where("not safe").select("doc_id")
    new = stay
    while True:
        hit = edges.join(new.select(F.col("doc_id").alias("a")), "a", "left_semi").select(F.col("b").alias("doc_id"))
        left = lineage.cut(left.join(hit, "doc_id", "left_anti"))
        if left.isEmpty():
            break
        waits = edges.join(left.select(F.col("doc_id").alias("a")), "a", "left_semi").select(F.col("b").alias("doc_id"))
        new = lineage.cut(left.join(waits, "doc_id", "left_anti"))
        stay, left = stay.unionByName(new), left.join(new, "doc_id", "left_anti")
    return items.join(stay.select(F.col("doc_id")["id"].alias("id")), "id", "left_semi")


def token_chunks(docs: DataFrame, most: int = 128, overlap: int = 32) -> DataFrame:
    """(doc_id, chunk, start, end): windows of most tokens, each beginning overlap before the last one's end."""
    n, step = F.col("n"), most - overlap
    count = F.when(n <= most, F.when(n > 0, 1).otherwise(0)).otherwise(F.ceil((n - most) / step).cast("int") + 1)
    c = docs.select("doc_id", X.token_count(F.col("text")).alias("n")).withColumn("k", count).where("k > 0")
    return c.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("chunk")).select("doc_id", F.col("chunk").cast("long").alias("chunk"), (F.col("chunk") * step).cast("long").alias("start"), F.least(F.col("chunk") * step + most, F.col("n")).cast("long").alias("end"))


def greedy_pack(rows: DataFrame, most: int, key: str, order: str) -> DataFrame:
    """(key, order, tokens, pack): consecutive rows of a key share a pack while its tokens fit."""
    return _packed(rows, most, key, order, False).drop("big")


def greedy_pack_breaking(rows: DataFrame, most: int, key: str, order: str) -> DataFrame:
    """greedy_pack() with big: a row that is over `most` by itself has a pack of its own."""
    return _packed(rows, most, key, order, True)


def _packed(rows: DataFrame, most: int, key: str, order: str, alone: bool) -> DataFrame:
    """A key's rows pass through one task in order, which keeps a sum and a number only."""
    kind = dict(rows.dtypes)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, pack, held, begun = None, 0, 0, False, False
        for batch in batches:
            packs, big = [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if not begun or k != now:
                    now, total, pack, held, begun = k, 0, 0, False, True
                big.append(alone and t > most)
                if held and (total + t > most or big[-1]) and (alone or total > 0):
                    total, pack, held = 0, pack + 1, False
                packs.append(pack)
                total, held = total + t, True
                if big[-1]:
                    total, pack, held = 0, pack + 1, False
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(packs, pa.int64()), pa.array(big, pa.bool_())], [key, order, "tokens", "pack", "big"])

    sorted_ = rows.select(key, order, F.col("tokens").cast("long").alias("tokens")).repartition(key).sortWithinPartitions(key, order)
    return sorted_.mapInArrow(fold, f"{key} {kind[key]}, {order} {kind[order]}, tokens long, pack long, big boolean")


def scoreboard(rows: DataFrame, keys: list[str]) -> DataFrame:
    """cef (baseline for each actual token) and dcr (the share of items that are repeats) by keys."""
    return rows.groupBy(*keys).agg(F.sum("actual").alias("actual"), F.sum("baseline").alias("baseline"), F.count("*").alias("items"), F.countDistinct("item").alias("distinct_items")).withColumns({"cef": F.when(F.col("actual") == 0, 0.0).otherwise(F.col("baseline") / F.col("actual")), "dcr": 1.0 - F.col("distinct_items") / F.col("items")})
