"""The context of a request: symbols looked up, their lines merged into pieces, ranked, fitted to a budget, and emitted.

Symbols and files may be any size; after the lookup there are at most k pieces a query, which one task can fit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bpe
from ..functions import exprs as X
from ..functions import paths as P
from ..operators import callgraph, fit, lineage, retrieve
from ..operators import dedupe as dedupes

#: Budget, limit and symbols a query of each tier.
TIERS = {"A": (1200, 96, 6), "B": (3000, 192, 8), "C": (6000, 256, 12)}
#: Levels, relevance and proximity of pieces in the anchor's file, in its directory, and elsewhere.
HIGH, MEDIUM, LOW = (200, 1.0, 1.0), (100, 0.7, 0.5), (50, 0.3, 0.1)
#: Extensions of files that count as interfaces.
INTERFACE_EXTENSIONS = ("rs", "ts", "tsx", "h", "hpp", "hh")
#: The template's id; the tokens that it reserves, and those to which a piece is cut where it does not fit whole.
TEMPLATE_ID, TEMPLATE_TOKENS, PIECE_TOKENS = "__template__", 80, 64
#: Budget, limit and symbols a query without a tier.
DEFAULTS = (6000, 256, 8)


def limits(tier: str | None = None, budget: int | None = None, limit: int = DEFAULTS[1], top: int = DEFAULTS[2]) -> tuple[int, int, int]:
    """Budget, limit and symbols a query: a tier's, but for a budget that is given and flags that are not the defaults."""
    of = TIERS[tier.upper()] if tier else DEFAULTS
    return budget if budget is not None else of[0], limit if limit != DEFAULTS[1] else of[1], top if top != DEFAULTS[2] else of[2]


def pieces(chosen: DataFrame, files: DataFrame) -> DataFrame:
    """(file, start, end, body) of chosen symbols: one by itself is its bytes, where it has any and they part no character, else its lines.

    Overlapping ones are one piece of whole lines. Files not at hand give none.
    """
    spans = chosen.select("file", F.col("start_line").alias("start"), F.col("end_line").alias("end"), *[c for c in ("byte_start", "byte_end") if c in chosen.columns]).distinct()
    merged = retrieve.coalesce_ranges(spans, ["file"], -1)
    lines = F.array_join(F.slice(X.lines(F.col("content")), F.col("start").cast("int"), (F.col("end") - F.col("start") + 1).cast("int")), "\n")
    body = lines
    if "byte_start" in chosen.columns:
        merged = merged.join(spans.groupBy("file", "start", "end").agg(F.min("byte_start").alias("byte_start"), F.max("byte_end").alias("byte_end")), ["file", "start", "end"], "left")
        body = F.coalesce(F.when(F.col("n") == 1, X.byte_slice(F.col("content"), F.col("byte_start"), F.col("byte_end"))), lines)
    return merged.join(files.select("file", "content"), "file").select("file", "start", "end", body.alias("body"))


def in_reading_order(found: DataFrame, anchor_file: str | None, root: str = "/") -> DataFrame:
    """pieces() with nth: those of the anchor's file, then those of its folder, then by path and line."""
    here = F.lit(False) if anchor_file is None else P.same_file(F.col("file"), F.lit(anchor_file), root)
    order = Window.orderBy(here.desc(), P.in_folder_of(F.col("file"), anchor_file, root).desc(), P.relative(F.col("file"), root), "start")
    return found.withColumn("nth", F.row_number().over(order))


def error_text(has_symbols: bool) -> str:
    """What is said where nothing was found, as text."""
    return "No symbols matched the queries.\n" if has_symbols else "No symbols are indexed.\n"


def items(found: DataFrame, anchor_file: str | None = None, fence: bool = False, template: str = "", vocab: str | None = bpe.VOCAB, piece_tokens: int = PIECE_TOKENS) -> DataFrame:
    """(id, file, start, end, content, tokens, level, relevance, proximity, hard, min_tokens, tags) of pieces, with the template as a hard item.

    vocab: the vocabulary that counts tokens; None counts words and signs by a regular expression.
    """
    f = lambda x: F.lit(x).cast("float")
    same = F.lit(False) if anchor_file is None else F.col("file") == anchor_file
    folder = (anchor_file or "").rpartition("/")[0]
    inside = F.lit(False) if anchor_file is None else (F.lit(True) if not folder else F.col("file").startswith(folder + "/"))
    rank = lambda i, kind: F.when(same, F.lit(HIGH[i])).when(inside, F.lit(MEDIUM[i])).otherwise(F.lit(LOW[i])).cast(kind)
    ext = F.regexp_extract("file", r"\.([^./]+)$", 1)
    open_, close = (F.concat(F.lit("```"), ext, F.lit("\n")), F.lit("\n```\n\n")) if fence else (F.lit(""), F.lit("\n\n"))
    text = F.concat(F.format_string("// File: %s (lines %d-%d)\n", "file", "start", "end"), open_, F.col("body"), close)
    tags = F.array(F.when(ext.isin(*INTERFACE_EXTENSIONS), "interface").otherwise("code"))
    out = found.select(F.format_string("%s:%d-%d", "file", "start", "end").alias("id"), "file", "start", "end", text.alias("content"), rank(0, "int").alias("level"), rank(1, "float").alias("relevance"), rank(2, "float").alias("proximity"), F.lit(False).alias("hard"), F.lit(piece_tokens).cast("long").alias("min_tokens"), tags.alias("tags"))
    if template:
        head = found.sparkSession.range(1).select(F.lit(TEMPLATE_ID).alias("id"), F.lit(None).cast("string").alias("file"), *(F.lit(None).cast(out.schema[c].dataType).alias(c) for c in ("start", "end")), F.lit(template).alias("content"), F.lit(HIGH[0]).alias("level"), f(HIGH[1]).alias("relevance"), f(HIGH[2]).alias("proximity"), F.lit(True).alias("hard"), F.lit(TEMPLATE_TOKENS).cast("long").alias("min_tokens"), F.array(F.lit("code")).alias("tags"))
        out = out.unionByName(head)
    return out.withColumn("tokens", X.token_count(F.col("content")) if vocab is None else bpe.token_count(F.col("content"), vocab))


def context(symbols: DataFrame, files: DataFrame, queries: DataFrame, tier: str | None = None, budget: int | None = None, top: int = DEFAULTS[2], anchor_file: str | None = None, anchor_line: int | None = None, scope: str | None = None, history: list[str] | None = None, signals: DataFrame | None = None, caps: str | None = None, novelty_least: float | None = None, dedupe: float | None = None, fence: bool = False, template: str = "", limit: int = DEFAULTS[1], kinds: list[str] | None = None, vocab: str | None = bpe.VOCAB, piece_tokens: int = PIECE_TOKENS) -> DataFrame:
    """(pos, id, tokens, content): the items that fit, hard ones first, then in order of priority; cut ones end in an ellipsis.

    limits() says what tier, budget, limit and top come to; a lookup gives at most the lesser of the last two. caps fits code,
    interfaces and tests by themselves, in that order, and then neither budget nor dedupe count; novelty_least counts with caps
    only. signals (file, line, severity) raise the pieces near them, and an anchor with a line those that its function calls or
    is. No match gives no rows but the template's.
    """
    budget, limit, top = limits(tier, budget, limit, top)
    chosen = retrieve.lookup(symbols, queries, min(limit, top), anchor_file, anchor_line, scope, history, kinds)
    todo = items(pieces(chosen, files), anchor_file, fence, template, vocab, piece_tokens)
    if signals is not None:
        near = retrieve.signal_boost(todo.where("file is not null"), signals).drop("boost")
        todo = near.unionByName(todo.where("file is null"))
    if anchor_file is not None and anchor_line is not None:
        todo = callgraph.raised_by_calls(todo, callgraph.number_lines(files), anchor_file, anchor_line)
    if caps is not None:
        fitted = fit.bucketed_fit(todo, fit.parse_caps(caps), novelty_least)[0]
    else:
        todo = todo.withColumn("bucket", F.lit("all"))
        if dedupe is not None:
            todo = todo.join(dedupes.distinct(todo, threshold=dedupe, swap=vocab is not None, vocab=vocab or bpe.VOCAB).select("id"), "id", "left_semi")
        fitted = fit.budget_fit(todo, budget)
    turn = F.array_position(F.array(*[F.lit(b) for b in fit.BUCKETS]), F.col("bucket"))
    kept = todo.select("id", "content", F.col("tokens").alias("whole")).join(fitted.select("id", "tokens", turn.alias("turn"), F.col("pos").alias("nth")), "id")
    cut = F.when(F.col("tokens") < F.col("whole"), bpe.cut(F.col("content"), F.col("tokens"), vocab)).otherwise(F.col("content")) if vocab else F.col("content")
    order = Window.partitionBy(F.lit(0)).orderBy("turn", "nth")
    return kept.select(F.row_number().over(order).alias("pos"), "id", "tokens", cut.alias("content"))


def as_json(found: DataFrame, model: str, budget: int, tier: str | None = None, limit: int = 256, top: int = 8, has_symbols: bool = True) -> DataFrame:
    """One row, json: the envelope of context()'s rows; without any it says ok false and why."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "id", "tokens", "content"))), lambda x: F.struct(x["id"].alias("id"), x["tokens"].alias("tokens"), x["content"].alias("content")))
    one = found.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"), listed.alias("items"))
    empty = F.size("items") == 0
    reason = F.when(empty, "no_matches" if has_symbols else "no_symbols")
    return one.select(F.to_json(F.struct(F.lit(model).alias("model"), F.lit(budget).alias("budget"), "total_tokens", F.lit(tier).alias("tier"), F.lit(limit).alias("effective_limit"), F.lit(top).alias("effective_top_per_query"), "items", F.when(empty, F.lit(False)).alias("ok"), reason.alias("reason"))).alias("json"))


def as_text(found: DataFrame) -> DataFrame:
    """One row, text: the contents in order."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "content")))
    return found.agg(F.array_join(F.transform(rows, lambda x: x["content"]), "").alias("text"))


def as_text_or_error(found: DataFrame, has_symbols: bool = True) -> DataFrame:
    """as_text(), or error_text() where there is nothing."""
    return as_text(found).select(F.when(F.col("text") == "", error_text(has_symbols)).otherwise(F.col("text")).alias("text"))


def write_chunks(chunks: DataFrame, path: str) -> None:
    """chunks (chunk_id, symbol_path, source_file, start_line, end_line, token_count, content): texts by chunk below path/chunks, and path/manifest as JSON lines."""
    named = chunks.withColumn("file", F.format_string("chunk_%03d.txt", "chunk_id"))
    named.select("file", F.col("content").alias("value")).write.mode("overwrite").partitionBy("file").text(f"{path}/chunks")
    write_manifest(chunks, path)


def write_manifest(chunks: DataFrame, path: str) -> DataFrame:
    """Writes path/manifest of write_chunks() and reads chunk_id, file and token_count back."""
    named = chunks.withColumn("file", F.format_string("chunk_%03d.txt", "chunk_id"))
    named.select("chunk_id", "file", "symbol_path", "source_file", "start_line", "end_line", "token_count").write.mode("overwrite").json(f"{path}/manifest")
    return chunks.sparkSession.read.schema("chunk_id long, file string, token_count long").json(f"{path}/manifest")


def symbol_chunks(symbols: DataFrame, files: DataFrame, most: int, overlap: int = 128, vocab: str = bpe.VOCAB) -> DataFrame:
    """(file, chunk_id, symbol_path, start_line, end_line, token_count, content) of each file's symbols in order.

    Symbols share a chunk, a line break between them, while the sum of their tokens is at most `most`; one that is longer is
    split into windows of tokens. A file without symbols is split so itself, as a whole. A file's chunks are made by one task.
    """
    spans = symbols.select("file", "byte_start", "byte_end", "start_line", "end_line", "qualified_name")
    texts = spans.join(files.select("file", "content"), "file").withColumn("body", F.coalesce(X.byte_slice(F.col("content"), F.col("byte_start"), F.col("byte_end")), F.array_join(F.slice(X.lines(F.col("content")), F.col("start_line").cast("int"), (F.col("end_line") - F.col("start_line") + 1).cast("int")), "\n"))).drop("content")
    order = Window.partitionBy("file").orderBy("byte_start", "qualified_name")
    counted = lineage.cut(texts.withColumn("tokens", bpe.token_count(F.col("body"), vocab)).withColumn("nth", F.row_number().over(order)))
    small, bodies = fit.greedy_pack_breaking(counted, most, "file", "nth"), counted.drop("tokens")
    shared = small.where("not big").join(bodies, ["file", "nth"]).groupBy("file", "pack").agg(F.array_sort(F.collect_list(F.struct("nth", "qualified_name", "body"))).alias("rows"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"))
    join = lambda field, sep: F.array_join(F.transform("rows", lambda r: r[field]), sep)
    shared = shared.select("file", "pack", F.lit(0).alias("part"), join("qualified_name", ", ").alias("symbol_path"), "start_line", "end_line", join("body", "\n").alias("content"))
    shared = shared.withColumn("token_count", bpe.token_count(F.col("content"), vocab))
    parts = lambda df: df.select("*", F.posexplode(bpe.windows(F.col("content"), most, overlap, vocab)).alias("i", "w"))
    big = small.where("big").join(bodies.withColumnRenamed("body", "content"), ["file", "nth"])
    big = parts(big).select("file", "pack", (F.col("i") + 1).alias("part"), F.format_string("%s[part_%d]", "qualified_name", F.col("i") + 1).alias("symbol_path"), "start_line", "end_line", F.col("w.content").alias("content"), F.col("w.tokens").alias("token_count"))
    bare = files.select("file", "content").join(spans.select("file").distinct(), "file", "left_anti")
    bare = parts(bare).select("file", F.lit(0).cast("long").alias("pack"), F.col("i").alias("part"), F.format_string("chunk_%d", F.col("i") + 1).alias("symbol_path"), F.lit(0).cast("long").alias("start_line"), F.lit(0).cast("long").alias("end_line"), F.col("w.content").alias("content"), F.col("w.tokens").alias("token_count"))
    cols = ["file", "pack", "part", "symbol_path", "start_line", "end_line", "token_count", "content"]
    every = shared.select(*cols).unionByName(big.select(*cols)).unionByName(bare.select(*cols))
    return every.withColumn("chunk_id", F.row_number().over(Window.partitionBy("file").orderBy("pack", "part"))).select("file", "chunk_id", *cols[3:])
