"""Functions of source files and what an anchor (file, line) points at."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import callgraph, retrieve, symbols

#: A line that declares something; how far up an anchor looks; lines a function has whose end is not found.
DECLARES = r'^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?(?:const\s+)?(?:extern(?:\s+"[^"]+")?\s+)?(?:fn|trait|impl|mod)\s+[A-Za-z_][A-Za-z0-9_]*'
SEARCH_WINDOW, GUESSED_LINES, CONFIDENCE = 100, 50, 0.9
_NAME = r"[A-Za-z_][A-Za-z0-9_]*"


def declared_name(text: Column) -> Column:
    """The name after the first of fn, trait, mod and impl, tried in that order; an impl's is the type it is for, without path and generics."""
    after = lambda word: F.regexp_extract(text, rf"^.*?{word} [ \t\r\n]*({_NAME})", 1)
    rest = F.regexp_extract(text, r"^.*?impl!?[ \t\r\n]*(.*)$", 1)
    for _ in range(8):  # generics from the innermost out, each leaves a mark
        rest = F.regexp_replace(rest, "<[^<>]*>", "\u0001")
    rest = F.regexp_replace(rest, "^\u0001[ \t]*", "")
    of = F.when(rest.rlike(r"^(?:.*?\s)?for(?:\s|$)"), F.regexp_extract(rest, r"^(?:.*?\s)?for(?:\s+(.*))?$", 1)).otherwise(rest)
    base = F.regexp_extract(of, rf"^\s*[&*]*\s*(?:{_NAME}::)*({_NAME})", 1)
    name = F.when(text.contains("fn "), after("fn")).when(text.contains("trait "), after("trait")).when(text.contains("mod "), after("mod")).when(text.contains("impl"), base)
    return F.when(name != "", name)


def declared_kind(text: Column) -> Column:
    return F.when(text.contains("fn "), "function").when(text.contains("impl "), "impl").when(text.contains("trait "), "trait").when(text.contains("mod "), "module").otherwise("method")


def module_name(file: Column, name: Column) -> Column:
    """name below its file's modules: a Rust file's path, any other file's stem."""
    rust = F.replace(F.regexp_replace(file, r"(/mod)?\.rs$", ""), F.lit("/"), F.lit("::"))
    module = F.when(file.endswith(".rs"), rust).otherwise(F.regexp_extract(file, r"([^/]*?)(?:\.[^./]*)?$", 1))
    return F.when(module == "", name).otherwise(F.concat(module, F.lit("::"), name))


def guessed_end(lines: list[str], start: int) -> int:
    """The first line after start with a brace that leaves none open, counted from start on; start + 50 without one."""
    depth = 0
    for at in range(start, len(lines) + 1):
        for c in lines[at - 1]:
            if c == "{":
                depth += 1
            elif c == "}":
                depth = max(depth - 1, 0)
                if not depth and at > start:
                    return at
    return start + GUESSED_LINES


def functions(files: DataFrame) -> DataFrame:
    """(file, name, qualified_name, start, end, kind, confidence) of files (file, content): a row for each line that declares something.

    end and kind are the parsed symbol's that starts on that line, else guessed. A file is read by one task.
    """
    lines = callgraph.number_lines(files).where(F.col("text").rlike(DECLARES))
    hits = lines.select("file", declared_name(F.col("text")).alias("name"), F.col("line_no").alias("start"), declared_kind(F.col("text")).alias("kind")).where("name is not null")

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, content, starts in zip(batch["file"], batch["content"], batch["starts"]):
                text = content.replace("\r\n", "\n").split("\n")
                text = text[:-1] if text and text[-1] == "" else text
                known = {r[7]: (r[8], r[2]) for r in reversed(symbols.rust_symbols(file, content))} if file.endswith(".rs") else {}
                rows += [(file, int(s), *(known.get(int(s)) or (guessed_end(text, int(s)), None))) for s in starts]
            yield pd.DataFrame(rows, columns=["file", "start", "end", "parsed"])

    starts = hits.groupBy("file").agg(F.array_sort(F.collect_list("start")).alias("starts"))
    found = files.select("file", "content").join(starts, "file").mapInPandas(ends, "file string, start long, end long, parsed string")
    return hits.join(found, ["file", "start"]).select("file", "name", module_name(F.col("file"), F.col("name")).alias("qualified_name"), "start", "end", F.coalesce("parsed", "kind").alias("kind"), F.lit(CONFIDENCE).cast("float").alias("confidence"))


def hints(points: DataFrame, found: DataFrame, files: DataFrame, k: int = 3, within: int = SEARCH_WINDOW) -> DataFrame:
    """(point_id, file, line, status, function, offset, nearest) of points (point_id, file, line).

    status: not_a_file; good with the innermost function around the line that starts at most `within` lines above it; off_by_n
    if what is found does not hold the line; else outside_scope with the k nearest functions of the file.
    """
    at = points.select("point_id", "file", F.col("line").cast("long").alias("line"))
    inside = retrieve.enclosing_span(at, found.select("file", "name", "start", "end"), "file").where("name is not null")
    near = retrieve.nearest_spans(at, found.select("file", "name", "start", "end"), "file", k).groupBy("point_id").agg(F.array_sort(F.collect_list(F.struct("rank", "name", "start", F.col("end"), "distance"))).alias("nearest"))
    there = files.select("file").distinct().withColumn("there", F.lit(True))
    out = at.join(there, "file", "left").join(inside, "point_id", "left").join(near, "point_id", "left")
    hit = F.col("name").isNotNull() & (F.col("line") - F.col("start") <= within)
    more = found.select("file", "name", "start", "qualified_name", "kind", "confidence").dropDuplicates(["file", "name", "start"])
    out = out.join(more, ["file", "name", "start"], "left")
    status = F.when(F.col("there").isNull(), "not_a_file").when(hit & F.col("line").between(F.col("start"), F.col("end")), "good").when(hit, "off_by_n").otherwise("outside_scope")
    shown = F.when(F.col("status").isin("good", "off_by_n"), F.struct("name", "qualified_name", "file", F.col("start").alias("start_line"), F.col("end").alias("end_line"), "kind", "confidence"))
    out = out.withColumn("status", status)
    return out.select("point_id", "file", "line", "status", shown.alias("function"), F.when(shown.isNotNull(), F.col("line") - F.col("start")).alias("offset"), F.when(F.col("status") == "outside_scope", F.coalesce("nearest", F.array().cast("array<struct<rank: int, name: string, start: bigint, end: bigint, distance: bigint>>"))).alias("nearest"))


def why(found: DataFrame) -> DataFrame:
    """(point_id, json) of hints(): what an anchor's status means, in words and factors."""
    status, words = F.col("status"), {"good": "Good", "off_by_n": "OffByN", "outside_scope": "OutsideScope", "not_a_file": "NotAFile"}
    name = F.element_at(F.create_map(*[F.lit(x) for kv in words.items() for x in kv]), status)
    reason = F.when(status == "good", "Line is inside a function").when(status == "off_by_n", F.format_string("Line is %d lines from function start", F.abs("offset"))).when(status == "outside_scope", "Line is not within any function scope").otherwise("File does not exist")
    factor = lambda a, b, c: F.struct(F.lit(a).alias("anchor_validity"), F.lit(b).alias("structural_importance"), F.lit(c).alias("likely_relevance"))
    factors = F.when(status == "good", factor("perfect", "high", 0.95)).when(status == "off_by_n", factor("near_miss", "medium", 0.7)).when(status == "outside_scope", factor("invalid", "low", 0.2))
    missing = status == "not_a_file"
    fields = [F.lit(1).alias("schema_version"), F.concat_ws(":", "file", "line").alias("query"), name.alias("status"), reason.alias("reason"), F.when(~missing, F.col("line")).alias("requested_line"), F.when((status == "off_by_n") | (F.col("offset") != 0), F.col("offset")).alias("offset"), "function", F.col("nearest").alias("nearest_functions"), factors.alias("factors"), F.when(missing, F.col("file")).alias("path")]
    return found.select("point_id", F.to_json(F.struct(*fields)).alias("json"))


