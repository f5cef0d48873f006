"""Failure signals in build and test logs, as windows over numbered lines.

Input: (log, line_no, line). A log's lines are ordered by line_no, so each log is one window partition; logs spread.
Output: (log, seq, file, line, symbols, message, severity), seq the line number of the site.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X

FORMATS = ("rustc", "pytest", "jest")
#: Fixed value: a longer message is cut to 157 bytes and an ellipsis.
MAX_MESSAGE, CUT_MESSAGE = 160, 157
_COLUMNS = ("log", "seq", "file", "line", "symbols", "message", "severity")


def number_lines(logs: DataFrame) -> DataFrame:
    """(log, line_no, line) of (log, text), counted from 1."""
    each = logs.select("log", F.posexplode(X.lines(F.col("text"))).alias("pos", "line"))
    return each.select("log", (F.col("pos") + 1).cast("long").alias("line_no"), "line")


def _left(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+", "")


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _number(c: Column) -> Column:
    return F.regexp_extract(c, r"^\+?(\d+)$", 1).try_cast("long")


def truncated(message: Column) -> Column:
    """message, cut where it is over 160 bytes; a character that the cut splits is left out."""
    head = F.make_valid_utf8(F.substring(message.cast("binary"), 1, CUT_MESSAGE).cast("string"))
    return F.when(F.octet_length(message) > MAX_MESSAGE, F.concat(F.regexp_replace(head, "�$", ""), F.lit("…"))).otherwise(message)


def _in_order(lines: DataFrame) -> Window:
    return Window.partitionBy("log").orderBy("line_no")


def rustc(lines: DataFrame) -> DataFrame:
    """Sites after an arrow, with the severity and text of the last header; a blank line or a lone bar ends a header's reach."""
    l = _left(F.col("line"))
    head = F.when(l.rlike(r"^error[\[:]"), "error").when(l.rlike(r"^warning[\[:]"), "warn")
    event = F.when(head.isNotNull(), F.struct(head.alias("severity"), l.alias("message"))).when((l == "|") | (l == ""), F.struct(F.lit("info").alias("severity"), F.lit("").alias("message")))
    reach = F.last(event, ignorenulls=True).over(_in_order(lines).rowsBetween(Window.unboundedPreceding, 0))
    state = lines.withColumn("at", _strip(F.regexp_extract(l, r"^-->(.*)$", 1))).withColumn("state", reach)
    with_column, plain = r"^(.*):\+?(\d+):\+?\d+$", r"^([^:]*):\+?(\d+)$"
    place = lambda i: F.when(F.col("at").rlike(with_column), F.regexp_extract("at", with_column, i)).when(F.col("at").rlike(plain), F.regexp_extract("at", plain, i))
    message = F.coalesce(F.col("state.message"), F.lit(""))
    names = F.filter(F.split(message, r"(?U)\s+"), lambda w: w.rlike(r"^[\p{L}\p{N}_:]+$") & w.rlike(r"\p{L}"))
    out = state.select("log", F.col("line_no").alias("seq"), place(1).alias("file"), place(2).try_cast("long").alias("line"), names.alias("symbols"), truncated(message).alias("message"), F.coalesce(F.col("state.severity"), F.lit("info")).alias("severity"))
    return out.where("line is not null")


def pytest(lines: DataFrame) -> DataFrame:
    """Sites File "path", line N; the message is the next line, or AssertionError where the one after says so."""
    w, l = _in_order(lines), _left(F.col("line"))
    next_ = lambda i: _strip(F.coalesce(F.lead("line", i).over(w), F.lit("")))
    message = F.when(F.lower(next_(2)) == "assertionerror", "AssertionError").when(next_(1) != "", next_(1)).otherwise("Pytest failure")
    site = r'^File "([^"]*)".*?line ([^,]*)'
    name = F.regexp_extract(l, "^.*? in ([^ ]*) ", 1)
    out = lines.withColumn("m", message).where(l.rlike(site)).select("log", F.col("line_no").alias("seq"), F.regexp_extract(l, site, 1).alias("file"), _number(_strip(F.regexp_extract(l, site, 2))).alias("line"), F.when(l.rlike("^.*? in [^ ]* "), F.array(name)).otherwise(F.array().cast("array<string>")).alias("symbols"), truncated(F.col("m")).alias("message"), F.lit("error").alias("severity"))
    return out.where("line is not null")


def jest(lines: DataFrame) -> DataFrame:
    """Sites at name (path:line:column), or without brackets; a place needs a line and a column."""
    l = _left(F.col("line"))
    inner = F.regexp_extract(l, r"^.*\(([^(]*)\)[^()]*$", 1)
    place = _strip(F.when(l.rlike(r"^.*\([^(]*\)[^()]*$"), inner).otherwise(F.substring(l, 4, 1 << 30)))
    site = r"^(.*):\+?(\d+):\+?\d+$"
    name = r"^.*? at ([^ ]*) "
    symbols = F.when(F.col("line").rlike(name), F.array(F.regexp_extract("line", name, 1))).otherwise(F.array().cast("array<string>"))
    found = lines.where(l.startswith("at ")).withColumn("place", place).withColumn("names", symbols)
    out = found.where(F.col("place").rlike(site)).select("log", F.col("line_no").alias("seq"), F.regexp_extract("place", site, 1).alias("file"), F.regexp_extract("place", site, 2).try_cast("long").alias("line"), F.col("names").alias("symbols"), F.lit("Jest test failure").alias("message"), F.lit("error").alias("severity"))
    return out.where("line is not null")


def signals(lines: DataFrame, format: str | None = None) -> DataFrame:
    """The signals of each log: of the format named, else of the first format that finds any in that log."""
    parsers = {"rustc": rustc, "pytest": pytest, "jest": jest}
    if format is not None:
        if format not in parsers:
            raise ValueError(f"Unknown fail-signal format: {format}")
        return parsers[format](lines).select(*_COLUMNS)
    every = None
    for i, name in enumerate(FORMATS):
        one = parsers[name](lines).select(*_COLUMNS, F.lit(i).alias("__format"))
        every = one if every is None else every.unionByName(one)
    first = F.min("__format").over(Window.partitionBy("log"))
    return every.withColumn("__first", first).where("__format = __first").select(*_COLUMNS)


def merged(found: DataFrame) -> DataFrame:
    """(log, file, line, symbols, message, severity): one row for each place, the gravest severity and the first message.

    Symbols of places seen more than once are a sorted set; of others they stay as found.
    """
    some = F.when(F.col("message") != "", F.struct("seq", "message"))
    flat = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "symbols"))), lambda x: x["symbols"]))
    g = found.groupBy("log", "file", "line").agg(F.count("*").alias("n"), flat.alias("s"), X.severity_name(F.max(X.severity_rank(F.col("severity")))).alias("severity"), F.coalesce(F.min(some)["message"], F.lit("")).alias("message"))
    return g.select("log", "file", "line", F.when(F.col("n") > 1, F.array_sort(F.array_distinct("s"))).otherwise(F.col("s")).alias("symbols"), "message", "severity")
