"""Calls near a place, hops from a function, and what nearness in calls is worth.

Input: lines (file, line_no, text). Scans look at a window of lines around an anchor (file, line).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import retrieve

#: Lines looked at on either side for names, for hops, and for the owner of a line; the heaviest weight.
NAME_WINDOW, HOP_WINDOW, OWNER_WINDOW, MOST_WEIGHT = 120, 128, 80, 0.15
DECLARATION = r"fn[ \t]+([A-Za-z_][A-Za-z0-9_]*)[ \t]*\("


@dataclass(frozen=True)
class CallSpec:
    file: str
    line: int
    depth: int = 1
    files_per_hop: int = 20
    edges: int = 500


def parse_spec(text: str | None, file: str | None = None, line: int | None = None) -> CallSpec | None:
    """The spec of key=value words: depth 1 to 6, files_per_hop 1 to 50, edges 50 to 1000, anchor=file:line; None without an anchor.

    Words that are no such thing, and numbers that are none, are passed over.
    """
    bounds, found = {"depth": (1, 6), "files_per_hop": (1, 50), "edges": (50, 1000)}, {}
    for word in (text or "").split():
        key, eq, value = word.partition("=")
        if key in bounds and eq and value.removeprefix("+").isdecimal() and value.isascii() and (key != "depth" or int(value) < 256):
            found[key] = min(max(int(value), bounds[key][0]), bounds[key][1])
        elif key == "anchor" and eq:
            path, colon, number = value.rpartition(":")
            if colon and number.isascii() and number.removeprefix("+").isdecimal():
                file, line = path, int(number)
    return None if file is None or line is None else CallSpec(file, line, **found)


def number_lines(files: DataFrame) -> DataFrame:
    """(file, line_no, text) of files (file, content), counted from 1."""
    each = files.select("file", F.posexplode(X.lines(F.col("content"))).alias("pos", "text"))
    return each.select("file", (F.col("pos") + 1).cast("long").alias("line_no"), "text")


def declared(text: Column) -> Column:
    """The name of the first function that a line declares, null without one."""
    name = F.regexp_extract(text, DECLARATION, 1)
    return F.when(name != "", name)


def owners(lines: DataFrame, points: DataFrame, within: int = OWNER_WINDOW) -> DataFrame:
    """(point_id, owner) of points (point_id, file, line): the last function declared at or above the line, else the first below, both within so many lines.

    A line beyond the file's end counts as its last one.
    """
    last = lines.groupBy("file").agg(F.max("line_no").alias("last"))
    placed = points.join(last, "file").select("file", "point_id", F.greatest(F.least(F.col("line").cast("long"), F.col("last")), F.lit(1)).alias("line_no"))
    kind = points.schema["point_id"].dataType
    rows = lines.select("file", "line_no", F.lit(0).alias("turn"), F.lit(None).cast(kind).alias("point_id"), declared(F.col("text")).alias("name")).where("name is not null")
    rows = rows.unionByName(placed.select("file", "line_no", F.lit(1).alias("turn"), "point_id", F.lit(None).cast("string").alias("name")))
    # on the point's own line a declaration is above it, and would be found there first
    found = retrieve.owner_asof(rows, "file", ["line_no", "turn"], F.col("turn") == 0, F.col("name"), within)
    return points.select("point_id").join(found.where("turn = 1").select("point_id", "owner"), "point_id", "left")


def calls_near(lines: DataFrame, points: DataFrame, window: int = HOP_WINDOW) -> DataFrame:
    """(point_id, name): the distinct names called within `window` lines of each point (point_id, file, line)."""
    last = lines.groupBy("file").agg(F.max("line_no").alias("last"))
    placed = points.join(last, "file").select("file", "point_id", F.greatest(F.least(F.col("line").cast("long"), F.col("last")), F.lit(1)).alias("at"))
    called = retrieve.calls(lines.select("file", F.col("line_no").alias("line"), "text")).distinct()
    # blocks of as many lines as the window: a point's neighbours are in its own block and the next ones
    size = window + 1
    blocks = placed.withColumn("block", F.explode(F.array(*[F.floor(F.col("at") / size) + d for d in (-1, 0, 1)])))
    near = called.withColumn("block", F.floor(F.col("line") / size)).join(blocks, ["file", "block"]).where(F.abs(F.col("line") - F.col("at")) <= window)
    return near.select("point_id", "name").distinct()


def call_names(lines: DataFrame, spec: CallSpec) -> DataFrame:
    """(name): what is called around the spec's anchor, in order of name up to its edges; none where no function owns the anchor.

    All hops look at the same window, so those after the first find nothing new.
    """
    point = lines.sparkSession.createDataFrame([(0, spec.file, spec.line)], "point_id int, file string, line long")
    owned = owners(lines, point).where("owner is not null").select("point_id")
    return calls_near(lines, point, NAME_WINDOW).join(owned, "point_id", "left_semi").select("name").orderBy("name").limit(spec.edges)


def hop_map(lines: DataFrame, points: DataFrame, depth: int = 2) -> DataFrame:
    """(point_id, name, hop): 0 for the function that owns each point, 1 for those called around it; none without an owner."""
    own = owners(lines, points).where("owner is not null")
    first = own.select("point_id", F.col("owner").alias("name"), F.lit(0).alias("hop"))
    if depth < 1:
        return first
    called = calls_near(lines, points).join(own.select("point_id"), "point_id", "left_semi").withColumn("hop", F.lit(1))
    return first.unionByName(called).groupBy("point_id", "name").agg(F.min("hop").alias("hop"))


def call_score(hop: Column, weight: float = 0.12) -> Column:
    """1 / (1 + hop) of the weight, which is 0 to 0.15, in single precision; 0 where there is no hop."""
    f = lambda x: F.lit(x).cast("float")
    return F.coalesce(((f(1.0) / (f(1.0) + hop.cast("float"))).cast("float") * f(min(max(weight, 0.0), MOST_WEIGHT))).cast("float"), f(0.0))


def raised_by_calls(items: DataFrame, lines: DataFrame, file: str, line: int, weight: float = 0.12) -> DataFrame:
    """items (id, file, start, level, ...) whose first line's function is the anchor's, or is called around it, at a higher level."""
    spark = items.sparkSession
    anchor = spark.createDataFrame([(0, file, line)], "point_id int, file string, line long")
    hops = hop_map(lines, anchor).select(F.col("name").alias("owner"), "hop")
    owned = owners(lines, items.where("file is not null").select(F.col("id").alias("point_id"), "file", F.col("start").alias("line"))).withColumnRenamed("point_id", "id")
    near = owned.join(hops, "owner").select("id", call_score(F.col("hop"), weight).alias("__near"))
    f = lambda x: F.lit(x).cast("float")
    level = F.floor(F.least(F.col("level").cast("float") * (f(1.0) + F.coalesce("__near", f(0.0))), f(255.0))).cast("int")
    return items.join(near, "id", "left").withColumn("level", F.when(F.col("__near") > 0, level).otherwise(F.col("level"))).drop("__near")


def augmented(queries: list[str], trait: str | None = None, names: list[str] | None = None) -> list[str]:
    """The user's queries, those of Type::method, and called names; each once, the first place counts."""
    ty, sep, method = (trait or "").partition("::")
    more = [f"trait {ty.strip()}", f"impl {ty.strip()} for", f"{ty.strip()}::{method.strip()}"] if sep and ty.strip() and method.strip() else []
    return list(dict.fromkeys([*queries, *more, *(names or [])]))
