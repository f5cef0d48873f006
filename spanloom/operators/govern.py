"""Sessions, retention, restore, edits and conflicts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X


def sessions(index: DataFrame, engine: str | None = None, only_successful: bool = False, since=None, limit: int | None = None, newest_first: bool = True) -> DataFrame:
    """Finished sessions, filtered and in order of time, then id."""
    out = index.where("done")
    if engine is not None:
        out = out.where(F.lower("engine") == engine.lower())
    if only_successful:
        out = out.where("success")
    if since is not None:
        out = out.where(F.col("ts") >= F.lit(since))
    order = [F.desc("ts"), F.desc("id")] if newest_first else [F.asc("ts"), F.asc("id")]
    return out.orderBy(*order).limit(limit) if limit else out


def resolve_session(index: DataFrame, wanted: str) -> DataFrame:
    """The sessions that latest, last-successful, an id, a suffix of 8 characters or more, or a prefix with - may mean."""
    if wanted in ("latest", "last-successful"):
        return sessions(index, only_successful=wanted != "latest", limit=1)
    hit = F.col("id") == wanted
    if len(wanted) >= 8:
        hit |= F.col("id").endswith(wanted)
    if "-" in wanted:
        hit |= F.col("id").startswith(wanted)
    return index.where(hit)


def the_session(index: DataFrame, wanted: str) -> str:
    """The one id that resolve_session() finds: an exact one, else the only one; raises where there is none, or more."""
    found = sorted(r.id for r in resolve_session(index, wanted).select("id").distinct().limit(20).collect())
    if wanted in found:
        return wanted
    if len(found) != 1:
        raise ValueError(f"ambiguous session {wanted}: {', '.join(found)}" if found else f"no session matches {wanted}")
    return found[0]


def retention(index: DataFrame, keep: int, older_than=None, key: str = "owner") -> DataFrame:
    """Sessions to remove: beyond the newest `keep` of each owner, or older than a time."""
    w = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("id"))
    gone = F.col("nth") > keep
    if older_than is not None:
        gone |= F.col("ts") < F.lit(older_than).cast("timestamp")
    return index.withColumn("nth", F.row_number().over(w)).where(gone)


def restore_conflicts(backup: DataFrame, current: DataFrame) -> DataFrame:
    """(path, state) of files that differ between a backup and the present: changed, missing or new."""
    b, c = backup.select("path", F.col("sum").alias("b")), current.select("path", F.col("sum").alias("c"))
    state = F.when(F.col("c").isNull(), "missing").when(F.col("b").isNull(), "new").when(F.col("b") != F.col("c"), "changed")
    return b.join(c, "path", "full_outer").select("path", state.alias("state")).where("state is not null")


def edit_overlaps(ops: DataFrame) -> DataFrame:
    """(file, id, other): an edit that begins within one before it, in order of start and end."""
    w = Window.partitionBy("file").orderBy("start", "end", "id")
    reach = F.max(F.struct("end", "id")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return ops.withColumn("__r", reach).where(F.col("start") <= F.col("__r.end")).select("file", "id", F.col("__r.id").alias("other"))


#: The marks of a conflict by the section they end, and the section that each opens.
_TURNS = {"": {b"<": "ours"}, "ours": {b"|": "base", b"=": "theirs"}, "base": {b"=": "theirs"}, "theirs": {b">": ""}}
_MARK = re.compile(rb"^(?:<{7,}|\|{7,}|={7,}|>{7,})[^\n]*\n?", re.M)
CONFLICTS = "file string, block int, byte_start long, byte_end long, start_line long, end_line long, ours_meta string, theirs_meta string, ours string, theirs string, base string"


def find_conflicts(file: str, raw: bytes) -> list[tuple]:
    """Rows of CONFLICTS: sections keep their line ends, a mark out of place is text, a block that never closes is none."""
    out, state, began, parts, at = [], "", None, {}, 0
    for m in _MARK.finditer(raw):
        turn = _TURNS[state].get(m[0][:1])
        if turn is None:
            continue
        if state:
            parts[state] = raw[at : m.start()].decode(errors="replace")
        else:
            began, parts = m, {}
        state, at = turn, m.end()
        if not state:
            meta = [x[0].lstrip(x[0][:1]).decode(errors="replace").strip() for x in (began, m)]
            first = raw.count(b"\n", 0, began.start()) + 1
            out.append((file, len(out) + 1, began.start(), m.end(), first, first + raw.count(b"\n", began.start(), m.start()), *meta, parts["ours"], parts["theirs"], parts.get("base")))
    return out


def conflict_blocks(files: DataFrame) -> DataFrame:
    """CONFLICTS of files (file, content); content is text or bytes. A file is read by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for f, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in find_conflicts(f, raw)]
            cols = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    names = [x.split()[0] for x in CONFLICTS.split(", ")]
    types = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[x.split()[1]] for x in CONFLICTS.split(", ")]
    marked = files.select("file", F.col("content").cast("binary").alias("content")).where(F.col("content").isNotNull())
    return marked.mapInArrow(run, CONFLICTS)


def _squash(c):
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def conflict_scores(conflicts: DataFrame) -> DataFrame:
    """conflicts (ours, theirs, base) with confidence in single precision.

    0.40 for texts equal but for blanks, 0.25 where one side is empty or holds the other, 0.20 times the likeness of the
    lines, 0.10 where both sides' brackets balance, 0.05 where the base equals a side; 1 at most.
    """
    f = lambda x: F.lit(x).cast("float")
    a, b = F.col("ours"), F.col("theirs")
    x, y, z = _squash(a), _squash(b), _squash(F.col("base"))
    like = X.jaccard(F.array_distinct(X.lines(a)), F.array_distinct(X.lines(b))).cast("float")
    points = lambda cond, value: F.when(cond, f(value)).otherwise(f(0.0))
    total = points(x == y, 0.40) + points(x.contains(y) | y.contains(x), 0.25) + f(0.20) * like + points(X.balanced(a) & X.balanced(b), 0.10) + points((z == x) | (z == y), 0.05)
    return conflicts.withColumn("confidence", F.least(total, f(1.0)).cast("float"))


def resolve_smart(conflicts: DataFrame, least: float = 0.95) -> DataFrame:
    """conflicts with (strategy, reason, resolved): the first rule that applies to a confident one, else interactive."""
    a, b = F.col("ours"), F.col("theirs")
    x, y = _squash(a), _squash(b)
    la, lb = (F.filter(F.transform(X.lines(c), lambda s: F.trim(s)), lambda s: s != "") for c in (a, b))
    reason = F.when(x == y, "whitespace-only").when(x == "", "addition-only-ours-empty").when(y == "", "addition-only-theirs-empty").when(x.contains(y), "superset-ours-contains-theirs").when(y.contains(x), "superset-theirs-contains-ours").when(~F.arrays_overlap(la, lb), "disjoint-insertions")
    reason = F.when(F.col("confidence") >= F.lit(least).cast("float"), reason)
    text = F.when(reason == "disjoint-insertions", F.concat(a, F.when(a.endswith("\n"), "").otherwise("\n"), b)).when(reason.isin("addition-only-ours-empty", "superset-theirs-contains-ours"), b).when(reason.isNotNull(), a)
    return conflicts.withColumn("reason", reason).withColumn("strategy", F.when(reason.isNull(), "interactive").otherwise("smart")).withColumn("resolved", text)


def resolve(conflicts: DataFrame, strategy: str, least: float = 0.95) -> DataFrame:
    """conflicts (ours, theirs, base, confidence) with (strategy, auto_applied, reason, resolved).

    strategy: ours, theirs or base takes that side; interactive leaves all open; smart takes what resolve_smart() settles.
    A conflict without the side asked for stays open with reason no-base.
    """
    if strategy == "smart":
        return resolve_smart(conflicts, least).withColumn("auto_applied", F.col("resolved").isNotNull())
    if strategy not in ("ours", "theirs", "base", "interactive"):
        raise ValueError(f"no such strategy: {strategy}")
    text = F.lit(None).cast("string") if strategy == "interactive" else F.col(strategy)
    reason = F.when(text.isNotNull(), f"take-{strategy}").when(F.lit(strategy == "base"), "no-base")
    return conflicts.withColumns({"strategy": F.lit(strategy), "reason": reason, "resolved": text, "auto_applied": text.isNotNull()})


def conflict_summary(resolved: DataFrame) -> DataFrame:
    """(file, conflicts, auto_resolved, interactive_required) of resolve()'s rows."""
    return resolved.groupBy("file").agg(F.count("*").alias("conflicts"), F.count_if("auto_applied").alias("auto_resolved"), F.count_if(~F.col("auto_applied")).alias("interactive_required"))


def splice(files: DataFrame, resolved: DataFrame) -> DataFrame:
    """(file, content) of files that have conflicts, as bytes, each settled one replaced by its text; open ones stay as they are."""
    parts = resolved.where("resolved is not null").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("byte_start", "byte_end", "resolved"))).alias("parts"))
    both = files.select("file", F.col("content").cast("binary").alias("content")).join(parts, "file")
    at = lambda i: F.when(i == 0, 0).otherwise(F.element_at("parts", i)["byte_end"])
    cut = lambda first, end: F.col("content").substr((first + 1).cast("int"), (end - first).cast("int"))
    pieces = F.transform("parts", lambda p, i: F.concat(cut(at(i), p["byte_start"]), p["resolved"].cast("binary")))
    tail = cut(F.element_at("parts", -1)["byte_end"], F.octet_length("content"))
    return both.select("file", F.concat(F.aggregate(pieces, F.lit(b""), lambda a, x: F.concat(a, x)), tail).alias("content"))
