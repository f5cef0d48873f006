"""Column expressions over paths, places, targets and byte offsets of lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import exprs as X


def _long(c: Column) -> Column:
    """A plain unsigned number; null for anything else."""
    return F.when(c.rlike(r"^\+?\d+$"), F.ltrim(c, F.lit("+"))).try_cast("long")


def resolved(path: Column, root: str) -> Column:
    """path below root, unless it is absolute."""
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def relative(path: Column, root: str) -> Column:
    """path as seen from root; one outside of it stays absolute."""
    base = root.rstrip("/") + "/"
    full = resolved(path, root)
    return F.when(full.startswith(base), full.substr(len(base) + 1, 1 << 30)).otherwise(full)


def same_file(a: Column, b: Column, root: str) -> Column:
    """Whether two paths name one file below root; links are not followed, as files are no local ones."""
    plain = lambda p: F.regexp_replace(relative(p, root), r"(^|/)\./", "$1")
    return plain(a) == plain(b)


def in_folder_of(path: Column, anchor: str | None, root: str) -> Column:
    """Whether path lies in, or below, the anchor's folder and is another file."""
    if anchor is None:
        return F.lit(False)
    folder = anchor.rpartition("/")[0]
    inside = F.lit(True) if not folder else relative(path, root).startswith(relative(F.lit(folder), root)) & (F.concat(relative(path, root), F.lit("/")).startswith(F.concat(relative(F.lit(folder), root), F.lit("/"))))
    return inside & ~same_file(path, F.lit(anchor), root)


def item_place(item_id: Column) -> Column:
    """struct(file, start, end) of file:start-end, split at the last colon; null where there are no such numbers."""
    file = F.regexp_extract(item_id, r"(?s)^(.*):[^:]*$", 1)
    part = F.regexp_extract(item_id, r"(?s)^.*:([^:]*)$", 1)
    start, end = _long(F.regexp_extract(part, r"^([^-]*)-", 1)), _long(F.regexp_extract(part, r"^[^-]*-(.*)$", 1))
    return F.when(start.isNotNull() & end.isNotNull(), F.struct(file.alias("file"), start.alias("start"), end.alias("end")))


def place(text: Column) -> Column:
    """struct(file, line) of file:line, split at the last colon; null where the line is no number."""
    line = _long(F.regexp_extract(text, r"(?s)^.*:([^:]*)$", 1))
    return F.when(line.isNotNull(), F.struct(F.regexp_extract(text, r"(?s)^(.*):[^:]*$", 1).alias("file"), line.alias("line")))


def trait_queries(text: Column) -> Column:
    """The three queries of Type::method, an empty array where either is missing."""
    both = F.regexp_extract(text, r"(?s)^(.*?)::", 1), F.regexp_extract(text, r"(?s)^.*?::(.*)$", 1)
    ty, method = (F.regexp_replace(c, r"(?U)^\s+|\s+$", "") for c in both)
    some = F.array(F.concat(F.lit("trait "), ty), F.concat(F.lit("impl "), ty, F.lit(" for")), F.concat(ty, F.lit("::"), method))
    return F.when(text.contains("::") & (ty != "") & (method != ""), some).otherwise(F.array().cast("array<string>"))


def repo_relative(path: Column) -> Column:
    """path without . components and double slashes; null where it is absolute, empty, or climbs out."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    bad = path.startswith("/") | F.exists(parts, lambda p: p == "..") | (F.size(parts) == 0)
    return F.when(~bad, F.array_join(parts, "/"))


def strict_ranges(spec: Column) -> Column:
    """array<struct<start, end>> of path:A-B,N, sorted, those that overlap or touch as one; null where a part is no range."""
    parts = F.filter(F.transform(F.split(F.regexp_extract(spec, r"(?s)^.*:([^:]*)$", 1), ","), lambda p: F.trim(p)), lambda p: p != "")

    def one(p):
        a, b = _long(F.trim(F.regexp_extract(p, r"^([^-]*)", 1))), _long(F.trim(F.regexp_extract(p, r"^[^-]*-(.*)$", 1)))
        return F.struct(a.alias("start"), F.when(p.contains("-"), b).otherwise(a).alias("end"))

    spans = F.transform(parts, one)
    good = F.forall(spans, lambda s: F.coalesce((s["start"] > 0) & (s["end"] >= s["start"]), F.lit(False))) & (F.size(parts) > 0) & spec.contains(":")

    def merge(done, s):
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (s["start"] <= F.try_element_at(done, F.lit(-1))["end"] + 1), joined).otherwise(F.concat(done, F.array(s)))

    return F.when(good, F.aggregate(F.array_sort(spans), F.array().cast("array<struct<start: bigint, end: bigint>>"), merge))


def open_line_count(t: Column) -> Column:
    """Lines where a final line break opens one more; an empty text has none."""
    return F.when(t == "", 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).cast("long")


def _line_starts(t: Column) -> Column:
    """array<struct<at, end>>: the first byte of each line and the byte after its text; ends leave a carriage return out."""
    parts = F.split(t, "\n", -1)

    def step(s, x):
        size = F.octet_length(x).cast("long")
        text = size - F.when((F.get(parts, F.size(s["rows"]) + 1).isNotNull()) & x.endswith("\r"), 1).otherwise(0)
        return F.struct((s["at"] + size + 1).alias("at"), F.concat(s["rows"], F.array(F.struct(s["at"].alias("at"), (s["at"] + text).alias("end")))).alias("rows"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<at: bigint, end: bigint>>").alias("rows"))
    return F.aggregate(parts, start, step)["rows"]


def line_bytes(t: Column, first: Column, last: Column) -> Column:
    """struct(start, end): the bytes of lines first .. last (cut to what there is), without the last one's end; null where there are none."""
    rows = _line_starts(t)
    some = (t != "") & (first > 0) & (first <= last) & (first <= open_line_count(t))
    return F.when(some, X.let(rows, lambda r: F.struct(F.get(r, (first - 1).cast("int"))["at"].alias("start"), F.get(r, (F.least(last, F.size(r)) - 1).cast("int"))["end"].alias("end"))))


def line_of_byte(t: Column, byte: Column) -> Column:
    """The line that a byte lies in, where a line break belongs to the next one; bytes beyond the end count as the end, an empty text gives 0."""
    upto = t.cast("binary").substr(F.lit(1), F.least(byte, F.octet_length(t)).cast("int") + 1)
    text = F.decode(upto, "ISO-8859-1")
    return F.when(t == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")


#: What a request's text begins with, by its kind; {} is its queries.
TEMPLATES = {
    "refactor": "### Task\nRefactor the target symbols: {}.\n\n### Constraints\n- Preserve behavior; improve structure and readability.\n- Keep public APIs stable.\n\n",
    "bugfix": "### Task\nFind and fix the defect related to: {}.\n\n### Notes\n- Write concise changes; avoid unrelated edits.\n\n",
    "feature": "### Task\nImplement the feature touching: {}.\n\n### Acceptance\n- Add or update tests if present.\n\n",
    "freeform": "",
}


def template(kind: str | None, queries: list[str]) -> str:
    """A kind's text; any other is a file's, with line feeds only and one at its end."""
    if kind is None or kind in TEMPLATES:
        return TEMPLATES[kind or "freeform"].replace("{}", ", ".join(queries))
    with open(kind, encoding="utf-8", newline="") as f:
        text = f.read().replace("\r\n", "\n")
    return text if text.endswith("\n") else text + "\n"
