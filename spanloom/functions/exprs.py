"""Column expressions: lines, tokens, paths, scores. Each takes and returns Columns and stays in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[A-Za-z0-9_]+|[^ \t\n\r\f\x0bA-Za-z0-9_]"
#: Extensions and their languages.
LANGUAGES = {"rs": "rust", "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "c": "c", "h": "c", "cpp": "cpp", "cxx": "cpp", "cc": "cpp", "hpp": "cpp"}
#: The weight of a signal by its severity.
SEVERITY_WEIGHT = {"error": 3.0, "warn": 1.5, "info": 1.0}
SEVERITY_ORDER = {"info": 0, "warn": 1, "error": 2}


def lines(t: Column) -> Column:
    """Lines without their ends; a final line break opens no line, an empty text has none."""
    body = F.regexp_replace(F.regexp_replace(t, "\r\n", "\n"), r"\n\z", "")
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n", -1))


def line_count(t: Column) -> Column:
    return F.when(t == "", 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + F.when(t.endswith("\n"), 0).otherwise(1)).cast("long")


def line_slice(t: Column, first: int, last: int) -> Column:
    """Lines first .. last, counted from 1."""
    return F.array_join(F.slice(lines(t), first, last - first + 1), "\n")


def line_end(t: Column) -> Column:
    """What most lines end with: carriage return and line feed if all breaks are such, else a line feed."""
    feeds = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    pairs = (F.length(t) - F.length(F.replace(t, F.lit("\r\n"), F.lit("")))) / 2
    return F.when((pairs > 0) & (pairs >= feeds), "\r\n").otherwise("\n")


def byte_slice(t: Column, start: Column, end: Column) -> Column:
    """The text of the bytes start .. end - 1; null where they end beyond the text's, or part a character."""
    part = t.cast("binary").substr((start + 1).cast("int"), (end - start).cast("int")).cast("string")
    return F.when((start >= 0) & (start <= end) & (end <= F.octet_length(t)) & F.is_valid_utf8(part), part)


def ascii_lower(t: Column) -> Column:
    return F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def token_count(t: Column) -> Column:
    return F.regexp_count(t, F.lit(TOKEN)).cast("long")


def words(t: Column) -> Column:
    """Runs of ASCII letters and digits, lower-cased."""
    return F.regexp_extract_all(ascii_lower(t), F.lit("[a-z0-9]+"), F.lit(0))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once; inside a lambda an expression would be evaluated for every element."""
    return F.transform(F.array(value), body)[0]


def shingles(w: Column, n: int = 4) -> Column:
    """Distinct runs of n words; none for fewer words."""
    runs = lambda v: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(v) - n + 1), lambda i: F.array_join(F.slice(v, i, n), " ")))
    return let(w, lambda v: F.when(F.size(v) >= n, runs(v)).otherwise(F.array().cast("array<string>")))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def language_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(table, extension(path))


def semantic_score(name: Column, query: Column) -> Column:
    """3 for the same name, 2 for a prefix of two characters or more, 1 for a segment, else 0."""
    n, q = F.lower(name), F.lower(query)
    return F.when(n == q, 3).when((F.length(q) >= 2) & n.startswith(q), 2).when(F.array_contains(F.split(n, "[^A-Za-z0-9]"), q), 1).otherwise(0)


def scope_score(file: Column, scope: Column) -> Column:
    return F.when(scope.isNotNull() & file.startswith(scope), 1).otherwise(0)


def proximity_score(file: Column, line: Column, anchor_file: Column, anchor_line: Column) -> Column:
    """In the anchor's file 2 within 20 lines, 1 within 100 and 3 beyond or without a line; 0 elsewhere."""
    d = F.abs(line - anchor_line)
    return F.when(file != anchor_file, 0).when(anchor_line.isNull(), 3).when(d <= 20, 2).when(d <= 100, 1).otherwise(3)


def distance_to_span(line: Column, start: Column, end: Column) -> Column:
    return F.greatest(start - line, line - end, F.lit(0))


def severity_rank(severity: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY_ORDER.items() for x in kv]), severity)


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITY_ORDER]), rank + 1)


def severity_weight(severity: Column) -> Column:
    return reduce(lambda c, kv: c.when(severity == kv[0], kv[1]), SEVERITY_WEIGHT.items(), F.when(F.lit(False), 0.0)).otherwise(1.0)


def priority_band(level: Column) -> Column:
    return F.when(level >= 200, 2).when(level >= 100, 1).otherwise(0)


def squeezed(t: Column) -> Column:
    """Without // comments and blank lines, each line trimmed, runs of blanks single."""
    kept = F.filter(F.transform(lines(t), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "//.*$", ""), r"(?U)\s+", " "))), lambda x: x != "")
    return F.array_join(kept, " ")


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; two empty ones are equal."""
    both = F.size(F.array_intersect(a, b))
    all_ = F.size(F.array_union(a, b))
    return F.when(all_ == 0, 1.0).otherwise(both / all_)


def _depth(t: Column, opens: str, closes: str) -> Column:
    """(d, ok): how many brackets are open after t, and whether none closed before it opened."""
    turn = lambda x: F.when(x == opens, 1).when(x == closes, -1).otherwise(0)
    step = lambda s, x: F.struct((s["d"] + turn(x)).alias("d"), (s["ok"] & (s["d"] + turn(x) >= 0)).alias("ok"))
    return F.aggregate(F.split(t, ""), F.struct(F.lit(0).alias("d"), F.lit(True).alias("ok")), step)


def balanced(t: Column) -> Column:
    """Brackets of three kinds never close before they open and all close."""
    return reduce(lambda a, b: a & b, [(_depth(t, *pair)["d"] == 0) & _depth(t, *pair)["ok"] for pair in ("()", "[]", "{}")])


def seconds_of(interval: Column) -> Column:
    """Seconds of Ns, Nm, Nh, Nd or Nw; null for anything else."""
    n, unit = F.regexp_extract(interval, r"^(\d+)([smhdw])$", 1), F.regexp_extract(interval, r"^(\d+)([smhdw])$", 2)
    factor = F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400).when(unit == "w", 604800)
    return F.when(n != "", n.cast("long") * factor)


def _pick(test, then, other):
    return F.when(test, then).otherwise(other)


def fuzzy_score(pattern: Column, text: Column) -> Column:
    """How much of pattern comes in order in text: its share, and 0.3 of that of the longest run; 1 at most, single precision.

    Shares are of the pattern's bytes.
    """
    p, n = F.split(pattern, ""), F.octet_length(pattern).cast("float")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s, c):
        done = s["at"] >= F.size(p)
        hit = F.coalesce(F.get(p, s["at"]) == c, F.lit(False)) & ~done
        run = _pick(done, s["run"], _pick(hit, s["run"] + 1, 0))
        return F.struct((s["at"] + hit.cast("int")).alias("at"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    found = F.aggregate(F.split(text, ""), start, step)
    score = let(found, lambda f: F.least((f["at"].cast("float") / n).cast("float") + (f["best"].cast("float") / n).cast("float") * F.lit(0.3).cast("float"), F.lit(1.0).cast("float")))
    return F.when((pattern == "") | (text == ""), F.lit(0.0).cast("float")).otherwise(score.cast("float"))


def symbol_level(kind: Column, visibility: Column, file: Column, anchor: str | None = None, recent: Column | None = None) -> Column:
    """0 to 255: what a symbol is worth for being public, of a kind, in the anchor's file, lately used, or in tests."""
    kinds = F.when(kind == "function", 20).when(kind.isin("class", "struct"), 25).when(kind == "module", 15).otherwise(0)
    near = F.lit(0) if anchor is None else F.when((file == anchor) | file.endswith("/" + anchor), 50).otherwise(0)
    used = F.lit(0) if recent is None else F.when(recent, 20).otherwise(0)
    return F.least(F.lit(100) + F.when(visibility == "public", 30).otherwise(0) + kinds + near + used, F.lit(255)) - F.when(file.contains("test"), 30).otherwise(0)


def symbol_relevance(name: Column, qualified: Column, query: Column) -> Column:
    """1 for the query itself, 0.9 as a prefix, 0.7 within, 0.5 within but for case, else 0.4 of the fuzzy score."""
    either = lambda f: f(name) | f(qualified)
    q = F.lower(query)
    fuzzy = F.greatest(fuzzy_score(q, F.lower(name)), fuzzy_score(q, F.lower(qualified))) * F.lit(0.4).cast("float")
    score = F.when(either(lambda c: c == query), 1.0).when(either(lambda c: c.startswith(query)), 0.9).when(either(lambda c: c.contains(query)), 0.7).when(either(lambda c: F.lower(c).contains(q)), 0.5)
    return F.coalesce(score.cast("float"), fuzzy.cast("float"))


def symbol_nearness(file: Column, line: Column, anchor: str | None = None, anchor_line: int | None = None) -> Column:
    """0.5 without an anchor; in its file 1, less a thousandth a line down to 0.4; in its directory 0.7; else 0.6 of the share of directories in common."""
    if anchor is None:
        return F.lit(0.5).cast("float")
    same = (file == anchor) | file.endswith("/" + anchor)
    here = F.lit(1.0) if anchor_line is None else F.greatest(1.0 - F.least(F.abs(line - anchor_line) / 1000.0, F.lit(0.6)), F.lit(0.4))
    theirs = anchor.split("/")[:-1]
    mine = F.slice(F.split(file, "/"), 1, F.size(F.split(file, "/")) - 1)
    common = reduce(lambda a, b: a + b, [(F.slice(mine, 1, i + 1) == F.array(*[F.lit(x) for x in theirs[: i + 1]])).cast("int") for i in range(len(theirs))], F.lit(0))
    deep = F.greatest(F.size(mine), F.lit(len(theirs)))
    own = F.array(*[F.lit(x) for x in theirs]) if theirs else F.array().cast("array<string>")
    return F.when(same, here).when(mine == own, 0.7).when(deep > 0, common / deep * 0.6).otherwise(0.2).cast("float")


def dedented(t: Column) -> Column:
    """t with the blanks that all its lines with text begin with taken off; a text without any stays as it is."""
    x = lines(t)
    full = F.filter(x, lambda s: ~s.rlike(r"^(?U)\s*$"))
    least = F.array_min(F.transform(full, lambda s: F.length(F.regexp_extract(s, r"^[ \t]*", 0))))
    # as many blanks as that come off a line wherever they stand, as in its indent for lines with text
    cut = lambda k: F.array_join(F.transform(x, lambda s: F.when(F.length(F.regexp_extract(s, r"^[ \t]*", 0)) >= k, s.substr(k + 1, F.length(s))).otherwise(F.regexp_replace(s, r"^[ \t]*", ""))), "\n")
    return F.when(F.coalesce(least, F.lit(0)) == 0, t).otherwise(cut(least))


def squeezed_blank_lines(t: Column) -> Column:
    """Lines with one blank line for each run of them."""
    x = lines(t)
    blank = lambda s: F.coalesce(s.rlike(r"^(?U)\s*$"), F.lit(False))
    return let(x, lambda v: F.array_join(F.filter(v, lambda s, i: ~(blank(s) & (i > 0) & blank(F.get(v, i - 1)))), "\n"))


#: Extensions whose comments begin with #.
HASH_COMMENTS = ("py", "rb", "sh", "bash", "zsh", "yaml", "yml", "toml", "ini")


def snippet(path: Column, start: Column, end: Column, body: Column, fence: bool = True, annotate: bool = False) -> Column:
    """body as a fenced block, or under a >>> line, with its place."""
    ext = F.regexp_extract(path, r"\.([^./]+)$", 1)
    place = F.format_string("%s:%d-%d", path, start, end)
    if not fence:
        return F.concat(F.lit(">>> "), place, F.lit("\n"), body) if annotate else body
    note = F.concat(F.when(ext.isin(*HASH_COMMENTS), "# ").otherwise("// "), place, F.lit("\n")) if annotate else F.lit("")
    return F.concat(F.lit("```"), ext, F.lit("\n"), note, body, F.lit("\n```"))


def target_spans(spec: Column) -> Column:
    """array<struct<start, end, hard>> of path:!A-B,A+N,N (the path ends at the last colon); null where a part is no span."""
    parts = F.filter(F.transform(F.split(F.regexp_extract(spec, r"^.*:([^:]*)$", 1), ","), lambda p: F.trim(p)), lambda p: p != "")
    shape = r"^(!?)\s*\+?(\d+)\s*(?:([-+])\s*(\d+))?$"

    def one(p):
        a, b = (F.regexp_extract(p, shape, i).try_cast("long") for i in (2, 4))
        sign = F.regexp_extract(p, shape, 3)
        last = F.when(sign == "-", b).when(sign == "+", a + F.greatest(b - 1, F.lit(0))).otherwise(a)
        return F.struct(F.least(a, last).alias("start"), F.greatest(a, last).alias("end"), (F.regexp_extract(p, shape, 1) == "!").alias("hard"))

    spans = F.transform(parts, one)
    good = F.forall(parts, lambda p: p.rlike(shape)) & F.forall(spans, lambda s: s["start"] > 0) & (F.size(parts) > 0) & spec.rlike(r"^\s*\S.*:")
    return F.when(good, spans)


def winnowed(hashes: Column, window: int) -> Column:
    """The least hash of each window, the last of equal ones; the first window looks at its two ends only until its least leaves."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<bigint>").alias("out"))

    def step(s, i, h):
        part = F.slice(h, i + 1, window)
        least = F.array_min(part)
        fresh = i + window - F.array_position(F.reverse(part), least).cast("int")
        new = i + window - 1
        at = F.when(s["at"] < i, fresh).when(F.get(h, new) <= F.get(h, s["at"]), new).otherwise(s["at"])
        return let(at, lambda a: F.struct(a.alias("at"), F.concat(s["out"], F.array(F.get(h, a))).alias("out")))

    return F.when(F.size(hashes) < window, F.array().cast("array<bigint>")).otherwise(F.aggregate(F.sequence(F.lit(0), F.size(hashes) - window), start, lambda s, i: step(s, i, hashes))["out"])


def voted_bits(hashes: Column) -> Column:
    """64 bits, each set if at least half of the hashes set it."""
    vote = lambda b: 2 * F.aggregate(hashes, F.lit(0), lambda n, h: n + F.shiftrightunsigned(h, b).bitwiseAND(F.lit(1)).cast("int")) >= F.size(hashes)
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(vote(b), F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")) for b in range(64)])
