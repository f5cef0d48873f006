"""URL filters: host and path rules, then pattern rules found by their rarest literal token.

A pattern rule is a regular expression. The literal tokens that every match of it contains are read off the parsed
expression, and the rule is indexed by the one that is rarest among the URLs at hand; a URL's tokens fetch candidate rules,
and only those run their expressions. A rule without such a token is tried on every URL. Tokens are maximal runs of
[a-z0-9] in the lower-cased URL.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from re import _constants as rc
from re import _parser as rp

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"[a-z0-9]+")
_INSIDE = {ord(c) for c in "abcdefghijklmnopqrstuvwxyz0123456789"}


@dataclass(frozen=True)
class HostRule:
    verdict: str
    rule: str  # host and path, like example.com/de/


@dataclass(frozen=True)
class PatternRule:
    regex: str  # over the lower-cased URL
    verdict: str = "block"

    @cached_property
    def tokens(self) -> tuple[str, ...]:
        """Whole tokens that every match holds, in order; none if the expression names none for sure."""
        return tuple(dict.fromkeys(_tokens(list(rp.parse(self.regex)))))


def _flat(items: list) -> list:
    """The items in sequence, with groups that are always there taken apart."""
    out = []
    for op, arg in items:
        if op is rc.SUBPATTERN and not arg[1] and not arg[2]:
            out += _flat(list(arg[3]))
        else:
            out.append((op, arg))
    return out


def _edge(op, arg, last: bool) -> tuple[bool, bool]:
    """Whether an item may match nothing, and whether a match of it begins (or ends, if last) outside of tokens, or at the URL's edge."""
    if op is rc.LITERAL:
        return False, arg not in _INSIDE
    if op is rc.IN:
        if arg[0][0] is rc.NEGATE:
            gone = set()
            for kind, x in arg[1:]:
                gone |= {x} if kind is rc.LITERAL else set(range(x[0], x[1] + 1)) if kind is rc.RANGE else set()
            return False, gone >= _INSIDE
        return False, all(kind is rc.LITERAL and x not in _INSIDE or kind is rc.RANGE and not _INSIDE & set(range(x[0], x[1] + 1)) for kind, x in arg)
    if op is rc.AT:
        start = arg in (rc.AT_BEGINNING, rc.AT_BEGINNING_STRING)
        end = arg in (rc.AT_END, rc.AT_END_STRING)
        return not (start and last or end and not last), start and last or end and not last
    if op in (rc.MAX_REPEAT, rc.MIN_REPEAT, rc.POSSESSIVE_REPEAT):
        empty, outside = _edges(list(arg[2]), last)
        return empty or arg[0] == 0, outside
    if op is rc.SUBPATTERN and not arg[1] and not arg[2]:
        return _edges(list(arg[3]), last)
    if op is rc.BRANCH:
        each = [_edges(list(x), last) for x in arg[1]]
        return any(e for e, _ in each), all(o for _, o in each)
    return True, False


def _edges(items: list, last: bool) -> tuple[bool, bool]:
    """_edge() of a sequence."""
    for op, arg in reversed(items) if last else items:
        empty, outside = _edge(op, arg, last)
        if not outside:
            return False, False
        if not empty:
            return False, True
    return True, True


def _tokens(items: list) -> list[str]:
    items, out, i = _flat(items), [], 0
    while i < len(items):
        j = i
        while j < len(items) and items[j][0] is rc.LITERAL and items[j][1] in _INSIDE:
            j += 1
        if j > i:
            before, after = _edges(items[:i], True), _edges(items[j:], False)
            if before == (False, True) and after == (False, True):  # there is something on either side, and no token goes on
                out.append("".join(chr(x) for _, x in items[i:j]))
        i = max(j, i + 1)
    return out


HOST_RULES = (HostRule("block", "net/"), HostRule("allow", "example.net/en/"), HostRule("block", "example.com/de/"), HostRule("allow", "org/fr/"))
PATTERN_RULES = (
    PatternRule(r"://([^/?#]*[.-])?spam-[^/?#.]+\."),
    PatternRule(r"://([^/?#]*[.-])?ads-track\."),
    PatternRule(r"://([^/?#]*\.)?cheap-pills\."),
    PatternRule(r"://([^/?#]*\.)?adult-[^/?#.]+\."),
    PatternRule(r"://([^/?#]*[.-])?(casino)[.-]"),
    PatternRule(r"://([^/?#]*[.-])?(porn)[.-]"),
    PatternRule(r"[?&]ref=spam(&|$)"),
    PatternRule(r"/wp-login\.php"),
)


def load_rules(rules: DataFrame) -> tuple[tuple[HostRule, ...], tuple[PatternRule, ...]]:
    """Rules from a table (kind, rule, verdict): kind host or pattern. The set of rules is one that the driver and tasks hold."""
    rows = sorted((r.kind, r.rule, r.verdict) for r in rules.select("kind", "rule", "verdict").distinct().toLocalIterator())
    return tuple(HostRule(v, r) for k, r, v in rows if k == "host"), tuple(PatternRule(r, v) for k, r, v in rows if k == "pattern")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ://."""
    at = url.find("://") if url else -1
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    tail = rest[end:]
    stop = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), tail[:stop]


class UrlFilter:
    def __init__(self, host_rules=HOST_RULES, pattern_rules=PATTERN_RULES, counts: dict[str, int] | None = None):
        self.by_host: dict[str, list[tuple[str, HostRule]]] = {}
        for r in host_rules:
            host, _, path = r.rule.partition("/")
            self.by_host.setdefault(host, []).append(("/" + path, r))
        counts, self.by_token, self.always = counts or {}, {}, []
        for n, r in enumerate(pattern_rules):
            rarest = min(r.tokens, key=lambda t: (counts.get(t, 0), -len(t), t), default=None)
            (self.always if rarest is None else self.by_token.setdefault(rarest, [])).append((n, re.compile(r.regex), r))

    def rule(self, host: str, path: str) -> HostRule | None:
        """The longest rule that fits: its host is the URL's or a parent of it, and the path begins with the rule's."""
        best, labels = None, host.split(".") if host else []
        for i in range(len(labels)):
            for start, r in self.by_host.get(".".join(labels[i:]), ()):
                if path.startswith(start) and (best is None or len(r.rule) > len(best.rule)):
                    best = r
        return best

    def matched(self, url: str) -> PatternRule | None:
        """The first rule, in the order given, whose expression is found in the URL."""
        low = url.lower()
        candidates = [c for t in dict.fromkeys(_TOKEN.findall(low)) for c in self.by_token.get(t, ())] + self.always
        return next((r for _, p, r in sorted(candidates, key=lambda c: c[0]) if p.search(low)), None)

    def judge(self, url: str | None) -> tuple[str, str, str | None, str]:
        host, path = split_url(url)
        r = self.rule(host, path)
        if r:
            return host, path, r.rule, r.verdict
        found = self.matched(url) if url else None
        return host, path, None, found.verdict if found else "allow"


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", host_rules=HOST_RULES, pattern_rules=PATTERN_RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row. A null or empty URL has an empty host and path and is allowed.

    URLs of any length are judged whole. Repeated rows and null ids each give their row, an empty table none; other columns of
    pages, whatever their names, are not read. Only the counts of the rules' own tokens reach the driver.
    """
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    wanted = sorted({t for r in pattern_rules for t in r.tokens})
    tokens = slim.select(F.explode(F.array_intersect(F.regexp_extract_all(F.lower("url"), F.lit("[a-z0-9]+"), F.lit(0)), F.lit(wanted))).alias("token"))
    counts = {r[0]: r[1] for r in tokens.groupBy("token").count().collect()} if wanted else {}
    table = UrlFilter(host_rules, pattern_rules, counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [table.judge(u) for u in batch.column(1).to_pylist()]
            cols = [pa.array(x, pa.string()) for x in (zip(*got) if got else [[]] * 4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["page_id", "host", "path", "rule", "verdict"])

    return slim.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


#: DuckDB SQL for judge_urls() over pages with the rules above.
ORACLE_SQL = r"""
WITH u AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
r AS (SELECT page_id, url, coalesce(host, '') AS host, coalesce(path, '') AS path FROM h),
m AS (SELECT *, CASE
  WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM r)
SELECT page_id, host, path, rule, CASE rule WHEN 'net/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'example.com/de/' THEN 'block' WHEN 'org/fr/' THEN 'allow'
  ELSE CASE WHEN regexp_matches(lower(url), '://([^/?#]*[.-])?spam-[^/?#.]+\.|://([^/?#]*[.-])?ads-track\.|://([^/?#]*\.)?cheap-pills\.|://([^/?#]*\.)?adult-[^/?#.]+\.|://([^/?#]*[.-])?casino[.-]|://([^/?#]*[.-])?porn[.-]|[?&]ref=spam(&|$)|/wp-login\.php') THEN 'block' ELSE 'allow' END END AS verdict FROM m
"""
