"""URL rules: tokens read off expressions, rules without one, rules from a table, the Spark function and its edges."""

import random
import re

import pytest
from pyspark.sql import functions as F

from spanloom.llm import urlfilter


@pytest.mark.parametrize("regex, tokens", [(r"/foo/bar\.", ("foo", "bar")), (r"^abc-", ("abc",)), (r"/foo$", ("foo",)), (r"abc", ()), (r"/foo", ()), (r"/foo?/", ()), (r"(a|/)foo[-.]", ()), (r"/(foo|bar)/", ()), (r"[?&]ref=spam(&|$)", ("ref", "spam")), (r"://([^/?#]*[.-])?x1-", ("x1",)), (r"[^a-z0-9]foo[^a-z0-9]", ("foo",)), (r"[^a-z]foo/", ()), (r"\bfoo\b", ()), (r"/a{2}/", ()), (r"", ())])
def test_tokens_of_an_expression(regex, tokens):
    assert urlfilter.PatternRule(regex).tokens == tokens


def test_index_misses_no_rule():
    rng = random.Random(1)
    parts = ["foo", "bar", "spam", "x1", "-", "/", ".", "?", "=", "&", "://", "a"]
    pieces = ["foo", "bar", "/", "[-.]", r"\.", "(foo|bar)", "(x1)?", "[^/]*", "[a-z]", "$", "^", "(?:-|/)", "a+", "(/|&)", "spam", "x1"]
    urls = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(150)]
    rules = tuple(urlfilter.PatternRule(r, "allow" if n % 2 else "block") for n, r in enumerate("".join(rng.choice(pieces) for _ in range(rng.randint(1, 5))) for _ in range(1500)))
    assert sum(bool(r.tokens) for r in rules) > 30
    f = urlfilter.UrlFilter((), rules)
    for u in urls:
        assert f.matched(u) is next((r for r in rules if re.search(r.regex, u)), None)
    for r in rules:
        for u in urls:
            if re.search(r.regex, u):
                assert set(r.tokens) <= set(re.findall("[a-z0-9]+", u)), (r.regex, u)


def test_judged_table(spark):
    long = "http://a.example.org/" + "p" * 200_000
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://x.NET/"), (None, "http://spam-x.org/fr/"), (5, "http://spam-x.org/de"), (5, "http://spam-x.org/de"), (6, long), (7, "ÄÖ://Ü.net/ß?x#y"), (8, "http://deep.ads-track.com/?q")]
    pages = spark.createDataFrame([(*r, "h", "v", "r") for r in rows], "page_id long, url string, host string, verdict string, rule string").repartition(3)
    got = urlfilter.judge_urls(pages)
    f = urlfilter.UrlFilter()
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(str((i, *f.judge(u))) for i, u in rows)
    assert urlfilter.judge_urls(pages.where(F.lit(False))).count() == 0


def test_rules_from_a_table(spark):
    table = spark.createDataFrame([("host", "bad.org/", "block"), ("pattern", "[?]x=1", "block"), ("pattern", "zz", "block"), ("pattern", "zz", "block")], "kind string, rule string, verdict string")
    hosts, patterns = urlfilter.load_rules(table)
    assert len(patterns) == 2 and not patterns[1].tokens
    pages = spark.createDataFrame([(1, "http://a.bad.org/"), (2, "http://o/?x=1"), (3, "http://azzb/"), (4, "http://o/")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge_urls(pages, host_rules=hosts, pattern_rules=patterns).collect()}
    assert got == {1: ("bad.org/", "block"), 2: (None, "block"), 3: (None, "block"), 4: (None, "allow")}
    assert {r.verdict for r in urlfilter.judge_urls(pages, host_rules=(), pattern_rules=()).collect()} == {"allow"}
