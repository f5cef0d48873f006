import math

import duckdb
import pytest
from pyspark.sql import functions as F

from spanloom.functions import exprs as X
from spanloom.operators import fit, govern, retrieve
from spanloom.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize("text, n", [("", 0), ("a", 1), ("fn main() {}\n", 1), ("# Test\nSecond line", 2), ("\n\n", 2)])
def test_line_count(spark, text, n):
    assert one(spark, text, X.line_count) == n


@pytest.mark.parametrize("text, out", [("", []), ("a\r\nb\n", ["a", "b"]), ("a\n\n", ["a", ""]), ("\n", [""])])
def test_lines(spark, text, out):
    assert one(spark, text, X.lines) == out


@pytest.mark.parametrize("path, lang", [("a.rs", "rust"), ("b.py", "python"), ("c.tsx", "typescript"), ("d.jsx", "javascript"), ("e.unknown", None)])
def test_language(spark, path, lang):
    assert one(spark, path, X.language_of) == lang


@pytest.mark.parametrize("text, s", [("7d", 604800), ("24h", 86400), ("-7d", None), ("abc", None), ("7x", None), ("", None)])
def test_intervals(spark, text, s):
    assert one(spark, text, X.seconds_of) == s


@pytest.mark.parametrize("spans, within, out", [([(1, 3), (2, 5), (7, 9)], 0, [(1, 5), (7, 9)]), ([(1, 2), (3, 4)], 0, [(1, 4)]), ([(1, 1), (3, 3), (5, 5)], 0, [(1, 1), (3, 3), (5, 5)])])
def test_coalesce(spark, spans, within, out):
    df = spark.createDataFrame([("f", *s) for s in spans], "k string, start int, end int")
    assert sorted((r.start, r.end) for r in retrieve.coalesce_ranges(df, ["k"], within).collect()) == out


def test_proximity_quirk(spark):
    df = spark.createDataFrame([("f", 10), ("f", 90), ("f", 900), ("g", 10)], "file string, line int")
    got = df.select(X.proximity_score(F.col("file"), F.col("line"), F.lit("f"), F.lit(1)).alias("p")).collect()
    assert [r.p for r in got] == [2, 1, 3, 0]


def test_hops_and_calls(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    assert {(r.node, r.hop) for r in retrieve.hops(e, spark.createDataFrame([("a",)], "node string"), 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    lines = spark.createDataFrame([("f", 1, "if (x) a(b (1))")], "file string, line int, text string")
    assert sorted(r.name for r in retrieve.calls(lines).collect()) == ["a", "b"]


def test_budget_fit_skips_and_goes_on(spark):
    items = spark.createDataFrame([("q", "a", 60, 3, 1.0), ("q", "b", 60, 2, 1.0), ("q", "c", 40, 1, 1.0)], "bucket string, id string, tokens long, level int, relevance double")
    fitted = fit.budget_fit(items, 100)
    assert sorted((r.id, r.pos) for r in fitted.collect()) == [("a", 1), ("c", 2)]
    assert [tuple(r) for r in fit.refusals(items, fitted, 50).collect()] == [("q", "b", "bucket-cap-exceeded")]


def test_conflicts(spark):
    text = "x\n<<<<<<< HEAD\na  b\n=======\na b\n>>>>>>> t\ny\n<<<<<<< open\nz"
    files = spark.createDataFrame([("f", text)], "file string, content string")
    got = govern.conflict_scores(govern.conflict_blocks(files)).collect()
    assert [(r.ours, r.theirs, r.base, r.start_line, r.end_line, r.ours_meta, r.theirs_meta) for r in got] == [("a  b\n", "a b\n", None, 2, 6, "HEAD", "t")]
    assert 0.7 < got[0].confidence <= 1.0
    rows = spark.createDataFrame([("ours", "theirs", "", 0.5), ("a  b", "a b", "", 0.98), ("", "x", "", 0.98), ("a b c", "b", "", 0.98), ("p", "q", "", 0.98)], "ours string, theirs string, base string, confidence float")
    assert [r.reason for r in govern.resolve_smart(rows).collect()] == [None, "whitespace-only", "addition-only-ours-empty", "superset-ours-contains-theirs", "disjoint-insertions"]


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df, expected = catalog.queries()[name](spark, DATA), db.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(expected.columns)
    order = sorted(df.columns)

    def norm(rows, columns):
        plain = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
        return sorted(repr([plain(r[columns.index(c)]) for c in order]) for r in rows)

    assert norm(df.collect(), df.columns) == norm(expected.fetchall(), expected.columns)


def test_flagship_within_budget(spark):
    rows = catalog.context_fit(spark, DATA).groupBy("bucket").agg(F.sum("tokens").alias("s")).collect()
    assert rows and all(r.s <= 3000 for r in rows) and not math.isnan(rows[0].s)
