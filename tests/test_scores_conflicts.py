import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions import exprs as X
from spanloom.operators import govern

THREE = "é\n<<<<<<< HEAD\r\nx\r\n||||||| b\nz\n=======\ny\n>>>>>>> t\nmid\n<<<<<<<\n<<<<<<< again\n=======\nq\n>>>>>>>"


def test_conflicts_are_spliced(spark):
    files = spark.createDataFrame([("f", THREE), ("none", "a\n======="), ("n", None), ("e", "")], "file string, content string")
    blocks = govern.conflict_blocks(files)
    got = blocks.orderBy("block").collect()
    assert [(r.file, r.ours, r.base, r.theirs) for r in got] == [("f", "x\r\n", "z\n", "y\n"), ("f", "<<<<<<< again\n", None, "q\n")]
    assert [THREE.encode()[r.byte_start : r.byte_end].decode() for r in got] == [THREE[2 : THREE.index("mid")], THREE[THREE.index("mid") + 4 :]]
    for strategy, text, left in (("ours", "é\nx\r\nmid\n<<<<<<< again\n", 0), ("theirs", "é\ny\nmid\nq\n", 0), ("base", "é\nz\n" + THREE[THREE.index("mid") :], 1)):
        done = govern.resolve(blocks, strategy)
        assert [(r.file, bytes(r.content).decode()) for r in govern.splice(files, done).collect()] == [("f", text)]
        assert [tuple(r) for r in govern.conflict_summary(done).collect()] == [("f", 2, 2 - left, left)]
    assert govern.splice(files, govern.resolve(blocks, "interactive")).isEmpty()
    smart = govern.resolve(govern.conflict_scores(blocks), "smart").collect()
    assert [(r.strategy, r.auto_applied) for r in smart] == [("interactive", False)] * 2
    with pytest.raises(ValueError):
        govern.resolve(blocks, "other")


def _fuzzy(p, t):
    if not p or not t:
        return 0.0
    at = run = best = 0
    for c in t:
        if at == len(p):
            break
        run = run + 1 if p[at] == c else 0
        at += p[at] == c
        best = max(best, run)
    n = len(p.encode())
    return min(at / n + 0.3 * best / n, 1.0)


def test_fuzzy(spark):
    rng = random.Random(3)
    pairs = [("".join(rng.choice("abé") for _ in range(rng.randrange(5))), "".join(rng.choice("abé_") for _ in range(rng.randrange(9)))) for _ in range(200)]
    rows = spark.createDataFrame(pairs, "p string, t string").select("p", "t", X.fuzzy_score(F.col("p"), F.col("t")).alias("s")).collect()
    assert all(abs(r.s - _fuzzy(r.p, r.t)) < 1e-6 for r in rows)


def test_symbol_scores(spark):
    df = spark.createDataFrame([("function", "public", "src/core/a.rs", 10, "parse"), ("struct", None, "src/core/b.rs", 1, "Parser"), ("module", "public", "tests/x.rs", 1, "reparse"), ("class", "private", "lib/a.py", 1, "zzz"), ("function", None, "main.rs", 1, "xPARSEx")], "kind string, vis string, file string, line int, name string")
    c = F.col
    got = df.select(X.symbol_level(c("kind"), c("vis"), c("file"), "src/core/a.rs").alias("level"), X.symbol_relevance(c("name"), c("name"), F.lit("parse")).alias("rel"), X.symbol_nearness(c("file"), c("line"), "src/core/a.rs", 110).alias("near")).collect()
    assert [r.level for r in got] == [200, 125, 115, 125, 120]
    assert [round(r.rel, 4) for r in got] == [1.0, 0.5, 0.7, 0.0, 0.5]
    assert [round(r.near, 4) for r in got] == [0.9, 0.7, 0.0, 0.0, 0.0]
    assert df.select(X.symbol_nearness(c("file"), c("line")).alias("n")).first().n == 0.5


def _one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(f(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize("text, out", [("  a\n    b\n\n  c", "a\n  b\n\nc"), ("a\n  b\n", "a\n  b\n"), ("\ta\n \tb\n \n", "a\n\tb\n"), ("", "")])
def test_dedented(spark, text, out):
    assert _one(spark, text, X.dedented) == out


@pytest.mark.parametrize("text, out", [("a\n\n \nb\n\n", "a\n\nb\n"), ("", ""), ("a", "a"), ("\n\na", "\na")])
def test_squeezed_blank_lines(spark, text, out):
    assert _one(spark, text, X.squeezed_blank_lines) == out


@pytest.mark.parametrize("spec, out", [("src/lib.rs:!10-40,200+5,9", [(10, 40, True), (200, 204, False), (9, 9, False)]), ("C:\\x.rs:4-2, ", [(2, 4, False)]), ("a:0", None), ("a:", None), ("a", None), (":3", None), ("a:x", None)])
def test_target_spans(spark, spec, out):
    got = _one(spark, spec, X.target_spans)
    assert (got and [tuple(s) for s in got]) == out


def test_snippet(spark):
    row = spark.createDataFrame([("a.py", 1, 2, "x")], "p string, s int, e int, b string")
    make = lambda **o: row.select(X.snippet(F.col("p"), F.col("s"), F.col("e"), F.col("b"), **o).alias("x")).first().x
    assert make(annotate=True) == "```py\n# a.py:1-2\nx\n```" and make(fence=False, annotate=True) == ">>> a.py:1-2\nx" and make(fence=False) == "x"


def _winnow(h, w):
    if not 0 < w <= len(h):
        return []
    at, out = 0, []
    for i in range(len(h) - w + 1):
        if at < i:
            at = max(range(i, i + w), key=lambda j: (-h[j], j))
        elif h[i + w - 1] <= h[at]:
            at = i + w - 1
        out.append(h[at])
    return out


def test_winnowed_and_votes(spark):
    rng = random.Random(7)
    rows = [([rng.randrange(6) for _ in range(rng.randrange(20))],) for _ in range(40)]
    got = spark.createDataFrame(rows, "h array<bigint>").select("h", X.winnowed(F.col("h"), 4).alias("w")).collect()
    assert all(list(r.w) == _winnow(list(r.h), 4) for r in got)
    hashes = [[rng.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (0, 1, 2, 5)]
    bits = lambda hs: sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) >= len(hs))
    got = spark.createDataFrame([(h,) for h in hashes], "h array<bigint>").select("h", X.voted_bits(F.col("h")).alias("v")).collect()
    assert all(r.v & (1 << 64) - 1 == bits(r.h) for r in got)
