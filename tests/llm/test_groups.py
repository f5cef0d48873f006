"""Components of hard shapes, hot anchors, dense groups and the rows that stay."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import minhash, simhash


def shapes(n):
    yield "ascending chain", [(i, i + 1) for i in range(n)]
    yield "star", [(0, i) for i in range(1, n)]
    yield "star at the top", [(i, n) for i in range(n)]
    order = list(range(n))
    random.Random(3).shuffle(order)
    yield "mixed chain", list(zip(order, order[1:]))


@pytest.mark.parametrize("name, edges", list(shapes(1000)))
def test_rounds_grow_with_the_logarithm(spark, monkeypatch, name, edges):
    rounds = []
    real = simhash.stored
    monkeypatch.setattr(simhash, "stored", lambda df, what: (rounds.append(what), real(df, what))[1])
    got = simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert len({r.root for r in got}) == 1 and len(got) == len({x for e in edges for x in e})
    assert rounds.count("jumped") <= 12


def test_components_of_a_random_graph(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(900), rng.randrange(900)) for _ in range(500)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes, root = simhash.local_roots(*(np.array(x) for x in zip(*edges)))
    pairs = {(got[n], r) for n, r in zip(nodes.tolist(), root.tolist()) if n in got}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def crowd(n, seed=1):
    """Fingerprints around one: up to six bits differ."""
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        x = 0x0123456789ABCDEF
        for _ in range(rng.randint(0, 6)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


def roots_by_brute_force(fp):
    x = np.array(fp, np.uint64)
    u, v = [], []
    for lo in range(0, len(x), 500):
        i, j = np.nonzero(np.bitwise_count(x[lo : lo + 500, None] ^ x[None, :]) <= 2)
        u.append(x[i + lo])
        v.append(x[j])
    nodes, root = simhash.local_roots(np.concatenate(u), np.concatenate(v))
    return dict(zip(nodes.tolist(), root.tolist()))


@pytest.mark.parametrize("hot", [None, 50])
def test_hot_anchors_are_dealt_out_without_loss(spark, monkeypatch, hot):
    fp = crowd(3000)
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fp], "fp long")
    if hot:
        monkeypatch.setattr(simhash, "HOT_ANCHOR", hot)
        assert len(simhash.hot_anchors(df)) > 10
    got = {r.node & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in simhash.components(simhash.links(df)).collect()}
    expected = roots_by_brute_force(fp)
    groups = {}
    for x, r in expected.items():
        groups.setdefault(r, set()).add(got.get(x, x))
    assert all(len(g) == 1 for g in groups.values()) and len({g for x in groups.values() for g in x}) == len(groups)


def test_dense_groups_by_neighbours():
    base = np.uint64(7) << np.uint64(40)
    fp = np.unique(base | np.random.default_rng(2).integers(0, 1 << 15, 9000).astype(np.uint64))
    a, b = simhash._near_masks(fp, 0xFFFF, 2), simhash._near_pairs(fp, 2)
    assert [x.tolist() for x in simhash.local_roots(*a)] == [x.tolist() for x in simhash.local_roots(*b)]


ROWS = [(3, "alpha beta gamma delta epsilon zeta"), (3, "zz yy xx ww vv uu"), (1, "zz yy xx ww vv uu"), (7, "one two three four five six"), (7, "six five four three two one"), (9, "nine ten eleven twelve ten two"), (9, "nine ten eleven twelve ten two"), (None, "zz yy xx ww vv uu"), (None, "only here and nowhere else at all"), (None, "only here and nowhere else at all")]


@pytest.mark.parametrize("keep_one", [simhash.keep_one, minhash.keep_one])
def test_one_row_of_each_group_stays(spark, keep_one):
    docs = spark.createDataFrame([(i, t, "h", "x", n) for n, (i, t) in enumerate(ROWS)], "doc_id long, text string, h string, kept_id string, `group` int")
    got = keep_one(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == sorted([(3, ROWS[0][1]), (1, ROWS[1][1]), (7, ROWS[3][1]), (7, ROWS[4][1]), (9, ROWS[5][1]), *((0, t) for i, t in ROWS if i is None)])
    assert keep_one(docs.where(F.lit(False))).count() == 0


@pytest.mark.parametrize("keep_one", [simhash.keep_one, minhash.keep_one])
def test_odd_and_long_texts(spark, keep_one):
    long = " ".join(str(i * i % 9973) for i in range(60_000))
    docs = spark.createDataFrame([(1, None), (2, ""), (3, long), (4, long + " end"), (5, "word")], "doc_id long, text string")
    assert sorted(r.doc_id for r in keep_one(docs).collect()) == [1, 3, 5]
