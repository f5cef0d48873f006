import itertools
import random
import re

import pyarrow as pa

from spanloom.llm import minhash

DATA = "/root/testdata/sf0.01"


def grams(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """Least id of each row's component by all pairs at 0.8 or more."""
    sets = {i: grams(t) for i, t in rows}
    root = {i: i for i in sets}
    by = {}
    for i, s in sets.items():
        for g in s or {()}:
            by.setdefault(g, []).append(i)
    near = {p for x in by.values() for p in itertools.combinations(sorted(x), 2)}
    near = {(a, b) for a, b in near if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    while any(root[a] != root[b] for a, b in near):
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    return root, {(a, b) for a, b in near if sets[a] != sets[b]}


def found(spark, rows):
    return {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_sets():
    texts = [None, "", "a", "a b c d e f", "A  b c d e\nf a b c d e f"]
    h, at, node = minhash.shingle_sets(pa.array(texts))
    assert [b - a for a, b in zip(at, at[1:])] == [len(grams(t)) for t in texts] and node[0] == node[1] != node[2]
    assert minhash.shingle_sets(pa.array([None, ""]))[2].tolist() == [0, 0]


def test_every_similar_pair_is_linked(spark):
    """Chains, a star whose tips are not alike, copies of other case, empty texts and pairs on either side of the threshold."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = [None, "", "one two", "One  two", "one two three"]
    for k in range(12):
        base = [word() for _ in range(rng.randint(40, 200))]
        texts.append(" ".join(base))
        for n in range(8):
            x = list(base)
            for _ in range(n % 5 + 1):
                x[rng.randrange(len(x))] = word()
            texts.append(" ".join(x))
            if k % 3 == 0:
                base = x
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    expected, near = brute(rows)
    assert len(near) > 40 and found(spark, rows) == expected


def test_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    expected, near = brute(rows)
    assert near and found(spark, rows) == expected


def test_pipeline_drops_near_copies(spark):
    import corpus_pipeline as cp

    w = [f"w{i}" for i in range(120)]
    rows = [(1, " ".join(w)), (2, " ".join([*w[:60], "x", *w[61:]])), (3, " ".join(reversed(w))), (None, " ".join(w))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id or 0 for r in dict(cp.STAGES)["simhash"](spark, docs, DATA).collect()) == [0, 1, 3]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_crowded_bands_lose_no_pair(spark, monkeypatch):
    """Texts of one long passage and some words of their own share bands without being alike; among them pairs that are."""
    monkeypatch.setattr(minhash, "CROWD", 3)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage, texts = [word() for _ in range(60)], []
    for k in range(120):
        own = [word() for _ in range(rng.randint(8, 22))]
        texts.append(" ".join(passage + own))
        if k % 10 == 0:
            texts.append(" ".join(passage + own[:-1] + [word()]))
    rows = list(enumerate(texts))
    expected, near = brute(rows)
    assert 12 <= len(near) and len(set(expected.values())) > 60
    seen = []
    real = minhash._rare_pairs
    monkeypatch.setattr(minhash, "_rare_pairs", lambda each, t: (seen.append(each.select("node").distinct().count()), real(each, t))[1])
    assert found(spark, rows) == expected and seen[0] > 20


def test_a_crowd_of_faulty_copies(spark, monkeypatch):
    """One text copied with none to eight words changed: those near it are one group, the others are on their own or meet by chance."""
    monkeypatch.setattr(minhash, "CROWD", 5)
    rng = random.Random(10)
    base = [f"w{i}" for i in range(90)]
    texts = [" ".join(base)]
    for n in range(250):
        x = list(base)
        for at in rng.sample(range(90), rng.randint(1, 8)):
            x[at] = f"v{rng.randrange(40)}"
        texts.append(" ".join(x[rng.randint(0, 3) :]))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    expected, near = brute(rows)
    made = []
    real = minhash._rare_pairs
    monkeypatch.setattr(minhash, "_rare_pairs", lambda each, t: (lambda p: (made.append(p.count()), p)[1])(real(each, t)))
    assert found(spark, rows) == expected and len(near) > 100 and made[0] < 3000
