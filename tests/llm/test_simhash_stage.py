"""The pipeline's stage simhash: links by fingerprints beside the bands, counts of slots without a row a slot."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from spanloom.llm import minhash, simhash


def words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]


def test_fingerprints_link_what_no_band_does(spark, monkeypatch):
    """With no band at all, texts at most two bits apart are still linked if they are alike, and only those."""
    rng = random.Random(3)
    texts = [None, ""]
    for _ in range(10):
        base = words(rng, 400)
        texts += [" ".join(base), " ".join(base).upper(), " ".join(base + words(rng, 1)), " ".join(base[2:]), " ".join(words(rng, 5))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    real = minhash.signatures
    monkeypatch.setattr(minhash, "signatures", lambda *a: real(*a).withColumn("keys", F.array().cast("array<long>")))
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    fp = simhash.fingerprint_batch(pa.array(texts), minhash.WIDTH)
    h, at, _ = minhash.shingle_sets(pa.array(texts))
    sets = [set(h[a:b].tolist()) for a, b in zip(at, at[1:])]
    alike = lambda i, j: sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    near = {(i, j) for i in range(len(texts)) for j in range(i) if np.bitwise_count(fp[i] ^ fp[j]) <= 2 and alike(i, j)}
    assert sum(sets[i] != sets[j] for i, j in near) >= 5
    assert all(found[i] == found[j] for i, j in near)
    assert all((i - 2) // 5 == (c - 2) // 5 for i, c in found.items() if i > 1)


def test_slots_are_counted_in_few_rows(spark, monkeypatch):
    rng = random.Random(4)
    lists = [[rng.getrandbits(63) for _ in range(500)] for _ in range(60)]
    sets = spark.createDataFrame(list(enumerate(lists + lists[:9])), "node long, s array<long>").repartition(3)
    made, frame = [], type(sets)
    real = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, *a: (made.append(self.count()), real(self, *a))[1])
    got = minhash._counts(sets)
    each = np.array([x for s in lists + lists[:9] for x in s], np.int64)
    assert (got == np.bincount(minhash._slots(each), minlength=minhash.SLOTS)).all()
    assert made and made[0] <= 3 * minhash.PARTS < len(np.unique(each))
