"""What the pipeline's Python workers hold at once grows with a slice of a batch, not with the batch."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from spanloom.llm import langid, minhash, packing, tokens

MB = 1 << 20


@pytest.fixture
def worker(spark, monkeypatch):
    """The function that a worker of mapInArrow gets, as made by f."""

    def get(f, df):
        with monkeypatch.context() as m:
            m.setattr(type(df), "mapInArrow", lambda self, run, schema: run)
            return f(df)

    return get


def texts(size):
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    out = []
    while size > 0:
        out.append(" ".join(rng.choices(vocab, k=300)))
        size -= len(out[-1])
    return out


def peak(run, batch):
    """MB that run takes at most beside its batch, and its rows."""
    list(run(iter([batch.slice(0, 10)])))  # what is kept for all batches
    tracemalloc.start()
    rows = 0
    for out in run(iter([batch])):
        rows += out.num_rows
        del out
    most = tracemalloc.get_traced_memory()[1] / MB
    tracemalloc.stop()
    return most, rows


def docs(spark):
    return spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string")


def test_signatures(spark, worker):
    some = texts(2 * MB)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(some))), pa.array(some), pa.array([""] * len(some))], ["doc_id", "text", "h"])
    most, rows = peak(worker(minhash.signatures, docs(spark)), batch)
    assert rows == len(some) and most < 30


def test_languages(spark, worker):
    some = texts(4 * MB)
    model = langid.LanguageModel(langid.Sparse([np.array([1]), np.array([2])], [np.array([1.0]), np.array([1.0])]), ["en", "fr"])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(some))), pa.array(some), pa.array(["en"] * len(some))], ["doc_id", "text", "lang"])
    most, rows = peak(worker(lambda df: langid.predict(df, model), docs(spark)), batch)
    assert rows == len(some) and most < 30


def test_pieces(spark, worker, monkeypatch):
    some = texts(2 * MB)
    monkeypatch.setattr(packing.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(some))), pa.array(some)], ["doc_id", "text"])
    most, rows = peak(worker(packing.pieces, docs(spark)), batch)
    assert rows >= len(some) and most < 30


def test_first_shingles(spark, worker):
    rng = np.random.default_rng(1)
    n, each = 2000, 500
    at, g = np.arange(0, n * each + 1, each, dtype=np.int32), rng.integers(0, 1 << 40, n * each)
    kept = type("Broadcast", (), {"value": np.full(minhash.SLOTS, 2, np.uint32)})
    one = pa.array(np.arange(n))
    batch = pa.RecordBatch.from_arrays([one, pa.array(np.full(n, each)), one, pa.ListArray.from_arrays(pa.array(at), pa.array(g))], ["node", "n", "c", "s"])
    sets = spark.createDataFrame([(1, 1, 1, [1])], "node long, n long, c long, s array<long>")
    most, rows = peak(worker(lambda df: minhash._first_shingles(df, kept, 0.8), sets), batch)
    assert rows == n * 101 and most < 30


def test_classes_of_code_points():
    kept = dict(tokens._KEPT)
    tokens._KEPT.pop("classes", None)
    tracemalloc.start()
    kind, _ = tokens._classes()
    most = tracemalloc.get_traced_memory()[1] / MB
    tracemalloc.stop()
    tokens._KEPT.update(kept)
    assert most < 40
    assert [kind[ord(c)] for c in "a1 ,"] == [tokens._LETTER, tokens._NUMBER, tokens._SPACE, tokens._OTHER] and kind[0x378] == tokens._UNKNOWN
