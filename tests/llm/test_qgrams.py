"""Decontamination over characters, long texts and several blocks of items, against brute force."""

import random
import resource

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.llm import decontam


def edit_distance_within(p, t):
    """The least edits that turn p into some part of t."""
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def noisy(rng, item, share):
    x = list(item)
    for _ in range(int(share * len(x))):
        x[rng.randrange(len(x))] = rng.choice("щюя")
    return "".join(x)


def test_edits_are_counted_in_characters():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("абвгдежзик") for _ in range(rng.randint(2, 7)))
    items = [" ".join(word() for _ in range(15)) for _ in range(5)]
    texts = [f"{word()} {noisy(rng, items[n % 5], n % 8 * 0.02)} {word()}" for n in range(80)]
    got = {(r, i) for r, i, *_ in decontam.ItemIndex(list(range(5)), items).search(pa.array(texts))}
    expected = {(r, i) for r, t in enumerate(texts) for i, x in enumerate(items) if edit_distance_within(x, t) <= int(0.1 * len(x))}
    assert got == expected and len(got) > 40
    r, i, start, end, edits = decontam.ItemIndex([1], [items[0]]).search(pa.array([f"é {items[0]}"]))[0]
    assert (start, end, edits) == (3, 3 + len(items[0]), 0)


def test_a_long_text_of_one_letter_is_swept(monkeypatch):
    index = decontam.ItemIndex([7], ["a" * 300])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert index.search(pa.array(["b " + "a" * 150_000])) == [(0, 7, 3, 303, 0)]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000  # KB
    rng = random.Random(5)
    items = ["".join(rng.choice("ab") for _ in range(60)) for _ in range(4)]
    texts = ["".join(rng.choice("ab") for _ in range(3000)) + x + "".join(rng.choice("ab") for _ in range(3000)) for x in items] + ["ab" * 2000]
    whole = decontam.ItemIndex(list(range(4)), items).search(pa.array(texts))
    monkeypatch.setattr(decontam, "HITS", 500)
    assert decontam.ItemIndex(list(range(4)), items).search(pa.array(texts)) == whole and {(r, i) for r, i, *_ in whole} >= {(i, i) for i in range(4)}


@pytest.fixture(scope="module")
def many(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    items = [" ".join(word() for _ in range(rng.randint(9, 25))) for _ in range(30)] + ["tiny item", None, ""]
    texts = [None, "", "a tiny item here", "tiny  items"]
    for n in range(200):
        inner = noisy(rng, items[n % 30], n % 7 * 0.02) if n % 3 else word()
        texts.append(f"{' '.join(word() for _ in range(30))} {inner} {' '.join(word() for _ in range(30))}")
    docs = spark.createDataFrame([(i if i % 50 else None, t, "x", 1.0, n) for n, (i, t) in enumerate(enumerate(texts))], "doc_id long, text string, item_id string, edits double, start int")
    return docs.repartition(5), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")


def test_blocks_find_what_one_block_finds(spark, many, monkeypatch):
    docs, items = many
    one = sorted(map(str, decontam.matches(docs, items).collect()))
    left = sorted(map(str, decontam.drop_matching(docs, items).collect()))
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 700)
    assert len(list(decontam.item_blocks(items))) >= 5
    assert sorted(map(str, decontam.matches(docs, items).collect())) == one and len(one) > 80
    kept = decontam.drop_matching(docs, items)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == left
    assert decontam.matches(docs.where(F.lit(False)), items).count() == 0 and decontam.drop_matching(docs, items.where(F.lit(False))).count() == docs.count()


def test_repeated_rows_and_items_each_count(spark):
    item = "one long benchmark item that everyone may find again in a text"
    docs = spark.createDataFrame([(1, f"so {item}.")] * 2, "doc_id long, text string")
    bench = spark.createDataFrame([(5, item), (5, item), (6, item.upper())], "item_id long, text string")
    assert sorted(r.item_id for r in decontam.matches(docs, bench).collect()) == [5, 5, 5, 5, 6, 6]
