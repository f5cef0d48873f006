import random
import re

import pyarrow as pa

from spanloom.llm import decontam


def fold(t):
    return " " + re.sub(r"[^a-z0-9]+", " ", (t or "").lower()).strip() + " "


def test_short_items_match_whole_words():
    rng = random.Random(9)
    items = ["a", "b c", "Short one!", "", None, "--", "b  C", "x" * 31, "y" * 32]
    texts = [None, "", "a", "ba ab", "shortone", "the short, ONE.", "x" * 31, "x" * 32, "y" * 32, *[" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 5))) for _ in range(200)]]
    got = decontam.ShortItems(list(range(9)), items).search(pa.array(texts))
    expected = {(r, i) for r, t in enumerate(texts) for i, x in enumerate(items) if 2 < len(fold(x)) < 34 and fold(x) in fold(t)}
    assert sorted((r, i) for r, i, *_ in got) == sorted(expected) and len(expected) > 100
    assert all(d == 0 and fold(texts[r])[s:e] == fold(items[i]).strip() for r, i, s, e, d in got if fold(texts[r])[1:2] != " " and texts[r][:1].isalnum())


def test_documents_with_short_items_are_dropped(spark):
    docs = spark.createDataFrame([(1, "Says: hello, World."), (2, "hello worlds"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(5, "Hello world"), (6, None)], "item_id long, text string")
    assert [tuple(r) for r in decontam.matches(docs, bench).collect()] == [(1, 5, 6, 17, 0)]
    assert sorted(r.doc_id for r in decontam.drop_matching(docs, bench).collect()) == [2, 3]
