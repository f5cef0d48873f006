"""Words on which any polynomial hash mod 2 ** 64 collides."""

import numpy as np
import pyarrow as pa
import pytest

from spanloom.llm import quality, tokens
from spanloom.llm.common import BYTE_MIX, span_hashes


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


ONE, TWO = thue_morse(1024), thue_morse(1024, "b", "a")


def test_the_words_do_collide():
    x = BYTE_MIX[np.frombuffer((ONE + TWO).encode(), np.uint8)]
    h = span_hashes(x, np.array([0, 1024]), np.array([1024, 2048]))
    assert h[0] == h[1]


def test_tokens_of_colliding_words_are_the_librarys():
    e = tokens.TokenEncoder()
    texts = [ONE, TWO, f"{ONE} {TWO}", ONE]
    ids, at = e.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert ids[at[0] : at[1]].tolist() != ids[at[1] : at[2]].tolist()


def test_colliding_lines_are_no_repeats():
    m = quality.measure(pa.array([f"{ONE}\n{TWO}", f"{ONE}\n{ONE}"]))
    assert m["n_dup_lines"].tolist() == [0, 1] and m["dup_line_chars"].tolist() == [0, 1024]


@pytest.mark.parametrize("k", [3, 5])
def test_ngrams_of_equal_hash_are_compared(k):
    rng = np.random.default_rng(k)
    words, doc = rng.integers(0, 3, 400), np.repeat(np.arange(4), 100)
    i = np.arange(400 - k + 1)
    i = i[doc[i] == doc[i + k - 1]]
    grams = [(doc[a], *words[a : a + k].tolist()) for a in i]
    expected = [grams.count(g) > 1 for g in grams]
    for h in (np.zeros(len(i), np.uint64), rng.integers(0, 9, len(i)).astype(np.uint64) * 0 + (words[i] % 2).astype(np.uint64)):  # all hashes collide, or half of them
        assert quality._repeated(h, i, words, doc, k).tolist() == expected
