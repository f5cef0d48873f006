"""Quality rules from repetition coverage.

Words and lines get numbers by their bytes; n-grams are found by a rolling polynomial hash over the words' numbers in
numpy, and n-grams of one hash are compared word by word, so a collision counts as no repeat. A text's measure is the share
of its word characters inside n-grams, or lines, that occur in it more than once, for several n.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import exact_codes, mix, slices, span_hashes, text_buffers

#: The most of a text's word characters that repeated n-grams may cover, by n, and repeated lines.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT, SYMBOL_LIMIT = 0.20, 0.10
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _repeated(h: np.ndarray, grams: np.ndarray, words: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Whether each k-gram (by its first word's place) occurs in its text more than once; h: their hashes."""
    order = np.argsort(h)
    s, at = h[order], grams[order]
    same = s[1:] == s[:-1]
    pair = np.flatnonzero(same)
    equal = doc[at[pair]] == doc[at[pair + 1]]
    for i in range(k):
        equal &= words[at[pair] + i] == words[at[pair + 1] + i]
    if not equal.all():  # hashes that collide: tell their n-grams apart by the words
        own = np.isin(s, s[pair[~equal]])
        rows = np.stack([doc[at[own]], *(words[at[own] + i] for i in range(k))], 1)
        s = np.where(own, 0, s)
        s[own] = np.unique(rows, axis=0, return_inverse=True)[1].reshape(-1)
        again = np.lexsort((s, own))
        order, s, own = order[again], s[again], own[again]
        same = (s[1:] == s[:-1]) & (own[1:] == own[:-1])
    twice = np.zeros(len(s) + 1, bool)
    twice[1:-1] = same
    out = np.empty(len(s), bool)
    out[order] = twice[1:] | twice[:-1]
    return out


def measure(texts: pa.Array, lengths: tuple[int, ...] = tuple(NGRAM_LIMITS)) -> dict[str, np.ndarray]:
    """Counts of each text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, dup_line_chars, dup_chars_<n>."""
    raw, at = text_buffers(texts)
    n = len(at) - 1
    flat = np.full(len(raw) + n, 10, np.uint8)  # a line break ends every text
    ends = at[1:] + np.arange(n)
    body = np.ones(len(flat), bool)
    body[ends] = False
    flat[body] = raw
    stops = ends + 1
    doc_of = lambda p: np.searchsorted(stops, p, "right")
    count = lambda d, w=None: np.bincount(d, weights=w, minlength=n).astype(np.int64)
    space = _SPACE[flat]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    w0, w1 = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    points = np.concatenate([[0], np.cumsum((flat & 0xC0) != 0x80)])  # code points before each byte
    wd, chars = doc_of(w0), points[w1] - points[w0]
    out = {"n_words": count(wd), "word_chars": count(wd, chars), "n_symbols": count(doc_of(np.flatnonzero(_SYMBOL[flat])))}
    salt = mix(np.arange(1, n + 1, dtype=np.uint64))
    # lines
    l1 = np.flatnonzero(flat == 10)
    l0 = np.concatenate([[0], l1[:-1] + 1]) if len(l1) else l1
    words_in = np.searchsorted(w0, l1) - np.searchsorted(w0, l0)
    line, _ = exact_codes(flat[flat != 10], np.concatenate([[0], np.cumsum(l1 - l0)]))
    l0, l1, line = l0[words_in > 0], l1[words_in > 0], line[words_in > 0]
    ld = doc_of(l0)
    first = np.zeros(len(line), bool)
    first[np.unique(ld * (len(flat) + 1) + line, return_index=True)[1]] = True
    out["n_dup_lines"] = count(ld[~first])
    total = np.concatenate([[0], np.cumsum(chars)])
    a, b = np.searchsorted(w0, l0), np.searchsorted(w0, l1)
    out["dup_line_chars"] = count(ld[~first], (total[b] - total[a])[~first])
    # n-grams
    word, _ = exact_codes(flat[~space], np.concatenate([[0], np.cumsum(w1 - w0)]))
    mixed = mix(word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    for k in (3, *lengths):
        i = np.arange(max(len(word) - k + 1, 0))
        i = i[wd[i] == wd[i + k - 1]] if len(i) else i
        g = i[_repeated(span_hashes(mixed, i, i + k) ^ salt[wd[i]], i, word, wd, k)] if len(i) else i
        step = np.zeros(len(word) + 1, np.int64)
        np.add.at(step, g, 1)
        np.add.at(step, g + k, -1)
        inside = np.cumsum(step[:-1]) > 0
        if k == 3:
            out["n_repeat_words"] = count(wd[inside])
        if k in lengths:
            out[f"dup_chars_{k}"] = count(wd[inside], chars[inside])
    return out


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, counts, base_failed, kept) of every row. A null or empty text has no words, so it fails.

    A text of any length is measured whole, in one task. Repeated rows and null ids each get their row; other columns of docs,
    whatever their names, are not read. An empty table gives no rows.

    base_failed: under MIN_WORDS words, or over MAX_REPEAT_PERCENT of them in repeated 3-word windows. kept is false if
    base_failed, or if repeated n-grams or lines, or symbols for each word, are over their limits.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                m = measure(part.column(1))
                failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
                bad = (m["dup_line_chars"] > LINE_LIMIT * m["word_chars"]) | (m["n_symbols"] > SYMBOL_LIMIT * m["n_words"])
                for k, limit in NGRAM_LIMITS.items():
                    bad |= m[f"dup_chars_{k}"] > limit * m["word_chars"]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(m[c]) for c in names), pa.array(failed), pa.array(~failed & ~bad)], ["doc_id", *names, "base_failed", "kept"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in names) + ", base_failed boolean, kept boolean"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
