"""Near-duplicates among one request's items: first equal texts, then likeness in words, in bytes, and of long texts in votes.

A request has few items, so one task holds them; corpora go through fit.representatives().
"""

from __future__ import annotations

import re
from functools import cached_property

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bpe
from .edits import text_lines

#: Words whose items stay, the likeness of bytes that is enough, shingles from which votes count, bits they may
#: differ in, and the tokens by which a later item must be shorter to take an earlier one's place.
INTERFACE = r"trait |interface |pub (?:fn|struct|enum) "
BYTE_FACTOR, BYTE_MOST, VOTES_FROM, VOTE_BITS, SHORTER_BY = 0.9, 0.55, 2000, 4, 4


def is_interface(content: Column) -> Column:
    return F.lower(content).rlike(INTERFACE)


def votes_close(a: Column, b: Column, bits: int = VOTE_BITS) -> Column:
    """Whether two words of 64 bits differ in at most so many."""
    return F.bit_count(a.bitwiseXOR(b)) <= bits


def composite(level: Column, relevance: Column, proximity: Column) -> Column:
    """One number that orders priorities: levels before relevance before proximity."""
    return 1000.0 * level + 100.0 * relevance + 10.0 * proximity


def plain(text: str) -> str:
    """Lines without // comments, trimmed, tabs as blanks, those with text joined by a blank."""
    lines = (line.partition("//")[0].strip().replace("\t", " ") for line in text_lines(text))
    return " ".join(x for x in lines if x)


def winnow(h: np.ndarray, window: int) -> set[int]:
    """The least hash of each window, the last of equal ones; a minimum is looked for anew only when the last one has left."""
    at, out = 0, set()
    for last in range(window - 1, len(h)):
        first = last - window + 1
        if at < first:
            at = last - int(np.argmin(h[first : last + 1][::-1]))
        elif h[last] <= h[at]:
            at = last
        out.add(int(h[at]))
    return out


class Text:
    """A text's hashed runs of n words and of n bytes, and what is drawn from them."""

    def __init__(self, content: str, n: int, window: int):
        self.content, self.n, self.window = content, n, window

    @cached_property
    def flat(self) -> str:
        return plain(self.content)

    @cached_property
    def words(self) -> np.ndarray:
        parts = [w.encode() + b"\xff" for w in self.flat.split()]
        return self._hashes([b"".join(parts[i : i + self.n]) for i in range(len(parts) - self.n + 1)])

    @cached_property
    def bytes(self) -> np.ndarray:
        raw = self.flat.encode()
        return self._hashes([raw[i : i + self.n] for i in range(len(raw) - self.n + 1)])

    @staticmethod
    def _hashes(runs: list[bytes]) -> np.ndarray:
        known = {r: xxhash.xxh64_intdigest(r, seed=0) for r in set(runs)}
        return np.array([known[r] for r in runs], np.uint64)

    @cached_property
    def votes(self) -> int:
        bits = np.unpackbits(self.words.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return int(np.packbits(2 * bits.sum(0) >= len(bits), bitorder="little").view("<u8")[0])

    @cached_property
    def prints(self) -> dict[str, set[int] | None]:
        return {k: winnow(h, self.window) if 0 < self.window <= len(h) else None for k, h in (("words", self.words), ("bytes", self.bytes))}


def likeness(a: set, b: set) -> float:
    """Jaccard's; of two empty sets 1."""
    return len(a & b) / len(a | b) if a or b else 1.0


def alike(a: Text, b: Text, threshold: float = 0.7, by_bytes: bool = True) -> bool:
    """Whether runs of words, else of bytes, else the votes of long texts are near enough.

    Long runs are compared in full only if their winnowed hashes are half as like as asked.
    """
    for kind, least in (("words", threshold), ("bytes", min(threshold * BYTE_FACTOR, BYTE_MOST))):
        if kind == "bytes" and not by_bytes:
            continue
        p, q = a.prints[kind], b.prints[kind]
        worth = p is None or q is None or likeness(p, q) >= threshold * 0.5
        if worth and likeness(set(getattr(a, kind).tolist()), set(getattr(b, kind).tolist())) >= least:
            return True
    return min(len(a.words), len(b.words)) > VOTES_FROM and (a.votes ^ b.votes).bit_count() <= VOTE_BITS


def distinct(items: DataFrame, key: str = "bucket", threshold: float = 0.7, n: int = 4, window: int = 64, preserve_interfaces: bool = True, by_bytes: bool = True, swap: bool = False, vocab: str = bpe.VOCAB) -> DataFrame:
    """(key, id) of the items (key, id, content, level, relevance, proximity) of each request that stay.

    In order of priority, then id, an item stays unless its plain text came before or one that stays is alike; items of
    interfaces stay if they are to be preserved. With swap, of two alike items of one priority the one shorter by SHORTER_BY
    tokens stays.
    """
    by, kinds = ["level", "relevance", "proximity"], dict(items.dtypes)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([*by, "id"], ascending=[False, False, False, True], kind="stable")
        seen, kept = set(), []
        for r in rows.itertuples(index=False):
            text = Text(r.content or "", n, window)
            if text.flat in seen:
                continue
            seen.add(text.flat)
            firm = preserve_interfaces and re.search(INTERFACE, text.content.lower())
            twin = None if firm else next((i for i, (_, other) in enumerate(kept) if alike(text, other, threshold, by_bytes)), None)
            if twin is None:
                kept.append((r, text))
            elif swap and all(getattr(r, c) == getattr(kept[twin][0], c) for c in by):
                mine, theirs = (len(bpe.encode(t.content, vocab)) for t in (text, kept[twin][1]))
                if mine + SHORTER_BY <= theirs:
                    kept[twin] = (r, text)
        return pd.DataFrame({key: [getattr(r, key) for r, _ in kept], "id": [r.id for r, _ in kept]})

    return items.select(key, "id", "content", *by).groupBy(key).applyInPandas(fold, f"{key} {kinds[key]}, id {kinds['id']}")
