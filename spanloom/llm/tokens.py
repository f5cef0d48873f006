"""Byte-level BPE over whole texts with the tokenizers library.

The library's pre-tokenizer is the costly part, and most pre-tokens repeat. So the boundaries that its pattern sets are
found over code points in numpy, the distinct pre-tokens of a chunk are looked up by hash, and the library's model
encodes only those that are new. Every pre-token is compared with the one that its hash stands for; a text with one that is
another goes through the library as a whole. Texts with code points that Python's Unicode tables do not assign go through the
library as a whole, as its tables may differ there; so do texts that hold an added token, which the library splits off first.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np

from .common import mix, span_hashes

VOCAB = "byte_bpe_50k.json"
CACHE_ENTRIES = 500_000
#: Bytes of text that are encoded at once.
SLICE_BYTES = 1_000_000
_OTHER, _LETTER, _NUMBER, _SPACE, _UNKNOWN = range(5)
#: The code points with Unicode's White_Space property.
_WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_KEPT: dict = {}


def _classes() -> tuple[np.ndarray, np.ndarray]:
    if "classes" not in _KEPT:
        code = {"L": _LETTER, "N": _NUMBER, "Cn": _UNKNOWN, "Cs": _UNKNOWN}
        names = (unicodedata.category(chr(i)) for i in range(0x110000))
        k = np.fromiter((code.get(c, code.get(c[0], _OTHER)) for c in names), np.uint8, 0x110000)
        k[_WHITE] = _SPACE
        _KEPT["classes"] = k, mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return _KEPT["classes"]


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level BPE."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def pretoken_starts(cp: np.ndarray, kind: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of byte-level BPE's usual pattern begin; doc_starts: of the texts that are not empty."""
    n = len(cp)
    first = np.zeros(n + 3, bool)
    first[doc_starts] = True
    st = first.copy()
    st[1:n] |= kind[1:] != kind[:-1]
    # the last character of a run of white space before something else: a blank joins what follows, others stand alone
    b = np.flatnonzero(st[1:n] & ~first[1:n] & (kind[1:] != _SPACE) & (kind[:-1] == _SPACE)) + 1
    st[b - 1] = True
    st[b[cp[b - 1] == 32]] = False
    q = np.flatnonzero(cp[: n - 1] == 39) if n > 1 else np.empty(0, np.int64)
    q = q[st[q] & ~first[q + 1] & (kind[q + 1] == _LETTER)]
    if len(q):
        one = q[np.isin(cp[q + 1], [ord(c) for c in "stmd"])]
        st[one + 1] = False
        st[one + 2] = True
        two = q[(q + 2 < n) & ~first[q + 2]]
        pair = cp[two + 1].astype(np.int64) * 65536 + cp[two + 2]
        two = two[np.isin(pair, [ord(a) * 65536 + ord(c) for a, c in ("re", "ve", "ll")])]
        st[two + 1] = False
        st[two + 3] = True
    return np.flatnonzero(st[:n])


class TokenEncoder:
    """encode() gives the ids that Tokenizer.encode(text, add_special_tokens=False) gives."""

    def __init__(self, vocab: str = VOCAB, cache_entries: int = CACHE_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocab if os.sep in vocab else public_tokenizers.path(vocab))
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.alphabet, self.most = self.tokenizer.model, _byte_alphabet(), cache_entries
        self._clear()

    def _clear(self) -> None:
        self.known, self.at, self.size = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.pool, self.used = np.empty(1 << 20, np.uint32), 0
        self.raw, self.raw_used, self.raw_at, self.raw_size = np.empty(1 << 20, np.uint8), 0, np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self, words: list[bytes], hashes: np.ndarray, where: np.ndarray) -> None:
        one, table = self.model.tokenize, self.alphabet
        got = [[t.id for t in one(w.decode("latin-1").translate(table))] for w in words]
        size, length = (np.fromiter(map(len, x), np.int64, len(x)) for x in (got, words))
        total, bytes_ = int(size.sum()), int(length.sum())
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        while self.raw_used + bytes_ > len(self.raw):
            self.raw = np.concatenate([self.raw, np.empty_like(self.raw)])
        self.pool[self.used : self.used + total] = np.fromiter((i for x in got for i in x), np.uint32, total)
        self.raw[self.raw_used : self.raw_used + bytes_] = np.frombuffer(b"".join(words), np.uint8)
        self.known = np.insert(self.known, where, hashes)
        self.at = np.insert(self.at, where, self.used + np.cumsum(size) - size)
        self.size = np.insert(self.size, where, size)
        self.raw_at = np.insert(self.raw_at, where, self.raw_used + np.cumsum(length) - length)
        self.raw_size = np.insert(self.raw_size, where, length)
        self.used += total
        self.raw_used += bytes_

    def _unlike(self, raw: np.ndarray, at: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Which of the spans of raw that begin at `at` are not the pre-tokens at pos."""
        size = np.diff(np.append(at, len(raw)))
        wrong = np.flatnonzero(self.raw_size[pos] != size)
        if len(wrong):
            pos, own = pos.copy(), size.copy()
            own[wrong] = 0
        else:
            own = size
        begin = np.cumsum(own) - own
        theirs = self.raw[np.repeat(self.raw_at[pos] - begin, own) + np.arange(int(own.sum()))]
        mine = raw if not len(wrong) else raw[np.repeat(at - begin, own) + np.arange(int(own.sum()))]
        off = np.flatnonzero(theirs != mine)
        return np.union1d(wrong, np.searchsorted(begin, off, "right") - 1) if len(off) else wrong

    def encode(self, texts: list[str | None], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """uint32 ids of all texts and their n + 1 offsets; end_id follows each text. A null is empty."""
        texts = [t or "" for t in texts]
        ids, counts = self._encode(texts)
        if end_id is not None:
            ids = np.insert(ids, np.cumsum(counts), np.uint32(end_id))
            counts = counts + 1
        return ids, np.concatenate([[0], np.cumsum(counts)])

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        stops = np.cumsum(size)
        whole = "".join(texts)
        if not whole:
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        classes, mixed = _classes()
        cp = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
        kind = classes[cp]
        odd = np.searchsorted(stops, np.flatnonzero(kind == _UNKNOWN), "right")
        if any(t in whole for t in self.added):
            odd = np.append(odd, [d for d, x in enumerate(texts) if any(t in x for t in self.added)]).astype(np.int64)
        if len(odd):
            return self._apart(texts, np.unique(odd))
        starts = pretoken_starts(cp, kind, (stops - size)[size > 0])
        ends = np.append(starts[1:], len(cp))
        h = span_hashes(mixed[cp], starts, ends)
        if len(self.known) > self.most:
            self._clear()
        u, first, back = np.unique(h, return_index=True, return_inverse=True)
        pos = np.searchsorted(self.known, u)
        new = np.flatnonzero(pos == len(self.known)) if not len(self.known) else np.flatnonzero(self.known[np.minimum(pos, len(self.known) - 1)] != u)
        if len(new):
            self._learn([whole[a:b].encode() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())], u[new], pos[new])
            pos = np.searchsorted(self.known, u)
        pos = pos[back]
        raw = np.frombuffer(whole.encode(), np.uint8)
        bad = self._unlike(raw, starts if len(raw) == len(cp) else np.flatnonzero((raw & 0xC0) != 0x80)[starts], pos)
        if len(bad):
            return self._apart(texts, np.unique(np.searchsorted(stops, starts[bad], "right")))
        n = self.size[pos]
        begin = np.cumsum(n) - n
        ids = self.pool[np.repeat(self.at[pos] - begin, n) + np.arange(int(n.sum()))]
        counts = np.bincount(np.searchsorted(stops, starts, "right"), weights=n, minlength=len(texts)).astype(np.int64)
        return ids, counts


    def _apart(self, texts: list[str], odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """_encode() with the texts numbered odd by the library alone."""
        alone = {int(d): self.tokenizer.encode(texts[d], add_special_tokens=False).ids for d in odd}
        ids, counts = self._encode([("" if d in alone else t) for d, t in enumerate(texts)])
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for d, x in alone.items():
            parts[d], counts[d] = np.array(x, np.uint32), len(x)
        return np.concatenate(parts), counts


def encoder(vocab: str = VOCAB) -> TokenEncoder:
    """This process's encoder for a vocabulary."""
    if vocab not in _KEPT:
        _KEPT[vocab] = TokenEncoder(vocab)
    return _KEPT[vocab]
