"""Benchmark decontamination by q-gram lemma filtering.

An item of m characters that a text holds with at most k edits shares m + 1 - q (k + 1) q-grams with it whose diagonals
(place in the text less place in the item) lie within k of each other. q-grams of eight characters are hashed and found
over whole texts in numpy; hits are counted in bands of 2 (k + 1) diagonals that overlap by half, so one band holds them
all. A text is swept from its start: bands that lie behind are closed, so what is held does not grow with the text. Bands
that reach the bound are verified by banded alignment, which also sorts out q-grams that only share a hash.

Items too short for the lemma are looked up exactly, as whole words.

Items go out in blocks. If there is more than one, a first pass over the corpus with a bit table of all items' q-grams
keeps the texts that can hold any, and only those are searched block by block.

Texts and items are compared lower-cased, with each run of ASCII characters that are no letters or digits as one blank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, slices, span_hashes, stored, text_buffers

Q, MAX_EDITS, MIN_CHARS, BLOCK_BYTES = 8, 0.10, 32, 4_000_000
_TABLE_BITS, _FILTER_BITS, HITS = 22, 27, 1_000_000
_BASE = 0x9E3779B97F4A7C15
_FOLD = np.full(256, 32, np.uint8)
for _a, _b in ((48, 58), (97, 123), (128, 256)):
    _FOLD[_a:_b] = np.arange(_a, _b)


def normalise(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Folded characters (code points) of all texts, a blank around each, and n + 1 offsets."""
    raw, at = text_buffers(pc.utf8_lower(texts.fill_null("")))
    n = len(at) - 1
    flat = np.full(len(raw) + 2 * n, 32, np.uint8)
    begin = at[:-1] + 2 * np.arange(n)
    body = np.ones(len(flat), bool)
    body[begin] = body[at[1:] + 2 * np.arange(n) + 1] = False
    flat[body] = _FOLD[raw]
    keep = flat != 32
    keep[1:] |= flat[:-1] != 32
    keep[begin] = True
    offsets = np.concatenate([[0], np.cumsum(keep)])[np.append(begin, len(flat))]
    flat = flat[keep]
    if len(raw) and raw.max() >= 128:
        chars = np.concatenate([[0], np.cumsum((flat & 0xC0) != 0x80)])
        return np.frombuffer(flat.tobytes().decode().encode("utf-32-le"), np.uint32), chars[offsets]
    return flat.astype(np.uint32), offsets


def qgrams(x: np.ndarray) -> np.ndarray:
    """A hash of every eight characters of x, polynomial by doubling."""
    if len(x) < Q:
        return np.empty(0, np.uint64)
    out, power = x.astype(np.uint64), _BASE
    for k in (1, 2, 4):
        out = out[:-k] * np.uint64(power) + out[k:]
        power = power * power % (1 << 64)
    return out


def _slot(g: np.ndarray, bits: int = _TABLE_BITS) -> np.ndarray:
    return (g * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)


def banded_distance(item: np.ndarray, text: np.ndarray, shift: int, k: int) -> tuple[int, int]:
    """Least edits, over k is k + 1, that turn item into some part of text on the diagonals shift .. shift + width, and that part's end.

    shift: the first diagonal of the band; the band is as wide as text is longer than item.
    """
    m, width = len(item), len(text) - len(item) + 1
    cost, end = np.arange(0), 0
    cost = np.zeros(width, np.int32)  # of row 0, on each diagonal: a match may begin anywhere
    ramp = np.arange(width, dtype=np.int32)
    for i in range(m):
        diag = cost + (text[i : i + width] != item[i])
        up = np.append(cost[1:] + 1, k + 1)  # the item's character has no partner
        best = np.minimum(diag, up)
        cost = np.minimum(np.minimum.accumulate(best - ramp) + ramp, k + 1).astype(np.int32)  # the text's has none
        if cost.min() > k:
            return k + 1, 0
    end = int(cost.argmin())
    return int(cost[end]), end + m


class ItemIndex:
    """Items of one block with their q-grams; edits is the share of an item's characters that may differ."""

    def __init__(self, ids: list[int | None], texts: list[str | None], edits: float = MAX_EDITS, min_chars: int = MIN_CHARS):
        flat, at = normalise(pa.array(texts, pa.string()))
        self.ids, self.items, grams, item, place = [], [], [], [], []
        for i, d in enumerate(ids):
            x = flat[at[i] + 1 : at[i + 1] - 1] if at[i + 1] - at[i] > 2 else flat[:0]
            if len(x) < max(min_chars, Q):
                continue
            g = qgrams(x)
            item.append(np.full(len(g), len(self.ids), np.int64))
            place.append(np.arange(len(g)))
            grams.append(g)
            self.ids.append(d)
            self.items.append(x)
        size = np.array([len(x) for x in self.items], np.int64)
        self.k = np.minimum((edits * size).astype(np.int64), size // Q - 1)
        self.bound = size + 1 - Q * (self.k + 1)
        g = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        order = np.argsort(g, kind="stable")
        self.grams, first, self.count = np.unique(g[order], return_index=True, return_counts=True)
        self.first = first
        self.item = np.concatenate(item)[order] if item else np.empty(0, np.int64)
        self.place = np.concatenate(place)[order] if place else np.empty(0, np.int64)
        self.words = [x.tobytes().decode("utf-32-le") for x in self.items]
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[_slot(self.grams)] = True

    def search(self, texts: pa.Array) -> list[tuple[int, int | None, int, int, int]]:
        """(row, item id, start, end, edits): the best place of each item in each text, in folded characters."""
        if not self.ids or not len(texts):
            return []
        flat, at = normalise(texts)
        g = qgrams(flat)
        p = np.flatnonzero(self.table[_slot(g)])
        where = np.minimum(np.searchsorted(self.grams, g[p]), len(self.grams) - 1)
        ok = self.grams[where] == g[p]
        p, where = p[ok], where[ok]
        row = np.searchsorted(at, p, "right") - 1
        ok = p + Q <= at[row + 1]
        p, where, row = p[ok], where[ok], row[ok]
        span = np.int64(len(flat) + int(max(len(x) for x in self.items)) + 2)  # more than the bands of a text
        off, many = span // 2, len(self.ids)  # bands before a text's start are negative, few and small
        count = self.count[where]
        hits = np.cumsum(count)
        keys, open_, seen, lo = [], np.empty(0, np.int64), np.empty(0, np.int64), 0
        size = np.array([len(x) for x in self.items], np.int64)
        while lo < len(p):  # so many hits at a time
            hi = max(int(np.searchsorted(hits, (hits[lo - 1] if lo else 0) + HITS, "right")), lo + 1)
            w, c = where[lo:hi], count[lo:hi]
            post = np.repeat(self.first[w] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))
            item = self.item[post]
            band = (np.repeat(p[lo:hi] - at[row[lo:hi]], c) - self.place[post]) // (self.k[item] + 1)
            base = (np.repeat(row[lo:hi], c) * many + item) * span + off + band
            u, n = np.unique(np.concatenate([base, base - 1]), return_counts=True)
            if len(open_):
                u, back = np.unique(np.concatenate([open_, u]), return_inverse=True)
                n = np.bincount(back, weights=np.concatenate([seen, n])).astype(np.int64)
            i = (u // span) % many
            if hi < len(p):  # a band goes on while its last place is ahead
                on = at[u // span // many] + (u % span - off + 2) * (self.k[i] + 1) + size[i] >= p[hi]
                open_, seen = u[on], n[on]
                u, n, i = u[~on], n[~on], i[~on]
            keys.append(u[n >= self.bound[i]])
            lo = hi
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        for key in sorted(np.concatenate(keys).tolist()) if keys else []:
            r, i, band = key // int(span) // many, key // int(span) % many, key % int(span) - int(off)
            if (r, i) in found and found[r, i][0] == 0:  # bands are in order, so no later one is better
                continue
            k, x = int(self.k[i]), self.items[i]
            a = int(at[r]) + band * (k + 1) - k
            b = int(at[r]) + (band + 2) * (k + 1) + len(x) + k
            a, b = max(a, int(at[r])), min(b, int(at[r + 1]))
            text = flat[a:b]
            exact = text.tobytes().decode("utf-32-le").find(self.words[i])
            if exact >= 0:
                best = (0, a - int(at[r]) + exact, a - int(at[r]) + exact + len(x))
            else:
                if len(text) < len(x):
                    text = np.append(text, np.zeros(len(x) - len(text), np.uint32))
                text = np.concatenate([np.zeros(k, np.uint32), text, np.zeros(k, np.uint32)])  # the band may hang over
                d, end = banded_distance(x, text, 0, k)
                if d > k:
                    continue
                end = min(a - int(at[r]) - k + end, int(at[r + 1] - at[r]))
                best = (d, max(end - len(x), 0), end)
            if (r, i) not in found or best < found[r, i]:
                found[r, i] = best
        return [(r, self.ids[i], s, e, d) for (r, i), (d, s, e) in sorted(found.items())]


class ShortItems:
    """The items that ItemIndex leaves out for their length; they match whole words without an edit."""

    def __init__(self, ids: list[int | None], texts: list[str | None], min_chars: int = MIN_CHARS):
        flat, at = normalise(pa.array(texts, pa.string()))
        self.by_size: dict[int, dict[bytes, list[int | None]]] = {}
        for i, d in enumerate(ids):
            x = flat[at[i] : at[i + 1]].tobytes().decode("utf-32-le").strip(" ")
            if 0 < len(x) < max(min_chars, Q):
                self.by_size.setdefault(len(x) + 2, {}).setdefault(f" {x} ".encode("utf-32-le"), []).append(d)
        self.hashes = {n: np.unique(self._hashes(mix(np.frombuffer(b"".join(x), np.uint32)), np.arange(len(x)) * n, n)) for n, x in self.by_size.items()}

    @staticmethod
    def _hashes(mixed: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        return span_hashes(mixed, starts, starts + size)

    def search(self, texts: pa.Array) -> list[tuple[int, int | None, int, int, int]]:
        """(row, item id, start, end, edits) as ItemIndex.search() gives them: each item's first place in each text."""
        if not self.by_size or not len(texts):
            return []
        flat, at = normalise(texts)
        mixed, blank = mix(flat), np.flatnonzero(flat == 32)
        row = np.searchsorted(at, blank, "right") - 1
        found: dict[tuple[int, int, bytes], tuple[int, int]] = {}
        for size, items in self.by_size.items():
            ok = blank + size <= at[row + 1]
            p, r = blank[ok], row[ok]
            ok = flat[p + size - 1] == 32  # a word ends there
            p, r = p[ok], r[ok]
            hit = np.isin(self._hashes(mixed, p, size), self.hashes[size])
            for a, b in zip(p[hit].tolist(), r[hit].tolist()):
                x = flat[a : a + size].tobytes()
                if x in items:
                    start = a - int(at[b]) + 1
                    found.setdefault((b, size, x), (start, start + size - 2))
        return sorted(((b, d, s, e, 0) for (b, size, x), (s, e) in found.items() for d in self.by_size[size][x]), key=lambda m: (m[0], m[2], m[3]))


class AnyItem:
    """A bit table of all items' q-grams: which texts can hold an item at all, whatever the number of items."""

    def __init__(self, edits: float, min_chars: int):
        self.edits, self.min_chars, self.least, self.window = edits, min_chars, None, 0
        self.bits, self.short = np.zeros(1 << (_FILTER_BITS - 3), np.uint8), []

    def add(self, ids: list, texts: list[str]) -> None:
        one = ItemIndex(ids, texts, self.edits, self.min_chars)
        slot = _slot(one.grams, _FILTER_BITS)
        np.bitwise_or.at(self.bits, slot >> np.uint64(3), (1 << (slot & np.uint64(7))).astype(np.uint8))
        if len(one.ids):
            self.least = min(int(one.bound.min()), self.least or 1 << 62)
            self.window = max(self.window, max(len(x) + 2 * int(k) + 2 for x, k in zip(one.items, one.k)))
        flat, at = normalise(pa.array(texts, pa.string()))
        self.short += [t for t, n in zip(texts, np.diff(at).tolist()) if n - 2 < max(self.min_chars, Q)]

    def holds(self, texts: pa.Array) -> np.ndarray:
        """Whether each text has as many q-grams of items as any match needs, as near each other, or a short item."""
        out = np.zeros(len(texts), bool)
        if not len(texts):
            return out
        if self.least is not None:
            flat, at = normalise(texts)
            slot = _slot(qgrams(flat), _FILTER_BITS)
            p = np.flatnonzero(self.bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)
            if len(p) >= max(self.least, 1):
                j = np.arange(len(p) - max(self.least, 1) + 1)
                near = p[j + max(self.least, 1) - 1] - p[j] <= self.window
                out[np.searchsorted(at, p[j[near]], "right") - 1] = True
                out[np.searchsorted(at, p[j[near] + max(self.least, 1) - 1], "right") - 1] = True
        if self.short:
            if not hasattr(self, "shorts"):
                self.shorts = ShortItems([0] * len(self.short), self.short, self.min_chars)
            out[[m[0] for m in self.shorts.search(texts)]] = True
        return out


def item_blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", block_bytes: int | None = None) -> Iterator[tuple[list, list]]:
    """The items in blocks of at most block_bytes (BLOCK_BYTES; a longer item is a block); the driver holds one at a time."""
    ids, texts, held, block_bytes = [], [], 0, block_bytes or BLOCK_BYTES
    for r in benchmark.select(F.col(item_col).cast("long"), F.col(text_col).cast("string")).where(F.col(text_col).isNotNull()).toLocalIterator():
        size = len(r[1].encode())
        if ids and held + size > block_bytes:
            yield ids, texts
            ids, texts, held = [], [], 0
        ids.append(r[0])
        texts.append(r[1])
        held += size
    if ids:
        yield ids, texts


def _any_item(benchmark: DataFrame, item_col: str, item_text: str, edits: float, min_chars: int) -> tuple[AnyItem | None, tuple[list, list] | None]:
    """The table of all items if they need more than one block, and the first block."""
    first, table = None, None
    for block in item_blocks(benchmark, item_col, item_text):
        if first is None:
            first = block
            continue
        if table is None:
            table = AnyItem(edits, min_chars)
            table.add(*first)
        table.add(*block)
    return table, first


def _holding(df: DataFrame, text_col: str, table: AnyItem, wanted: bool) -> DataFrame:
    """The rows of df that may hold an item, or those that can't."""
    sent, at, schema = df.sparkSession.sparkContext.broadcast(table), df.columns.index(text_col), df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, schema.names[at], 1_000_000):
                yield part.filter(pa.array(sent.value.holds(part.column(at)) == wanted))

    return df.mapInArrow(run, schema)


def _search(slim: DataFrame, block: tuple[list, list], edits: float, min_chars: int) -> DataFrame:
    sent = slim.sparkSession.sparkContext.broadcast((*block, edits, min_chars))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, short = ItemIndex(*sent.value), ShortItems(*sent.value[:2], sent.value[3])
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                got = index.search(part.column(1)) + short.search(part.column(1))
                if got:
                    r, item, a, b, d = zip(*got)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(r)), *(pa.array(x, pa.int64()) for x in (item, a, b, d))], ["doc_id", "item_id", "start", "end", "edits"])

    return slim.mapInArrow(run, _FOUND)


_FOUND = "doc_id long, item_id long, start long, end long, edits long"


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", edits: float = MAX_EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, item_id, start, end, edits) for every item that a text holds with at most edits * its length edits.

    start and end count characters of the folded text. Items of fewer than min_chars folded characters match whole words
    without an edit. Null items and those that fold to nothing match nothing; nor do null and empty texts. Texts of any length
    are searched whole. Repeated rows and repeated items each give their rows; an empty table on either side gives none. Other
    columns, whatever their names, are not read.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    table, first = _any_item(benchmark, item_col, item_text, edits, min_chars)
    if first is None:
        return docs.sparkSession.createDataFrame([], _FOUND)
    if table is None:
        return _search(slim, first, edits, min_chars)
    some, out = stored(_holding(slim, "text", table, True), "holding"), None
    for block in item_blocks(benchmark, item_col, item_text):
        part = stored(_search(some, block, edits, min_chars), "found")  # a block is gone before the next is sent
        out = part if out is None else out.unionByName(part)
    return out


def drop_matching(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", edits: float = MAX_EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs without the rows whose text holds an item, as matches() finds them; all other rows and columns stay as they are."""
    table, first = _any_item(benchmark, item_col, item_text, edits, min_chars)
    if first is None:
        return docs
    if table is None:
        return _without(docs, text_col, first, edits, min_chars)
    some = stored(_holding(docs, text_col, table, True), "holding")
    for block in item_blocks(benchmark, item_col, item_text):
        some = stored(_without(some, text_col, block, edits, min_chars), "left")
    return _holding(docs, text_col, table, False).unionByName(some)


def _without(docs: DataFrame, text_col: str, block: tuple[list, list], edits: float, min_chars: int) -> DataFrame:
    sent, at, schema = docs.sparkSession.sparkContext.broadcast((*block, edits, min_chars)), docs.columns.index(text_col), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, short = ItemIndex(*sent.value), ShortItems(*sent.value[:2], sent.value[3])
        for batch in batches:
            for part in slices(batch, text_col, 1_000_000):
                keep = np.ones(part.num_rows, bool)
                keep[[m[0] for m in index.search(part.column(at)) + short.search(part.column(at))]] = False
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, schema)
