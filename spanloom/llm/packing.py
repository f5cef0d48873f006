"""Packing documents into sequences by minimum bin slack.

Only longer documents are cut: the first piece takes the remainder, the others are full. Per bin, starting from the
longest length left, a bitset subset-sum program over the lengths still available finds the fullest feasible combination;
it is then removed. Lengths repeat, so the program runs on the histogram of lengths (at most `capacity` counts on the
driver, whatever the corpus) and a combination is applied as often as the counts allow. Rows learn their place from their
rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE, slices, stored
from .tokens import VOCAB, encoder

CAPACITY, END_ID = 1024, 2


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The longest length left and, of the others, the subset that leaves the least slack; as {length: how often}."""
    first = max(counts)
    room, stages, reach = capacity - first, [], 1
    limit = (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, k = min(counts[length] - (length == first), room // length), 1
        while left > 0 and not reach >> room & 1:  # copies in powers of two
            k = min(k, left)
            stages.append((length, k, reach))
            reach |= (reach << (length * k)) & limit
            left -= k
            k *= 2
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, Counter({first: 1})
    for length, k, before in reversed(stages):
        if not before >> total & 1:
            total -= length * k
            out[length] += k
    return dict(out)


def bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank + 1, first sequence, offset, copies in a sequence) for every length in every combination.

    The rank r of a piece of that length puts it into sequence first + (r - first rank) // copies.
    """
    counts, used, out, sequence = {k: v for k, v in counts.items() if v}, Counter(), [], 0
    while counts:
        one = fullest(counts, capacity)
        times = min(counts[x] // k for x, k in one.items())
        offset = 0
        for length in sorted(one, reverse=True):
            k = one[length]
            out.append((length, used[length], used[length] + times * k, sequence, offset, k))
            used[length] += times * k
            counts[length] -= times * k
            if not counts[length]:
                del counts[length]
            offset += length * k
        sequence += times
    return out


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = VOCAB, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, nth[, ids]): nth counts the pieces of a length within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(vocab), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for slice_ in slices(batch, "text", SLICE):
                ids, at = enc.encode(slice_.column(1).to_pylist(), end_id)
                n = np.diff(at)
                k = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), k)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)
                short = n - (k - 1) * capacity
                start = np.where(piece == 0, 0, short[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, short[doc], capacity)
                order = np.argsort(length, kind="stable")
                ranked = np.empty(len(doc), np.int64)
                uniq, count = np.unique(length, return_counts=True)
                ranked[order] = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                nth = ranked + seen[length]
                seen[uniq] += count
                le, a = ids.astype("<u4").tobytes(), at[doc] + start
                cut = [le[4 * x : 4 * (x + y)] for x, y in zip(a.tolist(), length.tolist())]
                cols = [slice_.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in cut], pa.int64()), pa.array(np.full(len(doc), part, np.int32)), pa.array(nth)]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(cut, pa.binary())] * with_ids, ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", *["ids"] * with_ids])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = VOCAB, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) for every piece of every row.

    A null or empty text is its end id alone; one of any length is cut into pieces. Repeated rows and null ids are packed
    each by itself. Other columns of docs, whatever their names, are not read. ids (with_ids=True) are the piece's
    ids as little-endian unsigned 32-bit integers; ids_crc32 is their checksum. An empty table gives no rows.
    """
    cut = stored(pieces(docs, id_col, text_col, vocab, capacity, end_id, with_ids), "pieces")
    held = stored(cut.groupBy("part", "length").count(), "lengths")
    counts = {r[0]: r[1] for r in held.groupBy("length").agg(F.sum("count")).collect()}
    table = np.array(bins(counts, capacity), np.int64).reshape(-1, 6)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    sent = docs.sparkSession.sparkContext.broadcast(table)  # a combination has at most sqrt(2 * capacity) lengths
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = held.select("part", "length", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("earlier"))
    # a merge join at every size: the counts grow with the number of parts
    ranked = cut.join(base.hint("merge"), ["part", "length"]).withColumn("rank", F.col("nth") + F.col("earlier")).drop("part", "nth", "earlier")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = sent.value
        top = max(int(t[:, 2].max()) if len(t) else 1, 1) + 1
        keys = t[:, 0].astype(object) * top + t[:, 1] if top * (capacity + 1) >= 1 << 63 else t[:, 0] * top + t[:, 1]
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            length, rank = (col[n].to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            row = t[np.searchsorted(keys, length * top + rank, "right") - 1]
            gone = rank - row[:, 1]
            col["sequence_id"] = pa.array(row[:, 3] + gone // row[:, 5])
            col["offset"] = pa.array(row[:, 4] + gone % row[:, 5] * length)
            yield pa.RecordBatch.from_arrays([col[n] for n in names], names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids binary" * with_ids
    return ranked.mapInArrow(place, schema)
