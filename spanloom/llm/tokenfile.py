"""Token files: Simple-8b words in frames of whole documents.

A file is a sequence of frames, each closed by MARK. A frame, all little-endian: u64 its bytes without MARK, u32 part and
u32 flags (1: a block has escapes), u64 ids that this part holds before the frame, u64 documents, u64 ids, u64 words;
then i64 document ids, u64 ids of each document (highest bit: the document's id is null), u64 first word of each block,
u64 words. A block is 1024 ids of the frame, the last one fewer, and begins a word, so blocks decode independently.

A word is 4 bits of selector above 60 bits of payload. Selectors 0 to 13 pack COUNTS[s] ids of WIDTHS[s] bits, the first
id lowest; 15 is an escape: the next word holds one raw 64-bit id.

Spark's text writer commits the files: a frame is the value and MARK the line separator, so any store that Spark reaches
will do and a lost executor's half-written file is never seen. A task begins a new file after FILE_FRAMES frames, so a
reader, which takes a file as a whole, never holds more than those.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, slices, stored
from .tokens import SLICE_BYTES, VOCAB, encoder

MARK = "S8TKEND\n"
BLOCK, FRAME_IDS, FILE_FRAMES = 1024, 1 << 18, 32
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
COUNTS = 60 // WIDTHS
ESCAPE = 15
_HEAD = struct.Struct("<QIIQQQQ")


def encode_blocks(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, bool]:
    """Words, the first word of each block, and whether any id was escaped. All blocks advance together."""
    n = len(ids)
    ids = ids.astype(np.uint64)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), False
    pad = -n % block
    m = (n + pad) // block
    bits = np.full(n + pad, 65, np.int8)  # nothing after the last id fits
    bits[:n] = np.maximum(np.ceil(np.log2(ids.astype(np.float64) + 1)), 1)
    big = np.flatnonzero(ids >= np.uint64(1 << 52))  # floats are not exact there
    bits[big] = [int(x).bit_length() for x in ids[big]]
    bits = bits.reshape(m, block)
    choice = np.full((m, block), ESCAPE, np.int8)
    for s in range(len(WIDTHS) - 1, -1, -1):  # the densest selector that the next ids fit
        k, fits = int(COUNTS[s]), bits <= WIDTHS[s]
        ok = np.zeros((m, block), bool)
        if k <= block:
            seen = np.zeros((m, block + 1), np.int32)
            np.cumsum(fits, axis=1, out=seen[:, 1:])
            ok[:, : block - k + 1] = seen[:, k:] - seen[:, : block - k + 1] == k
        choice[ok] = s
    take = np.append(COUNTS, [1, 1])[np.minimum(choice, 15)]
    size = np.full(m, block)
    size[-1] = block - pad
    row, at, hops = np.arange(m), np.zeros(m, np.int64), []
    while len(row):
        c = choice[row, at]
        hops.append((row, at, c))
        at = at + take[row, at]
        on = at < size[row]
        row, at = row[on], at[on]
    rows, ats, sel = (np.concatenate(x) for x in zip(*hops))
    order = np.argsort(rows * block + ats, kind="stable")
    rows, ats, sel = rows[order], ats[order], sel[order].astype(np.int64)
    need = np.where(sel == ESCAPE, 2, 1)
    place = np.cumsum(need) - need
    words = np.zeros(int(need.sum()), np.uint64)
    begin = rows * block + ats
    for s in range(len(WIDTHS)):
        w = np.flatnonzero(sel == s)
        if len(w):
            shift = (np.arange(COUNTS[s]) * WIDTHS[s]).astype(np.uint64)
            packed = np.bitwise_or.reduce(ids[begin[w, None] + np.arange(COUNTS[s])] << shift, axis=1)
            words[place[w]] = packed | np.uint64(s << 60)
    out = np.flatnonzero(sel == ESCAPE)
    words[place[out]] = np.uint64(ESCAPE << 60)
    words[place[out] + 1] = ids[begin[out]]
    return words, place[np.searchsorted(rows, np.arange(m))].astype(np.uint64), bool(len(out))


def decode_blocks(words: np.ndarray, starts: np.ndarray, n: int, escaped: bool) -> np.ndarray:
    """The n ids of encode_blocks()."""
    head = np.ones(len(words), bool)
    if escaped:  # a raw word is no selector; walk the blocks that have one
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(words)]):
            i = int(a)
            while i < int(b):
                if int(words[i]) >> 60 == ESCAPE:
                    head[i + 1] = False
                    i += 1
                i += 1
    at = np.flatnonzero(head)
    sel = (words[at] >> np.uint64(60)).astype(np.int64)
    count = np.append(COUNTS, [1, 1])[np.minimum(sel, 15)]
    place = np.cumsum(count) - count
    if int(count.sum()) != n:
        raise ValueError(f"a frame's words hold {int(count.sum())} ids, its head says {n}")
    out = np.empty(n, np.uint64)
    for s in range(len(WIDTHS)):
        w = np.flatnonzero(sel == s)
        if len(w):
            shift, mask = (np.arange(COUNTS[s]) * WIDTHS[s]).astype(np.uint64), np.uint64((1 << int(WIDTHS[s])) - 1)
            out[place[w, None] + np.arange(COUNTS[s])] = (words[at[w], None] >> shift) & mask
    w = np.flatnonzero(sel == ESCAPE)
    out[place[w]] = words[at[w] + 1]
    return out


def frame(part: int, before: int, doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    words, starts, escaped = encode_blocks(ids)
    null = np.array([d is None for d in doc_ids], np.uint64) << np.uint64(63)
    own = np.array([d or 0 for d in doc_ids], np.int64)
    body = b"".join(x.tobytes() for x in (own, counts.astype(np.uint64) | null, starts, words))
    return _HEAD.pack(_HEAD.size + len(body), part, int(escaped), before, len(own), len(ids), len(words)) + body


def frames(data: bytes) -> Iterator[tuple[int, int, list[int | None], np.ndarray, np.ndarray]]:
    """part, ids of the part before, document ids, their counts, their ids for each frame of a file."""
    at, mark, view = 0, MARK.encode(), memoryview(data)
    while at < len(view):
        size, part, escaped, before, nd, ni, nw = _HEAD.unpack_from(view, at)
        nb = -(-ni // BLOCK)
        if size != _HEAD.size + 8 * (2 * nd + nb + nw) or bytes(view[at + size : at + size + len(mark)]) != mark:
            raise ValueError(f"a damaged frame at byte {at}")
        all_ = np.frombuffer(view, np.uint64, 2 * nd + nb + nw, at + _HEAD.size)
        raw = all_[nd : 2 * nd]
        counts = (raw & np.uint64((1 << 63) - 1)).astype(np.int64)
        doc_ids = [None if x else d for d, x in zip(all_[:nd].view(np.int64).tolist(), (raw >> np.uint64(63)).tolist())]
        yield part, before, doc_ids, counts, decode_blocks(all_[2 * nd + nb :], all_[2 * nd : 2 * nd + nb], ni, bool(escaped))
        at += size + len(mark)


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocab: str = VOCAB, end_id: int = 0, frame_ids: int = FRAME_IDS) -> None:
    """Writes the ids of every whole text, end_id after each, in ascending order of id_col, as files below path.

    A null text is empty, a null id comes first; rows that repeat an id (or lack one) follow a hash of their texts and may
    be in several parts, so that no id binds a task. Whole documents share a frame until it has frame_ids ids; a text of any
    length is one document of one frame. Other columns of docs, whatever their names, are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, enc = TaskContext.get().partitionId(), 0, encoder(vocab)
        docs_, counts_, ids_, held = [], [], [], 0
        for batch in batches:
            for piece in slices(batch, "text", SLICE_BYTES):
                ids, at = enc.encode(piece.column(1).to_pylist(), end_id)
                docs_ += piece.column(0).to_pylist()
                counts_.append(np.diff(at))
                ids_.append(ids)
                held += len(ids)
                if held >= frame_ids:
                    yield pa.RecordBatch.from_arrays([pa.array([frame(part, before, docs_, np.concatenate(counts_), np.concatenate(ids_))], pa.binary())], ["value"])
                    before += held
                    docs_, counts_, ids_, held = [], [], [], 0
        if docs_:
            yield pa.RecordBatch.from_arrays([pa.array([frame(part, before, docs_, np.concatenate(counts_), np.concatenate(ids_))], pa.binary())], ["value"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    sorted_ = slim.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    sorted_.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", MARK).option("maxRecordsPerFile", FILE_FRAMES).text(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, part, part_start, n_tokens, ids_crc32[, ids]) of every document in the files; ids: array of long.

    part_start counts the ids of the same part before the document, ids_crc32 is over little-endian unsigned 32-bit ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                for part, before, doc_ids, counts, ids in frames(data.as_buffer()):
                    at = np.concatenate([[0], np.cumsum(counts)])
                    le = ids.astype("<u4").tobytes()
                    crc = [zlib.crc32(le[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                    cols = [pa.array(doc_ids, pa.int64()), pa.array(np.full(len(counts), part, np.int32)), pa.array(before + at[:-1]), pa.array(counts), pa.array(crc, pa.int64())]
                    if with_ids:
                        cols.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int64))))
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "part", "part_start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    schema = "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def token_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = VOCAB, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Writes token files, reads them back, and returns (doc_id, start, n_tokens, ids_crc32) for every document.

    start counts the ids of all documents before it. Only one total for each part, not for each row, reaches the driver:
    parts are as many as shuffle partitions. An empty table gives no rows; null ids and repeated rows each get theirs.
    """
    spark = docs.sparkSession
    path = path or shared_path(spark, "tokens")
    write_token_files(docs, path, id_col, text_col, vocab, end_id)
    read = stored(read_token_files(spark, path), "token-index")
    total, begins = 0, []
    for part, n in sorted(tuple(r) for r in read.groupBy("part").agg(F.max(F.col("part_start") + F.col("n_tokens"))).collect()):
        begins.append((part, total))
        total += n
    parts = spark.createDataFrame(begins, "part int, begin long")
    return read.join(F.broadcast(parts), "part").select("doc_id", (F.col("begin") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")
