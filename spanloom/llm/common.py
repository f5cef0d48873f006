"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, object] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where a local session names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if "dir" not in _OWN:
            _OWN["dir"] = tempfile.mkdtemp(prefix="spanloom-")
        found = str(_OWN["dir"])
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below shared_dir() that is deleted when this process ends."""
    app = f"{shared_dir(spark)}/spanloom-{spark.sparkContext.applicationId}"
    if app not in _OWN:
        _OWN[app] = True
        atexit.register(remove, spark, app)
    return f"{app}/{name}-{uuid.uuid4().hex[:12]}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path through Hadoop's file system; a session that has ended already leaves it."""
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # at exit the gateway may be gone
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts the lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    give_back()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(columns: list[str], name: str) -> str:
    """name, with underscores before it until no column has it (Spark's names ignore case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without its columns of these names: an operator's result takes the place of an input column of its name."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all values and their n + 1 offsets; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(column) else np.empty(0, np.uint8)
    return raw, at - at[0]


#: Bytes of text at once where a byte takes some hundred of working memory: a worker's peak counts beside a full heap.
SLICE = 250_000


def slices(batch: pa.RecordBatch, column: str, most: int = 2_000_000):
    """Parts of a batch of about `most` bytes of `column` each; a longer text is a part by itself."""
    i = batch.schema.get_field_index(column)
    values = batch.column(i)
    if not len(values):
        return
    values = values.fill_null("") if values.null_count else values
    yield from parts(batch, np.diff(text_buffers(values)[1]), most)


def parts(batch: pa.RecordBatch, sizes: np.ndarray, most: int):
    """Parts of a batch whose rows' sizes sum to about `most` each; a larger row is a part by itself."""
    part = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)
    give_back()


_TRIM: list = []


def give_back() -> None:
    """Returns freed memory to the system: a worker outlives its task, and what it keeps counts against its executor."""
    if not _TRIM:
        try:
            _TRIM.append(ctypes.CDLL(None).malloc_trim)
        except (OSError, AttributeError):  # another C library
            _TRIM.append(lambda _: 0)
    pa.default_memory_pool().release_unused()
    _TRIM[0](0)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser over uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_B = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B ** i and its inverse, mod 2 ** 64, for i < n."""
    if len(_POWERS.get("up", ())) < n:
        m = max(n, 1 << 16)
        for name, b in (("up", _B), ("down", pow(_B, -1, 1 << 64))):
            x = np.full(m, b, np.uint64)
            x[0] = 1
            _POWERS[name] = np.cumprod(x, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rolling polynomial hashes mod 2 ** 64 of values[start:end] for many spans at once; values: uint64, well mixed.

    Long spans can be made to collide whatever the base (Thue-Morse words), so whoever must tell spans apart compares them
    as well, or codes them by exact_codes().
    """
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = powers(len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up, out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[np.minimum(starts, len(values) - 1)]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


BYTE_MIX = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def exact_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number for each of the spans data[offsets[i]:offsets[i + 1]] (bytes), equal for equal bytes, and the distinct spans by number."""
    spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    coded = spans.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
