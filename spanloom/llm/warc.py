"""WARC archives in Zstandard, written by Spark's text writer and read back record by record.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary; each record is a frame of its own,
compressed with it. Frames are written in runs of about RUN_BYTES, each a value of Spark's text writer, which ends every
value with MARK, an empty skippable frame; so the file stays a valid Zstandard stream while Spark's commit protocol does
the writing, on any store. A file takes FILE_RUNS runs, so archives are bounded by bytes. The reader loads the dictionary,
decodes one frame for each record, and validates version, required headers, Content-Length, the record's end and the
payload's digest.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, slices, stored

MARK = "P*M\x18\x00\x00\x00\x00"  # the magic 0x184D2A50 and a length of 0
DICT_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
LEVEL, DICT_BYTES, SAMPLE_RECORDS, SAMPLE_BYTES, MIN_REVISIT = 6, 65_536, 300, 8_000_000, 0
RUN_BYTES, FILE_RUNS = 1_000_000, 64
#: What a header's value cannot hold as it is.
_UNFIT = re.compile(r"[\x00-\x20\x7f-\xa0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
DATE = "1970-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, size: int, payload: bytes, payload_digest: str, refers_to: int | None, kind: str) -> bytes:
    """A record; a revisit has no payload of its own, its original's size stands in WARC-Original-Length.

    Without a url there is no target. Blanks and control characters of a url are percent-encoded, and the url as it was stands
    in X-Original-URI.
    """
    own = "null" if page_id is None else str(page_id)
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{own}>"), ("WARC-Date", DATE)]
    if url is not None:
        fit = _UNFIT.sub(lambda c: "".join(f"%{b:02X}" for b in c[0].encode()), url)
        head += [("WARC-Target-URI", fit)] + [("X-Original-URI", json.dumps(url))] * (fit != url or not url)
    head += [("WARC-Payload-Digest", f"sha1:{payload_digest}"), ("Content-Type", "text/html; charset=utf-8")]
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Original-Length", str(size))]
        payload = b""
    head.append(("Content-Length", str(len(payload))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + payload + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-cased names) and body of one record; raises ValueError where it is not a valid one."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC record")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or name.lower() in headers:
            raise ValueError(f"a bad or repeated header: {line!r}")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"no header {name}")
    size = headers["content-length"]
    if not size.isdigit() or len(rest) != int(size) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("the record's length is not its Content-Length")
    body = rest[:-4]
    if headers["warc-type"] == "response" and "warc-payload-digest" in headers and headers["warc-payload-digest"] != f"sha1:{digest(body)}":
        raise ValueError("the payload's digest differs")
    return headers, body


def dictionary_frame(data: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=19).compress(data) if data else b""
    return struct.pack("<II", DICT_MAGIC, len(packed)) + packed


def frames(data: memoryview) -> Iterator[bytes]:
    """The decoded frames of an archive, one at a time; skippable ones but a leading dictionary are passed over."""
    at, maker = 0, zstandard.ZstdDecompressor()
    if len(data) >= 8 and struct.unpack_from("<I", data, 0)[0] == DICT_MAGIC:
        size = struct.unpack_from("<I", data, 4)[0]
        raw, at = bytes(data[8 : 8 + size]), 8 + size
        if len(raw) != size:
            raise ValueError("the dictionary's frame is cut off")
        if raw[:4] == struct.pack("<I", FRAME_MAGIC):  # the dictionary may itself be compressed
            raw = maker.decompress(raw)
        if raw:
            maker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    while at < len(data):
        if len(data) - at < 8:
            raise ValueError("a frame is cut off")
        magic = struct.unpack_from("<I", data, at)[0]
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            continue
        if magic != FRAME_MAGIC:
            raise ValueError(f"no Zstandard frame at byte {at}")
        one = maker.decompressobj()
        parts, size = [], 1 << 16
        while not one.eof:
            chunk = bytes(data[at : at + size])
            if not chunk:
                raise ValueError("a frame is cut off")
            parts.append(one.decompress(chunk))
            at += len(chunk) - len(one.unused_data)
            size = min(4 * size, 1 << 24)
        yield b"".join(parts)


def train_dictionary(rows: DataFrame) -> bytes:
    """A dictionary from about SAMPLE_RECORDS whole payloads (a sample by hash, SAMPLE_BYTES in all); empty where they are too few.

    Which payloads these are decides how small the archives get, not what they hold. One over an eighth of SAMPLE_BYTES is left out.
    """
    n = rows.count()
    got, held = [], 0
    sample = rows.where(F.pmod(F.xxhash64("page_id"), F.lit(1 << 20)) < min(1.0, SAMPLE_RECORDS / max(n, 1)) * (1 << 20))
    for r in sample.where(F.octet_length("html") <= SAMPLE_BYTES // 8).select("html").limit(2 * SAMPLE_RECORDS).toLocalIterator():
        if r[0] and held < SAMPLE_BYTES:
            got.append(r[0].encode())
            held += len(got[-1])
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, held // 8), got).as_bytes() if len(got) >= 10 else b""
    except zstandard.ZstdError:  # too little or too uniform
        return b""


def packed(rows: DataFrame, dictionary: bytes = b"") -> DataFrame:
    """(page_id, url, size, payload_digest, frame) of rows (page_id, url, html): each one's response as a Zstandard frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)
        for batch in batches:
            for part in slices(batch, "html"):
                size, sha, frame = [], [], []
                for page_id, url, html in zip(*(c.to_pylist() for c in part.columns)):
                    payload = (html or "").encode()
                    size.append(len(payload))
                    sha.append(digest(payload))
                    frame.append(pack.compress(record(page_id, url, len(payload), payload, sha[-1], None, "response")))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(size, pa.int64()), pa.array(sha, pa.string()), pa.array(frame, pa.binary())], ["page_id", "url", "size", "payload_digest", "frame"])

    return rows.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, size long, payload_digest string, frame binary")


def write_warc(rows: DataFrame, path: str, dictionary: bytes = b"") -> None:
    """Writes rows (page_id, url, size, payload_digest, frame, refers_to) as archives below path.

    A row's record is its frame, or where refers_to is not null a revisit of that page.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)
        first, out, held, runs = dictionary_frame(dictionary), [], 0, 0
        for batch in batches:
            for page_id, url, size, sha, frame, ref in zip(*(c.to_pylist() for c in batch.columns)):
                if not out and runs % FILE_RUNS == 0:  # Spark begins a file here
                    out.append(first)
                out.append(frame if ref is None else pack.compress(record(page_id, url, size, b"", sha, ref, "revisit")))
                held += len(out[-1])
                if held >= RUN_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], ["value"])
                    out, held, runs = [], 0, runs + 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], ["value"])

    cols = rows.select("page_id", "url", "size", "payload_digest", "frame", "refers_to")
    cols.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", MARK).option("maxRecordsPerFile", FILE_RUNS).text(path)


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]) of every record of the archives below path."""

    def number(urn: str | None) -> int | None:
        text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return None if text in ("", "null", "None") else int(text)

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * with_payload]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * with_payload]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for raw in frames(memoryview(data.as_buffer())):
                    h, body = parse(raw)
                    size = int(h["warc-original-length"]) if h["warc-type"] == "revisit" else len(body)
                    url = json.loads(h["x-original-uri"]) if "x-original-uri" in h else h.get("warc-target-uri")
                    rows.append((number(h["warc-record-id"]), url, size, h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"], number(h.get("warc-refers-to")), *[body] * with_payload))
                    if len(rows) >= 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", path: str | None = None, min_revisit: int = MIN_REVISIT, with_payload: bool = False) -> DataFrame:
    """Writes a record for every row and reads the archives back.

    Of rows with equal payloads of at least min_revisit bytes the one with the least id is the response and the others
    revisit it. A null html is an empty payload; a null url stays null. A null id counts as larger than any other; rows that
    repeat the response's id are responses too, as nothing tells them apart. Payloads of any length are written whole, other
    columns of pages, whatever their names, are not read, and an empty table gives no rows.

    Payloads are hashed and compressed once, and what is shuffled to find equal ones is compressed.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    dictionary = train_dictionary(rows)
    ready = stored(packed(rows, dictionary), "records")
    groups = ready.where(F.col("size") >= min_revisit).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    shared = stored(groups.where("n > 1").select("payload_digest", "first"), "payloads")
    linked = ready.join(shared.hint("merge"), "payload_digest", "left")  # a hot payload is split by adaptive execution
    again = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first"))) & (F.col("size") >= min_revisit)
    path = path or shared_path(spark, "warc")
    write_warc(linked.withColumn("refers_to", F.when(again, F.col("first"))), path, dictionary)
    return read_warc(spark, path, with_payload)
