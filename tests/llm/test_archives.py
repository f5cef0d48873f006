"""Archives against a plain grouping of payloads, and what a file holds."""

import base64
import hashlib
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from spanloom.llm import queries, warc

DATA = "/root/testdata/sf0.001"


def plain(rows):
    """(page_id, url, bytes, digest, type, refers_to) of (page_id, url, html), by reading."""
    data = [(i, u, (h or "").encode()) for i, u, h in rows]
    first = {}
    for i, _, p in data:
        if i is not None:
            first[p] = min(first.get(p, i), i)
    out = []
    for i, u, p in data:
        ref = first.get(p)
        again = ref is not None and (i is None or i > ref)
        out.append((i, u, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", ref if again else None))
    return sorted(map(str, out))


def test_archive_against_a_plain_grouping(spark):
    rng = random.Random(1)
    urls = ["http://a/b", None, "", " http://a b\tc\r\nX: y ", "http://ü/日本 ", "%41%20", "http://a/ "]
    rows = [(rng.choice([None, *range(500)]), rng.choice(urls), rng.choice([None, "", "same page", "é" * 50, f"page {n} " * rng.randint(1, 200)])) for n in range(400)]
    rows += [(1000, "http://long", "long " * 400_000), (1001, "http://long", "long " * 400_000), (3, "u", "twice"), (3, "u", "twice")]
    pages = spark.createDataFrame([(*r, "x", 1, "f") for r in rows], "page_id long, url string, html string, size string, first int, frame string").repartition(4)
    got = warc.archive(pages)
    assert sorted(str(tuple(r)) for r in got.select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == plain(rows)
    assert warc.archive(pages.where(F.lit(False))).count() == 0


def test_the_query_over_its_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url", "html").collect()]
    expected = sorted(x for x in plain([(i, None, h) for i, _, h in rows]))
    got = queries.op10_warc(spark, DATA).collect()
    assert sorted(str((r.page_id, None, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == expected


@pytest.mark.parametrize("dictionary", [False, True])
def test_files_are_bounded_and_begin_with_the_dictionary(spark, tmp_path, monkeypatch, dictionary):
    monkeypatch.setattr(warc, "RUN_BYTES", 2000)
    monkeypatch.setattr(warc, "FILE_RUNS", 3)
    rng = random.Random(2)
    pages = [(i, f"http://{i}", f"<p>{i}</p>" + "".join(rng.choice("abcdefgh <>") for _ in range(800))) for i in range(120)]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    known = warc.train_dictionary(rows) if dictionary else b""
    path = str(tmp_path / "w")
    warc.write_warc(warc.packed(rows, known).withColumn("refers_to", F.when(F.col("page_id") == 9, F.lit(4).cast("long"))), path, known)
    files = [f.read_bytes() for f in (tmp_path / "w").iterdir() if f.name.startswith("part-")]
    assert len(files) > 3 and max(map(len, files)) < 3 * 4000 + len(warc.dictionary_frame(known))
    assert all(f.startswith(warc.dictionary_frame(known)) for f in files)
    ids = [warc.parse(x)[0]["warc-record-id"] for f in files for x in warc.frames(memoryview(f))]
    assert len(ids) == len(set(ids)) == 120
    back = {r.page_id: r for r in warc.read_warc(spark, path, with_payload=True).collect()}
    assert all(bytes(back[i].payload).decode() == h for i, _, h in pages if i != 9) and back[9].record_type == "revisit" and back[9].refers_to == 4
    if known:
        with pytest.raises(zstandard.ZstdError):
            zstandard.ZstdDecompressor().decompress(files[0][len(warc.dictionary_frame(known)) :])
