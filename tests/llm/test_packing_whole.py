"""pack() against first-fit by brute force and the library's ids; token files against a plain sort."""

import random
import zlib
from collections import defaultdict

import numpy as np

from spanloom.llm import packing, tokenfile, tokens


def test_pack_is_whole_and_tight(spark):
    rng = random.Random(9)
    texts = [None, "", "x " * 5000, "x " * 5000] + [" ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(rng.randint(1, 400))) for _ in range(300)]
    rows = [(i if i != 7 else None, t, 1, 2) for i, t in enumerate(texts)] + [(3, texts[3], 1, 2)]  # a null id and a repeated row
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int, part int").repartition(5)
    got = packing.pack(docs, capacity=256).collect()
    lib, expected = tokens.TokenEncoder().tokenizer, []
    for i, t, *_ in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 256 or 256, len(ids) + 1, 256)]
        expected += [(-1 if i is None else i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(expected)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    # no worse than first fit in falling order, and than the volume by a bin
    room = []
    for n in sorted((e[3] for e in expected), reverse=True):
        k = next((k for k, r in enumerate(room) if r >= n), None)
        if k is None:
            room.append(256 - n)
        else:
            room[k] -= n
    assert len(bins) <= len(room)


def test_small_files_hold_everything_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "FILE_FRAMES", 2)
    rows = [(i // 3 if i % 10 else None, f"text {i * 7919 % 400} " * (i % 9)) for i in range(400)] + [(5, "again")] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = str(tmp_path / "t")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        tokenfile.write_token_files(docs, path, frame_ids=50)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    files = [f for f in (tmp_path / "t").iterdir() if f.name.startswith("part-")]
    assert len(files) > 10 and all(len(list(tokenfile.frames(f.read_bytes()))) <= 2 for f in files)
    lib, back = tokens.TokenEncoder().tokenizer, tokenfile.read_token_files(spark, path, with_ids=True).collect()
    back.sort(key=lambda r: (r.part, r.part_start))
    ids = [-1 if r.doc_id is None else r.doc_id for r in back]
    assert ids == sorted(ids)
    assert sorted((i, tuple(r.ids)) for i, r in zip(ids, back)) == sorted((-1 if i is None else i, (*lib.encode(t, add_special_tokens=False).ids, 0)) for i, t in rows)
    got = tokenfile.token_table(docs).collect()
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
