import json

import pytest

from spanloom.operators import retrieve, symbols
from spanloom.plans import context as C


@pytest.fixture(scope="module")
def tree(spark):
    rows = [(f"src/unit_{i}.rs", "".join(f"/// unit {i} fn {j}\npub fn f_{i}_{j}() {{ /* body */ }}\n" for j in range(50))) for i in range(8)]
    files = spark.createDataFrame(rows + [("README.md", "# x\n"), ("lib/a.py", "def f_py():\n    return 1\n")], "file string, content string").cache()
    return files, symbols.extract(files).cache()


def _ask(spark, *queries):
    return spark.createDataFrame([(q,) for q in queries], "query string")


def test_context_fits_and_orders(spark, tree):
    files, found = tree
    assert found.count() == 401
    ask = lambda budget: C.context(found, files, _ask(spark, "f_1", "f_py"), budget=budget, anchor_file="src/unit_1.rs", anchor_line=1, template="Do it.\n").orderBy("pos").collect()
    out = ask(100)
    assert out[0].id == "__template__" and out[1].id.startswith("src/unit_1.rs:") and sum(r.tokens for r in out) <= 100
    assert ask(60) == []  # the template reserves 80, and where it finds no room nothing else stays
    fenced = C.context(found, files, _ask(spark, "f_py"), fence=True).collect()
    assert [r.content for r in fenced] == ["// File: lib/a.py (lines 1-2)\n```py\ndef f_py():\n    return 1\n```\n\n"]


def test_envelopes(spark, tree):
    files, found = tree
    hit, none = C.context(found, files, _ask(spark, "f_py")), C.context(found, files, _ask(spark, "nothing_like_it"))
    got = json.loads(C.as_json(hit, "gpt-4o", 3000, "B").first().json)
    assert got["total_tokens"] == got["items"][0]["tokens"] and set(got) == {"model", "budget", "total_tokens", "tier", "effective_limit", "effective_top_per_query", "items"}
    got = json.loads(C.as_json(none, "gpt-4o", 3000).first().json)
    assert (got["ok"], got["reason"], got["items"]) == (False, "no_matches", [])
    assert C.as_text(hit).first().text.startswith("// File: lib/a.py") and C.as_text(none).first().text == ""


def test_caps_signals_dedupe(spark, tree):
    files, found = tree
    by_caps = C.context(found, files, _ask(spark, "f_"), caps="code=100,interfaces=0,tests=0", top=500).collect()
    assert [r.id for r in by_caps] == ["lib/a.py:1-2"]
    signals = spark.createDataFrame([("src/unit_5.rs", 20, "error")], "file string, line int, severity string")
    out = C.context(found, files, _ask(spark, "f_2_3", "f_5_9"), signals=signals).orderBy("pos").collect()
    assert out[0].id.startswith("src/unit_5.rs:")
    body = " ".join(f"w{i};" for i in range(60))
    twins = spark.createDataFrame([(f"x/{n}.rs", f"pub fn long_fn() {{ {body} }}") for n in "ab"], "file string, content string")
    ask = lambda **o: [r.id for r in C.context(symbols.extract(twins), twins, _ask(spark, "long_fn"), **o).orderBy("pos").collect()]
    assert ask() == ["x/a.rs:1-1", "x/b.rs:1-1"] and ask(dedupe=0.7) == ["x/a.rs:1-1"]


def test_lookup_in_blocks(spark, tree, monkeypatch):
    found, asked = tree[1], _ask(spark, "f_1", "f_py", "f_2_3", "none")
    rows = lambda: sorted((r.query, r.name, r["rank"]) for r in retrieve.lookup(found, asked).collect())
    whole = rows()
    monkeypatch.setattr(retrieve, "BLOCK_BYTES", 20)
    assert rows() == whole and whole


def test_chunks_are_written(spark, tmp_path):
    rows = [(1, "a", "f.rs", 1, 2, 3, "x\ny"), (2, "b", "f.rs", 3, 4, 5, "z")]
    C.write_chunks(spark.createDataFrame(rows, "chunk_id int, symbol_path string, source_file string, start_line long, end_line long, token_count long, content string"), str(tmp_path))
    assert sorted((r.file, r.token_count) for r in spark.read.json(f"{tmp_path}/manifest").collect()) == [("chunk_001.txt", 3), ("chunk_002.txt", 5)]
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/chunks/file=chunk_001.txt").collect()) == ["x", "y"]
