import os

import pytest
from pyspark.sql import functions as F

from spanloom.operators import edits, fit, logs, retrieve, symbols
from spanloom.plans import catalog
from spanloom.sources import files

RUST = '''/// top
pub fn alpha() -> Vec<i32> { let c = '{'; let s = "} fn no() {"; vec![1] }
mod inner {
    // plain
    pub(crate) fn beta() { fn nested() {} }
}
#[derive(Debug)]
pub struct P<T> { a: T }
impl<T: Fn() -> i32> Tr for P<T> where T: Clone { fn m(&self) { fn q() {} } /** doc é */ pub async fn n() {} }
trait Tr { fn sig(&self); fn dflt(&self) {} type X; }
macro_rules! mm { () => { fn hidden() {} } }
'''


def test_rust_symbols():
    got = {r[4]: r for r in symbols.rust_symbols("a.rs", RUST)}
    assert {k: v[2] for k, v in got.items()} == {"alpha": "function", "inner": "module", "crate::inner::beta": "function", "crate::inner::nested": "function", "P": "struct", "P<T>::m": "method", "P<T>::n": "method", "Tr": "trait", "Tr::dflt": "method"}
    raw = RUST.encode()
    assert raw[got["P<T>::n"][5] : got["P<T>::n"][6]] == b"pub async fn n() {}" and got["P<T>::n"][10] == "doc é"
    assert got["alpha"][7:] == (2, 2, "public", "top") and got["crate::inner::beta"][9] is None and got["P"][10] is None


def test_symbols_of_files(spark, tmp_path):
    src = 'class A:\n  "d"\n  def m(self):\n    pass\n\ndef _f(): pass\n'
    df = spark.createDataFrame([("x/a.py", src), ("b.rs", "fn f() {}"), ("c.txt", "fn g() {}"), ("bad.py", "def ("), ("n.rs", None), ("e.rs", "")], "path string, content string")
    rows = symbols.extract(df).collect()
    assert sorted((r.qualified_name, r.kind, r.visibility, r.byte_start, r.doc) for r in rows if r.lang == "python") == [("A", "class", "public", 0, "d"), ("A::m", "method", "public", 17, None), ("_f", "function", "private", src.index("def _f"), None)]
    assert [r.name for r in symbols.extract(df, ["Rust", "go"]).collect()] == ["f"]
    out = str(tmp_path / "symbols")
    files.write_symbols(symbols.extract(df, include_private=False), out)
    assert sorted(r.name for r in files.read_symbols(spark, out).collect()) == ["A", "f", "m"]



def test_walk(spark, tmp_path):
    (tmp_path / ".git").mkdir()
    for path, text in {".gitignore": "*.log\n/build/\n!keep.log\ndocs/**/x.md\n", "a.rs": "fn a() {}\n", "build/b.rs": "", "sub/build/c.rs": "", "keep.log": "", "no.log": "", "docs/p/q/x.md": "", "docs/y.md": "", ".hidden": "", "sub/.ignore": "z.*\n", "sub/z.py": "", "bad + x.rs": b"\xff"}.items():
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())
    rel = lambda **o: [os.path.relpath(p, tmp_path) for p in files.walk(str(tmp_path), **o)]
    assert rel() == sorted([".gitignore", ".hidden", "a.rs", "bad + x.rs", "docs/y.md", "keep.log", "sub/.ignore", "sub/build/c.rs"])
    assert rel(include_hidden=False, ignore=["docs", "sub/**"], extensions=["rs", "md"]) == ["a.rs", "bad + x.rs"]
    assert rel(max_depth=1, include_hidden=False) == ["a.rs", "bad + x.rs", "keep.log"]
    got = {r.path: r.content for r in files.read_texts(spark, str(tmp_path), extensions=["rs"]).collect()}
    assert got == {"a.rs": "fn a() {}\n", "bad + x.rs": None, "sub/build/c.rs": ""}
    scan = files.scan(spark, str(tmp_path))
    assert files.is_stale(scan, "2000-01-01").first().stale and not files.is_stale(scan, "2200-01-01").first().stale
    assert files.matching(scan, ["*.rs", "docs"]).where("path like '%.rs' or path like 'docs%'").isEmpty()


def test_sessions_and_config(spark, tmp_path):
    for name, done in (("s1", True), ("s2", False)):
        (tmp_path / "m" / name).mkdir(parents=True)
        (tmp_path / "m" / name / "manifest.json").write_text('{"id": "%s",\n "timestamp": "t", "success": true, "engine": "internal", "files": [{"rel_path": "a"}]}' % name)
        if done:
            (tmp_path / "m" / name / "DONE").write_text("")
    found = files.rebuild_sessions(files.read_manifests(spark, str(tmp_path / "m")))
    assert [tuple(r) for r in found.collect()] == [("s1", "t", True, 1, "internal")]
    index = str(tmp_path / "index")
    files.append_sessions(found, index)
    (tmp_path / "index" / "more.json").write_text('{"id": "s3"}\nnot json\n')
    assert sorted(r.id for r in files.read_sessions(spark, index).collect()) == ["s1", "s3"]
    (tmp_path / "tool.json").write_text('{"budget": 5, "tier": "A"}')
    assert files.load_config(str(tmp_path), "tool", {"TOOL_TIER": "B"}) == {"budget": 5, "tier": "B"}
    assert files.history_after(["a", " ", "b"], "c", 2) == ["c", "a"] and files.history_after(["a"], "a") == ["a"]


def _signals(spark, text, format=None):
    lines = logs.number_lines(spark.createDataFrame([("l", text)], "log string, text string"))
    return [(r.file, r.line, r.severity, r.message) for r in logs.merged(logs.signals(lines, format)).orderBy("file", "line").collect()]


def test_logs(spark):
    assert _signals(spark, "error[E0308]: mismatched types\n  --> src/main.rs:10:5\n   |\n --> src/x.rs:3\n") == [("src/main.rs", 10, "error", "error[E0308]: mismatched types"), ("src/x.rs", 3, "info", "")]
    assert _signals(spark, "warning: unused\n--> src/lib.rs:123") == [("src/lib.rs", 123, "warn", "warning: unused")]
    assert _signals(spark, "error: x\n --> C:\\proj\\file.rs:10:5")[0][:2] == ("C:\\proj\\file.rs", 10)
    assert _signals(spark, "    at it (/repo/app.test.js:42:7)")[0][:2] == ("/repo/app.test.js", 42)
    assert _signals(spark, 'File "t.py", line 42, in test_x\n    assert a\nAssertionError') == [("t.py", 42, "error", "AssertionError")]
    assert len(_signals(spark, "error: a\n--> f.rs:1:1\nerror: b\n--> f.rs:1:9")) == 1
    assert _signals(spark, "error: " + "é" * 200 + "\n--> f.rs:1:1")[0][3] == "error: " + "é" * 75 + "…"
    assert _signals(spark, "") == []
    with pytest.raises(ValueError):
        _signals(spark, "", "other")


SPEC = "note\nFILE: a.txt\n# c\nREPLACE lines 2-3:\nOLD:\n```\nb\nc\n```\nNEW:\n```txt\nB\n```\nINSERT at 0:\nNEW:\ntop\nDELETE lines 5\nFILE: gone\nDELETE lines 1\n"


def test_edits(spark):
    specs = spark.createDataFrame([(1, SPEC), (2, "FILE: x\nMOVE 1"), (3, ""), (4, None)], "spec long, text string")
    ops = edits.parse_specs(specs)
    assert [r.error for r in ops.where("error is not null").collect()] == ["Unknown directive: MOVE 1"]
    got = {r.file: (r.content, r.problems) for r in edits.apply_edits(spark.createDataFrame([("a.txt", "a\r\nb \r\nc\r\nd\r\ne\r\n")], "file string, content string"), ops.where("error is null")).collect()}
    assert got == {"a.txt": ("top\r\na\r\nB\r\nd\r\n", []), "gone": (None, ["file-missing"])}
    files_ = spark.createDataFrame([("a.txt", "a\nb\nc\nd\ne")], "file string, content string")
    patch = edits.render_patch(files_, edits.apply_edits(files_, ops.where("error is null"))).first().patch
    assert patch.startswith("--- a/a.txt\n+++ b/a.txt\n@@ -1,5 +1,4 @@\n+top\n a\n-b\n-c\n+B\n d\n-e")


@pytest.mark.parametrize("ops, word", [("DELETE lines 9", "span-out-of-range"), ("REPLACE lines 1:\nOLD:\nz\nNEW:\ny", "old-content-mismatch"), ("GUARD-CID: 0\nREPLACE lines 1:\nOLD:\na\nNEW:\ny", "content-mismatch"), ("DELETE lines 1-2\nDELETE lines 2", "overlap"), ("DELETE lines 1-2\nINSERT at 2:\nNEW:\nx", "insert-overlap")])
def test_edit_problems(ops, word):
    assert any(p.startswith(word) for p in edits.problems("a\nb\nc", edits.parse_spec("FILE: f\n" + ops)))


@pytest.mark.parametrize("spec", ["FILE:", "FILE: f\nDELETE lines 0", "FILE: f\nDELETE lines 3-2", "FILE: f\nREPLACE lines 1\n", "FILE: f\nINSERT at x:\nNEW:\n", "FILE: f\nINSERT at 1:\nx", "FILE: f\nGUARD-CID: a"])
def test_spec_errors(spec):
    with pytest.raises(edits.SpecError):
        edits.parse_spec(spec)


def test_relocation_needs_tokens():
    ops = edits.parse_spec("FILE: f\nREPLACE lines 3:\nOLD:\nb\nNEW:\nX")
    assert edits.applied("a\nb\nb", ops) == "a\nb\nX" and edits.applied("a\nb\nb", ops, lambda t: list(t.encode())) == "a\nX\nb"


def test_bucketed_fit(spark):
    tags = {"c": ["code"], "i": ["interface"], "t": ["test", "interface"]}
    rows = [(f"{k}{j}", " ".join(f"{k}{j}w{x}" for x in range(4)), n, 100, 1.0, tags[k]) for k, n, m in (("c", 30, 3), ("i", 40, 2), ("t", 25, 2)) for j in range(m)]
    items = spark.createDataFrame(rows + [("u", "same", 5, 50, 1.0, None)], "id string, content string, tokens long, level int, relevance double, tags array<string>")
    caps = fit.parse_caps("code=60, interfaces=60,tests=40")
    fitted, refused = fit.bucketed_fit(items, caps)
    assert sorted(r.id for r in fitted.collect()) == ["c0", "c1", "i0", "t0"]
    assert sorted((r.id, r.bucket, r.reason) for r in refused.collect()) == [(x, b, "bucket-cap-exceeded") for x, b in (("c2", "code"), ("i1", "interfaces"), ("t1", "tests"), ("u", "code"))]
    dull = fit.bucketed_fit(items.union(items.where("id = 'u'").withColumn("id", F.lit("v"))), caps, 0.9)[1]
    assert {r.reason for r in dull.where("id in ('u', 'v')").collect()} == {"novelty-floor<0.90"}
    for bad in ("code=abc", "unknown=50", "code"):
        with pytest.raises(ValueError):
            fit.parse_caps(bad)


def _greedy(rows, threshold):
    shingles = lambda t: {tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)}
    kept, seen = [], set()
    for r in sorted(rows, key=lambda r: (-r[2], -r[3], -r[4], r[0])):
        if " ".join(r[1].split()) in seen:
            continue
        seen.add(" ".join(r[1].split()))
        a = shingles(r[1])
        near = any(a and b and len(a & b) / len(a | b) >= threshold for b in (shingles(k[1]) for k in kept))
        if r[5] or not near:
            kept.append(r)
    return sorted(k[0] for k in kept)


def test_representatives(spark):
    import random

    rng, rows = random.Random(5), []
    base = [[f"w{rng.randrange(400)}" for _ in range(40)] for _ in range(4)]
    for i in range(60):
        words = list(base[i % 4])
        for _ in range(rng.randrange(3)):
            words[rng.randrange(40)] = f"x{rng.randrange(3)}"
        rows.append((f"i{i:02}", " ".join(words), rng.randrange(5), float(rng.randrange(2)), 0.5, i % 17 == 0))
    rows += [("s1", "a b", 1, 1.0, 0.5, False), ("s2", "a  b", 2, 1.0, 0.5, False), ("s3", "", 1, 1.0, 0.5, False)]
    df = spark.createDataFrame(rows, "id string, content string, level int, relevance double, proximity double, keep boolean")
    assert sorted(r.id for r in fit.representatives(df, 0.7, "keep").collect()) == _greedy(rows, 0.7)
    assert fit.representatives(df.where("false")).isEmpty()


def test_tree(spark):
    df = spark.createDataFrame([("src/b.rs", 2), ("src/a/x.py", 1), ("README", None)], "path string, lines long")
    assert [r.text for r in retrieve.tree_lines(df).orderBy("parts").collect()] == ["├─ README", "└─ src/", "   ├─ a/", "   │  └─ x.py:1", "   └─ b.rs:2"]


def test_representatives_query_keeps_no_pair(spark):
    data = "/root/testdata/sf0.001"
    kept = catalog.representatives(spark, data).join(spark.read.parquet(f"{data}/documents.parquet"), "doc_id")
    assert not kept.isEmpty() and fit.jaccard_pairs(kept).isEmpty()
