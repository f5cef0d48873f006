"""Sessions begun, filled, finished, listed, restored and removed on a tree; edits applied with backups."""

import os
import re
import subprocess
import time
from datetime import UTC, datetime

import pytest

from spanloom.operators import backups, diffs, patching
from spanloom.sources import files


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.rs").write_text("one\ntwo\n")
    (tmp_path / "b.bin").write_bytes(b"\xff\x00")
    os.symlink("src/a.rs", tmp_path / "link")
    return str(tmp_path)


def read(root, path):
    with open(f"{root}/{path}", "rb") as f:
        return f.read()


def test_round_trip(spark, tree):
    s = backups.Session(tree, "internal")
    assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d-\d\d-\d\dZ_[0-9A-Za-z]{10}", s.id)
    for p in ("src/a.rs", "b.bin", "link", "./src//a.rs"):
        s.add(p)
    assert [f["rel_path"] for f in s.files] == ["b.bin", "link", "src/a.rs"] and s.files[1]["link_target"] == "src/a.rs"
    with pytest.raises(backups.SessionError):
        backups.manifest_of(tree, s.id)
    for bad in ("../x", "/etc/passwd", "", "src"):
        with pytest.raises(backups.SessionError):
            s.add(bad)
    assert s.finish(True) == s.finish(False) == s.id
    base = f"{tree}/.spanloom/backups"
    index = files.read_sessions(spark, f"{base}/index.jsonl").collect()
    assert [(r.id, r.success, r.files, r.engine) for r in index] == [(s.id, True, 3, "internal")]
    assert files.read_manifests(spark, base).count() == 1
    sizes = backups.folder_sizes(spark, tree).first()
    assert sizes.payload_bytes == 8 + 2 + 8 and sizes.bytes > sizes.payload_bytes
    os.remove(f"{base}/index.jsonl")
    assert backups.rebuild_index(tree) == 1 and files.read_sessions(spark, f"{base}/index.jsonl").count() == 1


def test_restore(tree):
    s = backups.Session(tree, "x")
    s.add("src/a.rs")
    s.add("b.bin")
    id = s.finish(True)
    with open(f"{tree}/src/a.rs", "w") as f:
        f.write("new\n")
    os.remove(f"{tree}/b.bin")
    out = backups.restore(tree, id, show_diff=True)
    assert out["conflicts"] == ["src/a.rs"] and out["restored"] == [] and "-new\n" in out["diffs"]["src/a.rs"] and out["diffs"]["b.bin"].startswith("[binary") and not os.path.exists(f"{tree}/b.bin")
    assert backups.restore(tree, id, force=True, dry_run=True)["restored"] == ["src/a.rs", "b.bin"] and read(tree, "src/a.rs") == b"new\n"
    with pytest.raises(backups.SessionError):
        backups.restore(tree, id, path="other.rs")
    out = backups.restore(tree, id, force=True, backup_current=True)
    assert read(tree, "src/a.rs") == b"one\ntwo\n" and read(tree, "b.bin") == b"\xff\x00"
    kept = backups.manifest_of(tree, out["backup_session"])
    assert [f["original_path"] for f in kept["files"]] == ["src/a.rs"] and kept["engine"] == "restore"
    with open(f"{tree}/.spanloom/backups/{id}/src/a.rs", "a") as f:
        f.write("x")
    with pytest.raises(backups.SessionError, match="checksum"):
        backups.restore(tree, id, force=True)
    assert backups.restore(tree, id, "src/a.rs", force=True, verify=False)["restored"] == ["src/a.rs"]


def test_clean(spark, tree):
    ids = []
    for n in range(4):
        s = backups.Session(tree, "x", id=f"s{n}")
        s.began = f"202{n}-01-01T00:00:00+00:00"
        s.add("b.bin")
        ids.append(s.finish(True))
    backups.Session(tree, "x", id="open")
    with pytest.raises(backups.SessionError):
        backups.clean(spark, tree)
    assert backups.clean(spark, tree, keep=3, older_than="2021-06-01T00:00:00Z", dry_run=True)["removed"] == ["s0", "s1"]
    out = backups.clean(spark, tree, keep=1)
    assert out["removed"] == ["s0", "s1", "s2"] and out["bytes"] > 6 and not out["errors"]
    assert [r.id for r in files.read_sessions(spark, f"{tree}/.spanloom/backups/index.jsonl").collect()] == ["s3"]


def test_locks(tree):
    path = f"{tree}/locks/l"
    with backups.locked(path), pytest.raises(backups.SessionError), backups.locked(path):
        pass
    assert not os.path.exists(path)
    with open(path, "w"):
        pass
    os.utime(path, (time.time() - 100,) * 2)
    with backups.locked(path):
        assert os.path.exists(path)


def test_time_bounds():
    now = datetime(2024, 5, 8, tzinfo=UTC)
    assert backups.time_bound("7d", now) == datetime(2024, 5, 1, tzinfo=UTC) and backups.time_bound("24h", now) == datetime(2024, 5, 7, tzinfo=UTC)
    assert backups.time_bound("2024-01-01T02:00:00+02:00") == datetime(2024, 1, 1, tzinfo=UTC)
    for bad in ("-7d", "abc", "7x", "", "2024-01-01", "2024-01-01T00:00:00"):
        with pytest.raises(backups.SessionError):
            backups.time_bound(bad)


def test_whole_writes_keep_the_mode(tree):
    os.chmod(f"{tree}/src/a.rs", 0o640)
    backups.write_whole(f"{tree}/src/a.rs", b"z")
    assert read(tree, "src/a.rs") == b"z" and os.stat(f"{tree}/src/a.rs").st_mode & 0o777 == 0o640 and os.listdir(f"{tree}/src") == ["a.rs"]


OPS = {"src/a.rs": [{"pos": 0, "op": "replace", "start_line": 2, "end_line": 2, "old_content": "two", "new_content": "2", "guard_cid": None}]}


@pytest.mark.parametrize("engine", ["internal", "git", "auto"])
def test_edits_are_applied_with_a_backup(tree, engine):
    subprocess.run(["git", "init", "-q", tree], check=True)
    assert patching.apply_here(tree, OPS, engine, check_only=True)["session"] is None and read(tree, "src/a.rs") == b"one\ntwo\n"
    out = patching.apply_here(tree, OPS, engine)
    assert out["engine"] == ("git" if engine == "git" else "internal") and not out["problems"] and read(tree, "src/a.rs") == b"one\n2\n"
    assert backups.restore(tree, out["session"], force=True)["restored"] == ["src/a.rs"] and read(tree, "src/a.rs") == b"one\ntwo\n"
    wrong = {"src/a.rs": [OPS["src/a.rs"][0] | {"old_content": "three"}]}
    assert patching.apply_here(tree, wrong, engine)["problems"] and read(tree, "src/a.rs") == b"one\ntwo\n"


def test_git_modes_and_relocation(tree):
    git = lambda *a: subprocess.run(["git", "-C", tree, "-c", "user.name=x", "-c", "user.email=x@y", *a], check=True, capture_output=True, text=True).stdout
    git("init", "-q")
    git("add", "src/a.rs")
    git("commit", "-qm", "x")
    patching.apply_here(tree, OPS, "git", git_mode="index", backup=False)
    assert git("diff", "--cached", "--name-only").split() == ["src/a.rs"]
    with pytest.raises(ValueError):
        patching.apply_here(tree, OPS, "git", git_mode="other")
    with open(f"{tree}/twice", "w") as f:
        f.write("same\nx\nsame\n")
    op = {"pos": 0, "op": "replace", "start_line": 3, "end_line": 3, "old_content": "same", "new_content": "new", "guard_cid": None}
    patching.apply_here(tree, {"twice": [op]}, "internal", backup=False, vocab="byte_bpe_50k.json")
    assert read(tree, "twice") == b"new\nx\nsame\n"


def test_git_snapshot(tree):
    assert backups.git_snapshot("/nowhere") is None
    git = lambda *a: subprocess.run(["git", "-C", tree, "-c", "user.name=x", "-c", "user.email=x@y", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "b.bin")
    git("commit", "-qm", "x")
    assert backups.git_snapshot(tree)["dirty"] is False
    git("add", "src/a.rs")
    assert backups.git_snapshot(tree)["staged"] is True and len(backups.git_snapshot(tree)["head"]) == 40


def test_rendered_diff_applies_with_git(tree):
    subprocess.run(["git", "init", "-q", tree], check=True)
    a = [f"l{i}" for i in range(30)]
    b = [x for x in a if x not in ("l3", "l20")] + ["end"]
    with open(f"{tree}/f", "w") as f:
        f.write("\n".join(a) + "\n")
    subprocess.run(["git", "-C", tree, "apply", "-"], input=diffs.rendered("f", diffs.hunks(a, b)), text=True, check=True)
    assert read(tree, "f").decode() == "\n".join(b) + "\n"


def test_sinks_and_history(spark, tmp_path):
    path = str(tmp_path / "h")
    assert files.read_history(spark, path) == []
    for name in ("a", "b", "a"):
        last = files.write_history(spark, path, name, 2)
    assert last == files.read_history(spark, path) == ["b", "a"] and files.write_history(spark, path, "c", 2) == ["c", "b"]
    rows = spark.createDataFrame([(2, "s", "f", 1, 2, 3, "zwei\n"), (1, "s", "f", 1, 2, 3, "")], "chunk_id int, symbol_path string, source_file string, start_line int, end_line int, token_count int, content string")
    assert files.write_chunk_files(rows, str(tmp_path / "c")) == 2
    assert read(str(tmp_path / "c"), "chunk_002.txt") == b"zwei\n" and read(str(tmp_path / "c"), "chunk_001.txt") == b"" and read(str(tmp_path / "c"), "chunks_manifest.jsonl").startswith(b'{"chunk_id": 1, "file": "chunk_001.txt"')
    files.write_extract(spark.createDataFrame([(2, "b"), (1, "a")], "pos int, text string"), str(tmp_path / "x"))
    assert read(str(tmp_path), "x") == b"a\nb"


def test_faults_in_sources(spark, tmp_path):
    import json

    good = json.dumps({"file": "a", "lang": "rust", "kind": "function", "name": "f", "qualified_name": "f", "byte_start": 0, "byte_end": 1, "start_line": 1, "end_line": 1})
    (tmp_path / "s.jsonl").write_text(f"{good}\n\n{{broken\n{good}\n")
    assert [(r.line, r.text) for r in files.bad_lines(spark, str(tmp_path / "s.jsonl")).collect()] == [(3, "{broken")]
    sub = tmp_path / "t"
    (sub / "d").mkdir(parents=True)
    (sub / "d/x").write_bytes(b"<<<<<<< a\n1\n=======\n2\n>>>>>>> b\n\xff")
    (sub / "y").write_text("=======\n")
    assert [r.file.rpartition("/")[2] for r in files.read_conflicted(spark, str(sub)).collect()] == ["x"]
    (sub / "big").write_bytes(b"\xff" * (files.LARGE_FILE + 1))
    os.remove(sub / "d/x")
    assert {r.path: r.content for r in files.read_texts(spark, str(sub), strict=True).collect()} == {"big": "", "y": "=======\n"}
    (sub / "small").write_bytes(b"\xff")
    with pytest.raises(Exception, match="no UTF-8"):
        files.read_texts(spark, str(sub), strict=True).collect()


def test_stale_folders(spark):
    new = datetime(2024, 1, 2)
    old = datetime(2024, 1, 1)
    ask = lambda p: files.is_stale(spark.createDataFrame([(p, new)], "path string, modified timestamp"), old).first().stale
    assert ask("a/b.rs") and ask("a/b/c/d/e/f.py") and not ask("a/b/c/d/e/f/g.py") and not ask("a/target/b.rs") and not ask("a.md")


def test_settings(tmp_path):
    (tmp_path / "x.yaml").write_text("a: 1\nt:\n  k: 2\n  l: 3\n")
    pytest.importorskip("yaml")
    assert files.load_config(str(tmp_path), "x", {"X_T_K": "5", "X_B": "7", "Y": "0"}) == {"a": 1, "t": {"k": "5", "l": 3}, "b": "7"}
    (tmp_path / "x.toml").write_text("a = 2\n")
    assert files.load_config(str(tmp_path), "x", {}) == {"a": 2}


def test_the_session(spark):
    from spanloom.operators import govern

    index = spark.createDataFrame([("2024-01_aaaaaaaa", 1), ("2024-01_bbbbbbbb", 2), ("2024-01", 3)], "id string, ts int").selectExpr("*", "true as done", "true as success")
    assert govern.the_session(index, "aaaaaaaa") == "2024-01_aaaaaaaa" and govern.the_session(index, "2024-01") == "2024-01" and govern.the_session(index, "latest") == "2024-01"
    for bad in ("2024-", "zzzzzzzz"):
        with pytest.raises(ValueError):
            govern.the_session(index, bad)


def test_python_with_faults():
    from spanloom.operators import symbols

    src = "class A:\n    def f(self):\n        return 1\n\n    async def _g(self): pass\n# note\nx = (\ndef h():\n\ty = 1\n"
    got = [(r[2], r[3], r[4], r[7], r[8], r[9], src.encode()[r[5] : r[6]].decode()) for r in symbols.python_symbols("a.py", src)]
    assert [g[:6] for g in got] == [("class", "A", "A", 1, 5, "public"), ("method", "f", "A::f", 2, 3, "public"), ("method", "_g", "A::_g", 5, 5, "private"), ("function", "h", "h", 8, 9, "public")]
    assert got[1][6] == "def f(self):\n        return 1" and got[3][6] == "def h():\n\ty = 1"


def test_ignore_of_the_user(tmp_path, monkeypatch):
    (tmp_path / "cfg/git").mkdir(parents=True)
    (tmp_path / "cfg/git/ignore").write_text("*.tmp\n")
    repo = tmp_path / "r"
    (repo / ".git").mkdir(parents=True)
    (repo / "a.tmp").write_text("")
    (repo / "b.rs").write_text("")
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "cfg"))
    assert [os.path.basename(p) for p in files.walk(str(repo)) if "/.git/" not in p] == ["b.rs"]


def test_texts_of_attributes_and_literals():
    from spanloom.operators import symbols

    assert symbols.doc_attribute('#[doc = "a \\"b\\"\\n"]') == 'a "b"\n' and symbols.doc_attribute('#![doc=r#"x "y""#]') == 'x "y"' and symbols.doc_attribute("#[inline]") is None
    assert symbols.unquoted('"""a\n    b\n      c"""') == "a\nb\n  c" and symbols.unquoted("r'\\n'") == "\\n" and symbols.unquoted("1") is None and symbols.unquoted("'") is None
    assert [symbols.visibility(x) for x in ("pub ", "pub(crate)", "priv")] == ["public", None, "private"]
