"""Budgets, near-duplicates, differences, calls, anchors, spans and boards against plain versions."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanloom.functions import bpe
from spanloom.functions import paths as P
from spanloom.operators import anchors, board, callgraph, dedupe, diffs, fit, patching, retrieve, symbols
from spanloom.plans import context as C


def fold(items, budget):
    """The rule step by step: reserve, take or cut, drop for hard ones, expand."""
    items = sorted(items, key=lambda i: (-i["level"], -i["relevance"], i["id"]))
    out, left = [], budget
    for i in (i for i in items if i["hard"]):
        need = max(i["min_tokens"], 1)
        if left >= need:
            out.append([i, min(i["tokens"], need)])
            left -= out[-1][1]
    placed = {id(o[0]) for o in out}
    for i in (i for i in items if not i["hard"]):
        if i["tokens"] <= left:
            out.append([i, i["tokens"]])
            left -= i["tokens"]
        elif 0 < i["min_tokens"] <= left:
            out.append([i, i["min_tokens"]])
            left -= i["min_tokens"]
            if not left:
                break
    for i in (i for i in items if i["hard"] and id(i) not in placed):
        need = max(i["min_tokens"], 1)
        while left < need and any(not o[0]["hard"] for o in out):
            k = max(k for k, o in enumerate(out) if not o[0]["hard"])
            left += out.pop(k)[1]
        if left >= need:
            out.append([i, min(i["tokens"], need)])
            left -= out[-1][1]
    for o in out:
        if o[0]["hard"]:
            more = min(left, o[0]["tokens"] - o[1])
            o[1] += more
            left -= more
    return [(o[0]["id"], o[1]) for o in out]


def test_budget_fit_step_by_step(spark):
    rng = random.Random(1)
    rows = [{"bucket": b, "id": f"i{n:03}", "tokens": rng.choice([0, 1, 5, 9, 30, 80]), "level": rng.randint(1, 3), "relevance": rng.choice([0.1, 0.5]), "hard": rng.random() < (0.15 if b % 3 else 0.0), "min_tokens": rng.choice([0, 0, 4, 25])} for b in range(60) for n in range(rng.randint(1, 40))]
    got = fit.budget_fit(spark.createDataFrame(pd.DataFrame(rows)), 60).orderBy("bucket", "pos").collect()
    for b in range(60):
        assert [(r.id, r.tokens) for r in got if r.bucket == b] == fold([r for r in rows if r["bucket"] == b], 60), b


def test_a_large_bucket_is_cut_down_before_the_fold(spark):
    items = spark.range(200_000).select(F.lit("one").alias("bucket"), F.col("id"), (F.col("id") % 50 + 1).alias("tokens"), F.lit(1).alias("level"), F.lit(1.0).alias("relevance"))
    got = fit.budget_fit(items, 300).collect()
    left, expected = 300, []
    for i in range(200_000):
        if i % 50 + 1 <= left:
            expected.append(i)
            left -= i % 50 + 1
    assert [r.id for r in sorted(got, key=lambda r: r.pos)] == expected


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 7, 20, 1000])
def test_prefixes(n):
    text = "fn main() { println!(\"<|endoftext|> hello\"); } // größer 日本\n" * 4
    out = bpe.prefix(text, n)
    ids = bpe.encode(text)
    assert out == text if n >= len(ids) else out.endswith(bpe.ELLIPSIS[: len(out)]) or n < 3
    assert len(bpe.encode(out)) <= max(n, 0) or n >= len(ids)


def test_counts_and_windows(spark):
    texts = [None, "", "one two", "a <|endoftext|> b", "word " * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: (r.n, r.w) for r in df.select("i", bpe.token_count(F.col("t")).alias("n"), bpe.windows(F.col("t"), 100, 20).alias("w")).collect()}
    assert [got[i][0] for i in range(5)] == [None if t is None else len(bpe.encode(t)) for t in texts]
    ids, w = bpe.encode(texts[4]), got[4][1]
    assert [x.tokens for x in w] == [100] * (len(w) - 1) + [len(ids) - 80 * (len(w) - 1)] and w[0].content[-5:] in w[1].content
    assert [x.content for x in got[2][1]] == ["one two"]


def test_symbol_chunks(spark):
    rows = [("a.rs", "".join(f"fn f{i}() {{ let x = {i}; }}\n" for i in range(20)) + "fn big() { " + "call(1); " * 200 + "}\n"), ("plain.txt", "word " * 300), ("empty.txt", "")]
    files = spark.createDataFrame(rows, "file string, content string")
    got = C.symbol_chunks(symbols.extract(files), files, 60, 10).orderBy("file", "chunk_id").collect()
    a = [r for r in got if r.file == "a.rs"]
    assert all(r.token_count <= 60 for r in a) and a[0].symbol_path.startswith("f0, f1") and a[0].start_line == 1 and a[0].content.startswith("fn f0()")
    big = [r for r in a if r.symbol_path.startswith("big[part_")]
    assert [r.symbol_path for r in big] == [f"big[part_{i + 1}]" for i in range(len(big))] and len(big) > 5 and big == a[-len(big) :]
    assert ", ".join(r.symbol_path for r in a if r not in big) == ", ".join(f"f{i}" for i in range(20))
    assert [r.symbol_path for r in got if r.file == "plain.txt"][:2] == ["chunk_1", "chunk_2"] and [r.content for r in got if r.file == "empty.txt"] == [""]


def test_limits():
    assert C.limits() == (6000, 256, 8) and C.limits("a") == (1200, 96, 6) and C.limits("C", 10, 50, 8) == (10, 50, 12) and C.limits("B", None, 256, 3) == (3000, 192, 3)


def test_distinct_items(spark):
    body = " ".join(f"word{i}" for i in range(60))
    rows = [("q", "a", body, 1, 1.0, 0.0), ("q", "b", body + " // note", 2, 1.0, 0.0), ("q", "c", body.replace("word5 ", "other "), 1, 1.0, 0.0), ("q", "d", "pub fn x() " + body, 1, 1.0, 0.0), ("q", "e", "nothing like the others at all here", 1, 1.0, 0.0), ("q", "f", "", 1, 1.0, 0.0), ("r", "a", body, 1, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "bucket string, id string, content string, level int, relevance double, proximity double")
    keep = lambda **o: sorted((r.bucket, r.id) for r in dedupe.distinct(df, **o).collect())
    assert keep() == [("q", "b"), ("q", "d"), ("q", "e"), ("q", "f"), ("r", "a")]
    assert ("q", "d") not in keep(preserve_interfaces=False)
    twins = spark.createDataFrame([("q", "a", body + " extra words at the end here", 1, 1.0, 0.0), ("q", "b", body, 1, 1.0, 0.0)], df.schema)
    assert [r.id for r in dedupe.distinct(twins).collect()] == ["a"] and [r.id for r in dedupe.distinct(twins, swap=True).collect()] == ["b"]


def test_winnow_by_its_rule():
    rng = random.Random(3)
    for _ in range(50):
        h, w = np.array([rng.randint(0, 9) for _ in range(rng.randint(1, 30))], np.uint64), rng.randint(1, 6)
        expected, at = set(), 0
        for first in range(len(h) - w + 1):
            if at < first:
                at = max(range(first, first + w), key=lambda j: (-int(h[j]), j))
            elif h[first + w - 1] <= h[at]:
                at = first + w - 1
            expected.add(int(h[at]))
        assert dedupe.winnow(h, w) == expected


def test_votes_of_long_texts():
    words = [f"w{i * i % 5000}" for i in range(2600)]
    a, b = dedupe.Text(" ".join(words), 4, 64), dedupe.Text(" ".join(words[:5] + words[6:]), 4, 64)
    votes = [sum(1 if int(h) >> k & 1 else -1 for h in a.words) >= 0 for k in range(64)]
    assert a.votes == sum(1 << k for k, v in enumerate(votes) if v)
    assert dedupe.alike(a, b) and not dedupe.alike(a, dedupe.Text("x " * 3000, 4, 64))


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_scripts_are_shortest_and_hunks_apply(spark):
    rng, pairs = random.Random(4), []
    for n in range(200):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 40))]
        b = [x for x in a if rng.random() > 0.15] if n % 2 else [rng.choice("abcd") for _ in range(rng.randint(0, 40))]
        for _ in range(n % 4):
            b.insert(rng.randint(0, len(b)), "new")
        steps = diffs.script(a, b)
        assert sum(k == " " for k, _ in steps) == lcs(a, b)
        assert [t for k, t in steps if k != "+"] == a and [t for k, t in steps if k != "-"] == b
        assert diffs.applied(a, diffs.hunks(a, b, n % 4)) == b and diffs.applied(a, diffs.hunks(a, b, n % 4, True)) == b
        pairs.append((str(n), "".join(x + "\n" for x in a), "".join(x + "\n" for x in b)))
    got = diffs.diff(spark.createDataFrame(pairs, "file string, old string, new string")).collect()
    assert len(got) == sum(a != b for _, a, b in pairs)
    assert diffs.rendered("f", diffs.hunks(["a"], ["a"])) == "" and diffs.rendered("f", diffs.hunks([], ["x"])) == "--- a/f\n+++ b/f\n@@ -0,0 +1,1 @@\n+x\n"


def test_spans_against_all_pairs(spark):
    rng = random.Random(5)
    spans = [(k, f"n{i}", s, s + rng.choice([0, 1, 3, 40, 200])) for k in "ab" for i in range(80) for s in [rng.randint(1, 150)]]
    points = [(k, i, rng.randint(1, 260)) for k in "abc" for i in range(0 if k == "a" else 100 if k == "b" else 200, (0 if k == "a" else 100 if k == "b" else 200) + 60)]
    s, p = spark.createDataFrame(spans, "key string, name string, start int, end int"), spark.createDataFrame(points, "key string, point_id int, line int")
    near, inside = {}, {}
    for k, i, line in points:
        d = sorted((max(a - line, line - b, 0), a, n) for kk, n, a, b in spans if kk == k)
        near[i] = [(n, x) for x, _, n in d[:3]]
        around = [(a, b, n) for kk, n, a, b in spans if kk == k and a <= line <= b]
        inside[i] = max(around)[::-1][0] if around else None
    got = {}
    for r in retrieve.nearest_spans(p, s, "key").orderBy("rank").collect():
        got.setdefault(r.point_id, []).append((r.name, r.distance))
    assert got == {i: v for i, v in near.items() if v}
    assert {r.point_id: r.name for r in retrieve.enclosing_span(p, s, "key").collect()} == inside


def test_one_crowded_key_is_linear(spark):
    import time

    n = 20_000
    rows = spark.range(n).select(F.lit("k").alias("key"), F.col("id").alias("point_id"), (F.col("id") * 7 % n).alias("line"), (F.col("id") % 3000 == 1).alias("own"))
    spans = spark.range(n).select(F.lit("k").alias("key"), F.col("id").alias("name"), F.col("id").alias("start"), (F.col("id") + 500).alias("end"))
    retrieve.owner_asof(rows, "key", ["line"], F.col("own"), F.col("point_id")).count()
    began = time.time()
    assert retrieve.owner_asof(rows, "key", ["line"], F.col("own"), F.col("point_id")).where("owner is null").count() == 0
    assert time.time() - began < 6
    began = time.time()
    assert retrieve.enclosing_span(rows, spans, "key").where("start <> greatest(point_id * 7 % 20000, 0)").count() == 0
    assert time.time() - began < 40  # all pairs would be ten million


def test_novelty_without_variety(spark):
    one = spark.createDataFrame([(1, "alpha beta"), (2, "alpha beta beta"), (3, None), (4, "")], "doc_id int, text string")
    assert {r.doc_id: r.novelty for r in fit.novelty(one.where("doc_id = 1")).collect()} == {1: 0.0}
    got = {r.doc_id: r.novelty for r in fit.novelty(one).collect()}
    assert got[1] == got[2] == 1.0 and got[3] == got[4] == 0.0


def test_lookup_by_qualified_name_and_folder(spark):
    rows = [("src/p.rs", "run", "Parser::run", "method", 5), ("src/q.rs", "stop", "Lexer::stop", "function", 1), ("main.rs", "main", "main", "function", 1)]
    s = spark.createDataFrame(rows, "file string, name string, qualified_name string, kind string, start_line long")
    ask = lambda q, **o: [r.name for r in retrieve.lookup(s, spark.createDataFrame([(q,)], "query string"), **o).orderBy("rank").collect()]
    assert ask("parser::run") == ["run"] and ask("lexer") == ["stop"] and ask("  ") == [] and ask(" run ") == ["run"]
    assert sorted(ask("zzz", anchor_file="main.rs")) == ["main", "run", "stop"] and sorted(ask("zzz", anchor_file="src/x.rs")) == ["run", "stop"]
    assert ask("r", kinds=["method"]) == ["run"]


SOURCE = """mod a {
pub fn outer(x: u8) {
    helper(x);
    if (x > 1) { other (x) }
}
impl Into<Vec<String>> for some::path::Thing<T> {
    fn show(&self) {}
}
}
trait Shape {
}
"""


def test_functions_and_hints(spark):
    files = spark.createDataFrame([("src/a.rs", SOURCE), ("src/m/mod.rs", "fn z() {\n}\n"), ("b.py", "fn odd() {\n")], "file string, content string")
    found = {(r.file, r.name): r for r in anchors.functions(files).collect()}
    assert {k: (r.start, r.end, r.kind, r.qualified_name) for k, r in found.items() if k[0] == "src/a.rs"} == {("src/a.rs", "a"): (1, 9, "module", "src::a::a"), ("src/a.rs", "outer"): (2, 5, "function", "src::a::outer"), ("src/a.rs", "Thing"): (6, 8, "impl", "src::a::Thing"), ("src/a.rs", "show"): (7, 7, "method", "src::a::show"), ("src/a.rs", "Shape"): (10, 11, "trait", "src::a::Shape")}
    assert found["src/m/mod.rs", "z"].qualified_name == "src::m::z" and found["b.py", "odd"].qualified_name == "b::odd" and found["b.py", "odd"].end == 51
    marks = spark.createDataFrame([(1, "src/a.rs", 3), (2, "src/a.rs", 40), (3, "no.rs", 1), (4, "src/a.rs", 10)], "point_id int, file string, line int")
    got = {r.point_id: r for r in anchors.hints(marks, anchors.functions(files), files).collect()}
    assert (got[1].status, got[1].function.name, got[1].offset) == ("good", "outer", 1) and (got[4].function.name, got[4].offset) == ("Shape", 0)
    assert got[2].status == "outside_scope" and [x.name for x in got[2].nearest] == ["Shape", "a", "Thing"] and got[3].status == "not_a_file"
    said = {r.point_id: r.json for r in anchors.why(anchors.hints(marks, anchors.functions(files), files)).collect()}
    assert '"status":"Good"' in said[1] and '"offset":1' in said[1] and '"offset"' not in said[4] and '"reason":"File does not exist"' in said[3]


def test_off_by_n(spark):
    marks = spark.createDataFrame([(1, "f", 9)], "point_id int, file string, line int")
    spans = spark.createDataFrame([("f", "g", "q::g", 2, 5, "function", 0.9)], "file string, name string, qualified_name string, start long, end long, kind string, confidence float")
    assert anchors.hints(marks, spans, marks.select("file")).first().status == "outside_scope"
    inside = anchors.hints(marks.withColumn("line", F.lit(5)), spans, marks.select("file")).withColumn("status", F.lit("off_by_n"))
    assert '"reason":"Line is 3 lines from function start"' in anchors.why(inside).first().json


@pytest.mark.parametrize("lines, start, end", [(["fn a() {", "}", "}"], 1, 2), (["fn a() {}", "x", "}"], 1, 3), (["fn a() {", "{ }", "}"], 1, 3), (["fn a();"], 1, 51)])
def test_guessed_ends(lines, start, end):
    assert anchors.guessed_end(lines, start) == end


def test_calls(spark):
    lines = callgraph.number_lines(spark.createDataFrame([("src/a.rs", SOURCE)], "file string, content string"))
    marks = spark.createDataFrame([(1, "src/a.rs", 4), (2, "src/a.rs", 99), (3, "x.rs", 1), (4, "src/a.rs", 1)], "point_id int, file string, line int")
    assert {r.point_id: r.owner for r in callgraph.owners(lines, marks).collect()} == {1: "outer", 2: "show", 3: None, 4: "outer"}
    assert {(r.name, r.hop) for r in callgraph.hop_map(lines, marks).where("point_id = 1").collect()} == {("outer", 0), ("helper", 1), ("other", 1), ("show", 1)}
    assert [r.name for r in callgraph.calls_near(lines, marks, 1).where("point_id = 1").orderBy("name").collect()] == ["helper", "other"]
    spec = callgraph.parse_spec("depth=9 edges=2 files_per_hop=0 x=1 depth=z anchor=src/a.rs:4")
    assert spec == callgraph.CallSpec("src/a.rs", 4, 6, 1, 50) and callgraph.parse_spec("depth=2") is None and callgraph.parse_spec(None, "f", 3).edges == 500
    assert [r.name for r in callgraph.call_names(lines, spec).collect()] == ["helper", "other", "outer", "show"]
    assert callgraph.augmented(["a", "b", "a"], " T :: m", ["b", "c"]) == ["a", "b", "trait T", "impl T for", "T::m", "c"] and callgraph.augmented(["a"], "T::") == ["a"]
    items = spark.createDataFrame([("i", "src/a.rs", 4, 100), ("j", "src/a.rs", 7, 100), ("t", None, None, 200)], "id string, file string, start long, level int")
    assert {r.id: r.level for r in callgraph.raised_by_calls(items, lines, "src/a.rs", 4).collect()} == {"i": 112, "j": 105, "t": 200}  # in single precision 100 * 1.06 is less than 106


def test_patch_output(spark):
    said = ["error: patch failed: src/a.rs:12", "error: src/a.rs: patch does not apply", "error: b.py: does not match index", "x.py:3: trailing whitespace error", "/etc/x is outside repository", "Binary files a/x and b/x differ", "submodule merge conflict in z", "error: pathspec 'q/r' did not match any files", "fatal: no: way", "fine"]
    rows = spark.createDataFrame([("l", i, s) for i, s in enumerate(said)], "log string, line_no int, line string")
    got = patching.conflicts(rows).orderBy("line_no").collect()
    assert [(r.kind, r.path) for r in got] == [("other", None), ("preimage_mismatch", "src/a.rs"), ("index_required", "b.py"), ("whitespace_error", "x.py:3"), ("outside_repo", "/etc/x"), ("binary_or_mode", "a/x"), ("other", None), ("outside_repo", "'q/r'"), ("other", None)]
    assert patching.summaries(patching.conflicts(rows)).first().text.startswith("Conflicts (9)\n  • Other: error: patch failed")
    lines = [r.s for r in patching.conflicts(rows).orderBy("line_no").select(patching.summary_line(F.col("kind"), F.col("path"), F.col("message")).alias("s")).collect()]
    assert lines[1] == "src/a.rs:0:0 preimage_mismatch" and lines[8] == "unknown:0:0 fatal; no; way"
    files = spark.createDataFrame([("a", "x\n=======\n"), ("b", "y")], "file string, content string")
    assert [r.file for r in patching.marked_files(files).collect()] == ["a"]


def test_paths(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert tuple(one(P.item_place(F.lit("C:\\a.rs:3-9")))) == ("C:\\a.rs", 3, 9) and one(P.item_place(F.lit("a.rs:3"))) is None
    assert tuple(one(P.place(F.lit("a:b:7")))) == ("a:b", 7) and one(P.place(F.lit("a:b"))) is None
    assert one(P.in_folder_of(F.lit("src/x.rs"), "src/a.rs", "/r")) and not one(P.in_folder_of(F.lit("src/a.rs"), "src/a.rs", "/r")) and not one(P.in_folder_of(F.lit("srcs/x.rs"), "src/a.rs", "/r")) and one(P.in_folder_of(F.lit("x.rs"), "a.rs", "/r"))
    assert one(P.repo_relative(F.lit("./a//b/."))) == "a/b" and one(P.repo_relative(F.lit("a/../b"))) is None and one(P.repo_relative(F.lit("."))) is None
    assert [tuple(r) for r in one(P.strict_ranges(F.lit("f:5,1-3,4")))] == [(1, 5)] and one(P.strict_ranges(F.lit("f:3-1"))) is None and one(P.strict_ranges(F.lit("f:0"))) is None and one(P.strict_ranges(F.lit("f"))) is None
    text = F.lit("ab\r\nü\n\nx")
    assert [tuple(one(P.line_bytes(text, F.lit(i), F.lit(i)))) for i in (1, 2, 3, 4)] == [(0, 2), (4, 6), (7, 7), (8, 9)]
    assert one(P.line_bytes(text, F.lit(5), F.lit(5))) is None and tuple(one(P.line_bytes(text, F.lit(2), F.lit(99)))) == (4, 9) and one(P.open_line_count(F.lit("a\n"))) == 2
    assert [one(P.line_of_byte(text, F.lit(i))) for i in (0, 2, 3, 4, 99)] == [1, 1, 2, 2, 4] and one(P.line_of_byte(F.lit(""), F.lit(0))) == 0


def test_templates(tmp_path):
    assert P.template(None, ["a"]) == "" and "symbols: a, b." in P.template("refactor", ["a", "b"])
    (tmp_path / "t").write_bytes(b"x\r\ny")
    assert P.template(str(tmp_path / "t"), []) == "x\ny\n"


def test_board(spark, tmp_path):
    (tmp_path / "plan.json").write_text('{"encoding": "e", "scenarios": [{"name": "s", "fixture_path": "f", "queries": ["q"], "tier": "B", "budget": 500, "probe_first": true}, {"name": "t", "fixture_path": "f", "queries": [], "tier": null, "budget": 9}]}')
    plan = board.read_plan(spark, str(tmp_path / "plan.json"))
    items = spark.createDataFrame([("s", 1, "C:\\a.rs:1-2", 10, "x"), ("s", 2, "b.rs:1-2", 20, "y"), ("s", 3, "b.rs:1-2", 20, "y"), ("s", 4, "none", 0, "")], "name string, pos int, id string, tokens long, content string")
    whole = spark.createDataFrame([("C:\\a.rs", 60), ("b.rs", 40), ("c.rs", 1000)], "path string, tokens long")
    rows = {r.name: r for r in board.board(plan, items, items.withColumn("content", F.when(F.col("pos") == 4, "z").otherwise(F.col("content"))), whole).collect()}
    s, t = rows["s"], rows["t"]
    assert (s.cef, s.dcr, s.pfr, s.actual_tokens, s.baseline_tokens, s.within_budget, s.items_count, s.deterministic_json_equal) == (2.0, 0.25, 1.0, 50, 100, True, 4, False)
    assert (t.cef, t.dcr, t.pfr, t.items_count, t.deterministic_json_equal) == (0.0, 0.0, 0.0, 0, True)
    board.write_board(board.board(plan, items, items, whole), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_overflow_and_tails(spark):
    rows = spark.createDataFrame([("b", i, t) for i, t in (("a", 50), ("b", 30), ("c", 30))], "bucket string, id string, tokens long")
    assert sorted(r.id for r in fit.trim_tail(rows, 85).collect()) == ["a", "c"] and fit.trim_tail(rows, 110).count() == 3
    kept, gone = fit.overflow(rows, 60)
    assert sorted(r.id for r in kept.collect()) == ["b", "c"] and [tuple(r) for r in gone.collect()] == [("a", "mixed", "budget-overflow")]


def test_empty_items_at_the_end(spark):
    rows = spark.createDataFrame([("b", "a", 0), ("b", "z", 0), ("b", "c", 5), ("b", "d", 9), ("e", "x", 0), ("e", "y", 3)], "bucket string, id string, tokens long")
    keep = lambda most: sorted(r.id for r in fit.trim_tail(rows, most).collect())
    assert keep(20) == ["a", "c", "d", "x", "y", "z"] and keep(9) == ["d", "x", "y"] and keep(2) == []
    assert sorted(r.id for r in fit.overflow(rows, 8)[1].collect()) == ["a", "c", "d"]
    assert fit.overflow(rows, 100)[1].count() == 0 and fit.overflow(rows, 100)[0].count() == 6
