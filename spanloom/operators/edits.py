"""Edit specs: grammar, checks against the files, and application.

A spec names files and, for each, operations on line spans. Parsing, checking and applying each take a table and spread over
its rows; a file meets all of its operations in one row, so a task holds one file at a time.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPS = "file string, pos int, op string, start_line long, end_line long, at_line long, old_content string, new_content string, guard_cid string"
#: Words that begin a directive and so end an unfenced body.
DIRECTIVES = ("FILE:", "REPLACE lines", "INSERT at", "DELETE lines", "GUARD-CID:", "OLD:", "NEW:")


class SpecError(ValueError):
    """A spec that does not follow the grammar."""


def normalised(text: str) -> str:
    """Lines without blanks at their ends, joined by line feeds; what guards and old contents are compared by."""
    return "\n".join(x.rstrip(" \t\r") for x in text_lines(text))


def content_id(text: str) -> str:
    return f"{xxhash.xxh64_intdigest(normalised(text).encode(), seed=0):016x}"


def text_lines(text: str) -> list[str]:
    """Lines without their ends; a final line break opens no line."""
    out = text.split("\n")
    if out[-1] == "":
        out.pop()
    return [x.removesuffix("\r") for x in out]


def _count(text: str) -> int:
    if not re.fullmatch(r"\+?[0-9]+", text.strip()):
        raise SpecError(f"Invalid line number: {text}")
    return int(text)


def _span(text: str) -> tuple[int, int]:
    ends = [_count(x) for x in text.split("-")]
    if len(ends) > 2 or min(ends) < 1 or ends[0] > ends[-1]:
        raise SpecError(f"Invalid span: {text}")
    return ends[0], ends[-1]


class _Spec:
    """A cursor over a spec's lines."""

    def __init__(self, text: str):
        self.lines = text_lines(text.removeprefix("﻿").replace("\r", ""))
        self.at = 0

    def more(self) -> bool:
        return self.at < len(self.lines)

    def take(self) -> str:
        self.at += 1
        return self.lines[self.at - 1]

    def body(self, marker: str, exact_fence: bool) -> str:
        """The text after a marker: a fenced block, or all up to the next directive (an OLD: part goes on to NEW:)."""
        if not self.more() or not self.lines[self.at].strip().startswith(marker):
            raise SpecError(f"Expected {marker} at line {self.at + 1}")
        self.take()
        if self.more() and not self.lines[self.at].strip():
            self.take()
        out: list[str] = []
        fence = re.match(r"\s*(`{3,})", self.lines[self.at]) if self.more() else None
        if fence:
            self.take()
            closing = re.compile(r"\s*`{%d,}[`\s]*$" % len(fence[1]) if exact_fence else r"\s*```")
            while self.more():
                line = self.take()
                if closing.match(line):
                    break
                out.append(line)
        else:
            stop = ("NEW:",) if marker == "OLD:" else DIRECTIVES
            while self.more() and not self.lines[self.at].lstrip().startswith(stop):
                out.append(self.take())
        return "\n".join(out)

    def operation(self, head: str, guard: str | None) -> dict:
        if head.startswith("REPLACE lines"):
            if not head.endswith(":"):
                raise SpecError(f"Invalid REPLACE syntax: {head}")
            a, b = _span(head[len("REPLACE lines") : -1].strip())
            return {"op": "replace", "start_line": a, "end_line": b, "old_content": self.body("OLD:", False), "new_content": self.body("NEW:", False), "guard_cid": guard}
        if head.startswith("INSERT at"):
            if not head.endswith(":"):
                raise SpecError(f"Invalid INSERT syntax: {head}")
            return {"op": "insert", "at_line": _count(head[len("INSERT at") : -1].strip()), "new_content": self.body("NEW:", True)}
        if head.startswith("DELETE lines"):
            a, b = _span(head[len("DELETE lines") :].strip())
            return {"op": "delete", "start_line": a, "end_line": b}
        raise SpecError(f"Unknown directive: {head}")


def parse_spec(text: str) -> list[dict]:
    """The operations of a spec in order; lines before the first FILE:, blank lines and # comments are passed over."""
    spec, file, out = _Spec(text), None, []
    while spec.more():
        line = spec.take().strip()
        if not line or line.startswith("#"):
            continue
        if line.startswith("FILE:"):
            file = line[len("FILE:") :].strip()
            if not file:
                raise SpecError("Empty file path")
        elif file is not None:
            guard = None
            if line.startswith("GUARD-CID:"):
                guard = line[len("GUARD-CID:") :].strip()
                if not spec.more():
                    raise SpecError("GUARD-CID without operation")
                line = spec.take().strip()
                if not line:
                    continue
            out.append({"file": file, "pos": len(out), **spec.operation(line, guard)})
    return out


def parse_specs(specs: DataFrame) -> DataFrame:
    """(spec, operations' columns, error) of (spec, text): a row an operation, or one with an error and no operation."""
    names = [x.split()[0] for x in OPS.split(", ")]
    kind = dict(specs.dtypes)["spec"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for spec, text in zip(batch["spec"], batch["text"]):
                try:
                    rows += [(spec, *(op.get(n) for n in names), None) for op in parse_spec(text or "")]
                except SpecError as e:
                    rows.append((spec, *[None] * len(names), str(e)))
            out = pd.DataFrame(rows, columns=["spec", *names, "error"])
            for n in ("pos", "start_line", "end_line", "at_line"):
                out[n] = out[n].astype("Int64" if n != "pos" else "Int32")
            yield out

    return specs.select("spec", "text").mapInPandas(run, f"spec {kind}, {OPS}, error string")


def problems(content: str, ops: list[dict]) -> list[str]:
    """What speaks against applying ops: spans beyond the file, other content than expected, overlaps."""
    lines, out = text_lines(content), []
    for op in ops:
        if op["op"] == "insert":
            if op["at_line"] > len(lines):
                out.append(f"span-out-of-range {op['at_line']}-{op['at_line']} of {len(lines)}")
            continue
        a, b = op["start_line"], op["end_line"]
        if min(a, b) < 1 or max(a, b) > len(lines):
            out.append(f"span-out-of-range {a}-{b} of {len(lines)}")
        elif op["op"] == "replace":
            there = "\n".join(lines[a - 1 : b])
            if op.get("guard_cid") is not None:
                if op["guard_cid"] != content_id(there):
                    out.append(f"content-mismatch {op['guard_cid']} is {content_id(there)}")
            elif normalised(op["old_content"] or "") != normalised(there):
                out.append(f"old-content-mismatch {a}-{b}")
    spans = sorted((o["start_line"], o["end_line"]) for o in ops if o["op"] != "insert")
    out += [f"overlap {a}-{b} with {c}-{d}" for (a, b), (c, d) in zip(spans, spans[1:]) if c <= b]
    out += [f"insert-overlap {o['at_line']} in {a}-{b}" for o in ops if o["op"] == "insert" for a, b in spans if a <= o["at_line"] <= b]
    return out


def locate(lines: list[str], old: str, encode: Callable[[str], list[int]]) -> tuple[int, int] | None:
    """The lines of the first place that holds old, if old's tokens are a run of the text's tokens."""
    text, wanted = "\n".join(lines), normalised(old)
    run = np.array(encode(wanted), "<u4").tobytes()
    all_ = np.array(encode(normalised(text)), "<u4").tobytes()
    at = all_.find(run) if run else -1
    while at % 4 and at >= 0:
        at = all_.find(run, at + 1)
    if at < 0 or (place := text.find(wanted)) < 0:
        return None
    first = text.count("\n", 0, place) + 1
    return first, first + wanted.count("\n")


def applied(content: str, ops: list[dict], encode: Callable[[str], list[int]] | None = None) -> str:
    """content with ops done from the last line up; line ends and a final line break stay as the file has them.

    A replacement takes its lines as given, as problems() has found its old content there; with a tokenizer's encode it
    goes to the first place whose tokens are those of the old content, if there is one.
    """
    lines = text_lines(content)
    first = content.find("\n", 1)
    end = "\r\n" if first > 0 and content[first - 1] == "\r" else "\n"
    rank = {"delete": 0, "replace": 1, "insert": 2}
    place = lambda o: (o["at_line"],) * 2 if o["op"] == "insert" else (o["start_line"], o["end_line"])
    for op in sorted(ops, key=lambda o: (-place(o)[0], rank[o["op"]], -place(o)[1])):
        new = text_lines(op["new_content"] or "") if op["op"] != "delete" else []
        a, b = place(op)
        if encode is not None and op["op"] == "replace":
            a, b = locate(lines, op["old_content"] or "", encode) or (a, b)
        lines[a if op["op"] == "insert" else a - 1 : b] = new
    return end.join(lines) + (end if content.endswith("\n") else "")


def apply_edits(files: DataFrame, ops: DataFrame, vocab: str | None = None) -> DataFrame:
    """(file, content, problems) for each file that ops name: the new content, or null with what speaks against it.

    A file that is not there has the problem file-missing. With a vocabulary replacements go where their old tokens are found
    first. Nothing is written.
    """
    from ..functions import bpe

    each = ops.groupBy("file").agg(F.to_json(F.array_sort(F.collect_list(F.struct("pos", "op", "start_line", "end_line", "at_line", "old_content", "new_content", "guard_cid")))).alias("ops"))
    both = each.join(files.select("file", F.col("content")), "file", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, ops_, content in zip(batch["file"], batch["ops"], batch["content"]):
                todo = json.loads(ops_)
                bad = ["file-missing"] if content is None else problems(content, todo)
                rows.append((file, None if bad else applied(content, todo, (lambda t: bpe.encode(t, vocab)) if vocab else None), bad))
            yield pd.DataFrame(rows, columns=["file", "content", "problems"])

    return both.select("file", "ops", "content").mapInPandas(run, "file string, content string, problems array<string>")


def render_patch(files: DataFrame, edited: DataFrame, context: int = 3) -> DataFrame:
    """(file, patch): unified diffs between files and edited, for those that differ and have no problems."""
    from . import diffs

    both = edited.where("content is not null").select("file", F.col("content").alias("new")).join(files.select("file", F.col("content").alias("old")), "file")
    return diffs.diff(both, context, removed_first=True).select("file", "patch").where("patch <> ''")
