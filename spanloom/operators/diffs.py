"""Line differences by longest common subsequence, as hunks and as unified text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .edits import text_lines

HUNKS = "array<struct<old_start: bigint, old_lines: bigint, new_start: bigint, new_lines: bigint, lines: array<struct<kind: string, text: string>>>>"


def common_lengths(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Longest common subsequence of every pair of suffixes, (len(old) + 1) x (len(new) + 1); a row at a time in numpy."""
    table = np.zeros((len(old) + 1, len(new) + 1), np.int32)
    for i in range(len(old) - 1, -1, -1):
        step = np.where(new == old[i], table[i + 1, 1:] + 1, table[i + 1, :-1])
        table[i, :-1] = np.maximum.accumulate(step[::-1])[::-1]
    return table


def script(old: list[str], new: list[str], removed_first: bool = False) -> list[tuple[str, str]]:
    """(kind, line) with kind ' ', '+' or '-': a shortest script; where both will do additions come first, or removals.

    Equal lines at both ends are put aside, as some longest subsequence holds them.
    """
    head = 0
    while head < min(len(old), len(new)) and old[head] == new[head]:
        head += 1
    tail = 0
    while tail < min(len(old), len(new)) - head and old[-1 - tail] == new[-1 - tail]:
        tail += 1
    a, b = old[head : len(old) - tail], new[head : len(new) - tail]
    number = {x: i for i, x in enumerate(dict.fromkeys([*a, *b]))}
    x, y = (np.array([number[t] for t in s], np.int64) for s in (a, b))
    table, out, i, j = common_lengths(x, y), [(" ", t) for t in old[:head]], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and x[i] == y[j]:
            out.append((" ", a[i]))
            i, j = i + 1, j + 1
        elif j < len(b) and (i == len(a) or table[i, j + 1] >= table[i + 1, j] + removed_first):
            out.append(("+", b[j]))
            j += 1
        else:
            out.append(("-", a[i]))
            i += 1
    return out + [(" ", t) for t in old[len(old) - tail :]]


def hunks(old: list[str], new: list[str], context: int = 3, removed_first: bool = False) -> list[tuple[int, int, int, int, list[tuple[str, str]]]]:
    """(old start, old lines, new start, new lines, script) of each run of changes with its context; runs whose contexts meet are one."""
    steps = script(old, new, removed_first)
    changed = np.flatnonzero([k != " " for k, _ in steps])
    if not len(changed):
        return []
    cuts = np.flatnonzero(np.diff(changed) > 2 * context + 1) + 1
    before = {k: np.concatenate([[0], np.cumsum([s[0] != other for s in steps])]) for k, other in (("old", "+"), ("new", "-"))}
    out = []
    for run in np.split(changed, cuts):
        a, b = max(int(run[0]) - context, 0), min(int(run[-1]) + context + 1, len(steps))
        n, m = (int(before[k][b] - before[k][a]) for k in ("old", "new"))
        out.append((int(before["old"][a]) + (n > 0), n, int(before["new"][a]) + (m > 0), m, steps[a:b]))
    return out


def rendered(file: str, parts: list[tuple]) -> str:
    """Unified text of hunks, with a/ and b/ before the file's name; empty without hunks."""
    if not parts:
        return ""
    body = [f"@@ -{a},{n} +{b},{m} @@\n" + "".join(f"{k}{t}\n" for k, t in steps) for a, n, b, m, steps in parts]
    return f"--- a/{file}\n+++ b/{file}\n" + "".join(body)


def diff(pairs: DataFrame, context: int = 3, removed_first: bool = False) -> DataFrame:
    """(file, hunks, patch) of pairs (file, old, new) that differ; a null side is an empty file. A file is compared by one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, old, new in zip(batch["file"], batch["old"], batch["new"]):
                parts = hunks(text_lines(old or ""), text_lines(new or ""), context, removed_first)
                shown = [{"old_start": a, "old_lines": n, "new_start": b, "new_lines": m, "lines": [{"kind": k, "text": t} for k, t in steps]} for a, n, b, m, steps in parts]
                rows.append((file, shown, rendered(file, parts)))
            yield pd.DataFrame(rows, columns=["file", "hunks", "patch"])

    differ = pairs.select("file", "old", "new").where(~F.coalesce(F.col("old"), F.lit("")).eqNullSafe(F.coalesce(F.col("new"), F.lit(""))))
    return differ.mapInPandas(run, f"file string, hunks {HUNKS}, patch string")


def applied(old: list[str], parts: list[tuple]) -> list[str]:
    """The new lines that hunks make of old ones; raises where the context is another."""
    out, at = [], 0
    for a, n, _, _, steps in parts:
        start = a - (n > 0)
        out += old[at:start]
        if old[start : start + n] != [t for k, t in steps if k != "+"]:
            raise ValueError(f"the lines at {a} are not those of the hunk")
        out += [t for k, t in steps if k != "-"]
        at = start + n
    return out + old[at:]
