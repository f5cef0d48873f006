"""What a patch tool's output says, and applying edits through it or without it."""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bpe
from . import backups, diffs, edits

#: What a line of an error says, its kind, and the advice that goes with it; the first that fits counts.
MESSAGES = (
    ((r"patch does not apply",), "preimage_mismatch", "Target lines changed since suggestion. Try `--engine auto` or regenerate."),
    ((r"does not match index",), "index_required", "Requires clean index. Commit or stash changes, or use `--git-mode 3way`."),
    ((r"whitespace error",), "whitespace_error", "Whitespace sensitivity blocked apply. Try `--whitespace nowarn`."),
    ((r"is outside repository",), "outside_repo", "Edits must target tracked files within the repo root."),
    ((r"Binary files", r"differ"), "binary_or_mode", "Binary file conflict. Manual resolution required."),
    ((r"submodule merge conflict",), "submodule", None),
    ((r"pathspec", r"did not match any files"), "outside_repo", "File not tracked or outside sparse-checkout. Check visibility rules."),
    ((r"error:|fatal:",), "other", None),
)
#: Where a line names its path, in order of trust.
PATHS = (r"patch failed:\s+(.+?):\d+", r"Merge conflict in\s+(.+)", r"^(.+?): needs merge", r"Binary files\s+(.+?)\s+and\s+.+\s+differ", r"error:\s+(.+?):\s+patch does not apply")
#: Kinds in words.
WORDS = {"preimage_mismatch": "preimage mismatch", "index_required": "index required", "whitespace_error": "whitespace error", "outside_repo": "outside repository", "binary_or_mode": "binary or mode change"}
#: An error's class by what it says, and the process's exit code.
EXIT_CODES = (("conflict|merge", 2), ("git|repo", 4), ("EBNF|syntax|parse", 3))
OTHER_EXIT = 5


def path_in(line: Column) -> Column:
    """The path that a line names, else its first word that looks like one; null without either."""
    found = F.coalesce(*[F.when(line.rlike(p), F.trim(F.regexp_extract(line, p, 1))) for p in PATHS])
    word = F.get(F.filter(F.split(line, r"(?U)\s+"), lambda w: w.contains(".rs") | w.contains(".py") | w.contains("/")), F.lit(0))
    return F.coalesce(found, F.regexp_replace(word, '^[:,"]+|[:,"]+$', ""))


def conflicts(lines: DataFrame) -> DataFrame:
    """(log, line_no, kind, path, message, hint) of lines (log, line_no, line) that say why a patch failed."""
    line = F.regexp_replace("line", r"(?U)^\s+|\s+$", "")
    fits = lambda words: [line.rlike(w) for w in words]
    kind, hint = F.lit(None).cast("string"), F.lit(None).cast("string")
    for words, name, advice in reversed(MESSAGES):
        both = fits(words)[0] if len(words) == 1 else fits(words)[0] & fits(words)[1]
        kind, hint = F.when(both, name).otherwise(kind), F.when(both, F.lit(advice).cast("string")).otherwise(hint)
    message = F.when(kind == "submodule", F.concat(F.lit("submodule: "), line)).when(kind == "other", line)
    path = F.when(~kind.isin("submodule", "other"), F.coalesce(path_in(line), F.lit("unknown")))
    return lines.select("log", "line_no", F.when(kind == "submodule", "other").otherwise(kind).alias("kind"), path.alias("path"), message.alias("message"), hint.alias("hint")).where("kind is not null")


def summary_line(kind: Column, path: Column, message: Column) -> Column:
    """path:0:0 kind, for scripts."""
    return F.when(kind == "other", F.concat(F.lit("unknown:0:0 "), F.replace(message, F.lit(":"), F.lit(";")))).otherwise(F.concat(path, F.lit(":0:0 "), kind))


def summaries(found: DataFrame) -> DataFrame:
    """(log, text): each log's conflicts for people, in order."""
    words = F.element_at(F.create_map(*[F.lit(x) for kv in WORDS.items() for x in kv]), F.col("kind"))
    row = F.when(F.col("kind") == "other", F.concat(F.lit("  • Other: "), "message", F.lit("\n    Remedy: Check git output with `--verbose`\n"))).otherwise(F.concat(F.lit("  • "), "path", F.lit(": "), words, F.lit("\n    Remedy: "), "hint", F.lit("\n")))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("line_no", row.alias("row")))), lambda x: x["row"])
    return found.groupBy("log").agg(F.concat(F.format_string("Conflicts (%d)\n", F.count("*")), F.array_join(rows, "")).alias("text"))


def applied_files(lines: DataFrame) -> DataFrame:
    """(log, line_no, path) of lines that tell of a file being patched."""
    line = F.col("line")
    return lines.where(line.contains("Applying") | line.contains("patching file")).select("log", "line_no", path_in(line).alias("path")).where("path is not null")


def marked_files(files: DataFrame) -> DataFrame:
    """Of files (file, content) those with marks of a conflict anywhere."""
    c = F.col("content")
    return files.where(c.contains("<<<<<<<") | c.contains(">>>>>>>") | c.contains("======="))


def exit_code(message: Column) -> Column:
    out = F.lit(OTHER_EXIT)
    for words, code in reversed(EXIT_CODES):
        out = F.when(message.rlike(words), code).otherwise(out)
    return out


def apply_here(root: str, ops: dict[str, list[dict]], engine: str = "auto", backup: bool = True, check_only: bool = False, git_mode: str = "worktree", whitespace: str = "nowarn", vocab: str | None = None) -> dict:
    """Edits files of a tree on this machine's disk: {engine, files, problems, session}.

    internal edits by line spans. git hands git apply the difference that the edits make. auto is internal, and git where that
    finds problems. git_mode: worktree, index (the index goes along) or 3way; whitespace: what git does about it. Files are
    written one by one, whole, after a session of backups; with a problem none is. vocab: see edits.apply_edits().
    """
    modes = {"worktree": [], "index": ["--index"], "3way": ["--3way"]}
    if engine not in ("internal", "git", "auto") or git_mode not in modes or whitespace not in ("nowarn", "warn", "fix"):
        raise ValueError(f"no such engine or mode: {engine}, {git_mode}, {whitespace}")
    command = ["git", "-C", root, "apply", f"--whitespace={whitespace}", *modes[git_mode]]
    encode = (lambda t: bpe.encode(t, vocab)) if vocab else None
    texts, bad, new = {}, {}, {}
    for file in ops:
        with open(f"{root}/{backups.inside(file)}", encoding="utf-8", newline="") as f:
            texts[file] = f.read()
        found = edits.problems(texts[file], ops[file])
        if found:
            bad[file] = found
        else:
            new[file] = edits.applied(texts[file], ops[file], encode)
    used = "git" if engine == "git" or (engine == "auto" and bad) else "internal"
    out = {"engine": used, "files": sorted(new), "problems": bad, "session": None}
    if used == "git":
        wanted = {f: new.get(f, texts[f]) for f in ops}
        patch = "".join(diffs.rendered(f, diffs.hunks(edits.text_lines(texts[f]), edits.text_lines(wanted[f]))) for f in sorted(ops))
        if bad or not patch:
            return out
        done = subprocess.run([*command, "--check", "-"], input=patch, capture_output=True, text=True, timeout=60, check=False)
        if done.returncode:
            return out | {"problems": {"git": done.stderr.splitlines()}}
    elif bad:
        return out
    if check_only:
        return out
    if backup and new:
        session = backups.Session(root, used)
        for f in sorted(new):
            session.add(f)
        out["session"] = session.id
    if used == "git":
        subprocess.run([*command, "-"], input=patch, capture_output=True, text=True, timeout=60, check=True)
    else:
        for f, text in new.items():
            backups.write_whole(f"{root}/{f}", text.encode())
    if out["session"]:
        session.finish(True)
    return out
