"""Symbols of Rust and Python sources: (file, lang, kind, name, qualified_name, byte_start, byte_end, start_line, end_line, visibility, doc).

One file is parsed by one task; files spread. A scanner over masked source finds Rust items (no grammar is at hand);
Python goes through the standard syntax tree, so a file that does not parse gives no rows.
"""

from __future__ import annotations

import ast
import bisect
import inspect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X

SCHEMA = "file string, lang string, kind string, name string, qualified_name string, byte_start long, byte_end long, start_line long, end_line long, visibility string, doc string"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
#: Kinds by the item's keyword.
KINDS = {"fn": "function", "struct": "struct", "enum": "enum", "trait": "trait", "type": "type_alias", "const": "constant", "static": "variable", "mod": "module"}

_OPAQUE = re.compile(r"""//[^\n]*|/\*|\bb?r(?P<hash>#*)".*?"(?P=hash)|b?"(?:\\.|[^"\\])*"|b?'(?:\\.[^']*|[^\\'])'""", re.S)
_ITEM = re.compile(r"""(?P<vis>pub(?:\s*\([^)]*\))?\s+)?(?:(?:default|async|unsafe|const(?=\s+(?:async|unsafe|extern|fn)\b)|extern(?:\s*"[^"]*")?)\s+)*(?P<word>fn|struct|enum|trait|type|const|static|mod|impl)\b(?:\s+(?:mut\s+)?(?P<name>(?:r\#)?[A-Za-z_\x80-\xff][\w\x80-\xff]*))?""")
_MACRO = re.compile(r"\b[A-Za-z_]\w*!\s*(?:[A-Za-z_]\w*\s*)?([\(\[\{])")
_PAIRS = {"(": ")", "[": "]", "{": "}"}


def _blank(s: str) -> str:
    return re.sub(r"[^\n]", " ", s)


def _masked(src: str) -> str:
    """src with comments and literals blank, quotes of strings kept, all at their places."""
    out, at = [], 0
    while m := _OPAQUE.search(src, at):
        end = m.end()
        if m[0] == "/*":
            depth = 1
            while depth and (n := re.compile(r"/\*|\*/").search(src, end)):
                depth += 1 if n[0] == "/*" else -1
                end = n.end()
            end = end if not depth else len(src)
        out.append(src[at : m.start()])
        body = _blank(src[m.start() : end])
        out.append('"' + body[1:-1] + '"' if src[end - 1] == '"' and len(body) > 1 else body)
        at = end
    return "".join([*out, src[at:]])


def _close(s: str, at: int) -> int:
    """The place after the bracket that closes the one at `at`; the end of s if none does."""
    stack = []
    for m in re.compile(r"[()\[\]{}]").finditer(s, at):
        if m[0] in _PAIRS:
            stack.append(_PAIRS[m[0]])
        elif stack and m[0] == stack[-1]:
            stack.pop()
        if not stack:
            return m.end()
    return len(s)


def _end(s: str, at: int, block_ends: bool) -> tuple[int, int]:
    """(end, body): where an item from `at` ends, and its block's start or -1; brackets are stepped over."""
    while m := re.compile(r"[;{(\[}]").search(s, at):
        if m[0] in ";}":
            return (m.end() if m[0] == ";" else m.start()), -1
        if m[0] == "{" and block_ends:
            return _close(s, m.start()), m.start()
        at = _close(s, m.start())
    return len(s), -1


def _owner(s: str, at: int, body: int) -> str:
    """The type that an impl is for, as written."""
    head = s[at:body]
    if head.lstrip().startswith("<"):
        depth = 0
        for i, c in enumerate(head):
            depth += (c == "<") - (c == ">" and head[i - 1 : i] != "-")
            if c == ">" and not depth:
                head = head[i + 1 :]
                break
    head = re.split(r"\bwhere\b", head)[0]
    return re.split(r"\bfor\b(?!\s*<)", head)[-1].strip()


def _docs(src: str, start: int) -> str | None:
    """The /// and /** */ comments right before an item, without their marks."""
    found, head = [], src[:start].rstrip(" \t")
    while True:
        head = head.rstrip()
        line = head[head.rfind("\n") + 1 :]
        if line.strip().startswith("///"):
            found.append(line.strip()[3:].strip())
            head = head[: len(head) - len(line)]
        elif head.endswith("*/") and (at := head.rfind("/*")) >= 0 and head.startswith("/**", at):
            found.append(head[at + 3 : -2].strip())
            head = head[:at]
        else:
            break
    found = found[::-1]
    return "\n".join(found) if found else None


def rust_symbols(file: str, content: str) -> list[tuple]:
    """Functions, types, constants, modules, methods with bodies. A method's owner is its impl's type or its trait; other items carry their modules."""
    src = content.encode().decode("latin-1")  # a character a byte, so places are byte offsets
    text = _masked(src)
    parts, at = [], 0
    while m := _MACRO.search(text, at):  # what a macro is given holds no items
        end = max(_close(text, m.start(1)) - 1, m.end())
        parts += [text[at : m.end()], _blank(text[m.end() : end])]
        at = end
    text = "".join([*parts, text[at:]])
    plain = lambda s: s.encode("latin-1").decode(errors="replace")
    breaks = [m.start() for m in re.finditer("\n", text)]
    line = lambda at: bisect.bisect_left(breaks, at) + 1
    out: list[tuple] = []
    open_: list[tuple[int, str, str, int]] = []  # (end, word, name, start of the block) of the items around
    at = 0
    while m := _ITEM.search(text, at):
        at = m.end()
        before = text[: m.start()].rstrip()[-1:]
        if before and before not in "{};]" or text[m.start() - 1 : m.start()].isalnum() or (m["name"] is None and m["word"] != "impl"):
            continue
        word, name = m["word"], plain(m["name"] or "")
        end, body = _end(text, m.end(), word not in ("type", "const", "static"))
        while open_ and open_[-1][0] <= m.start():
            open_.pop()
        in_impl = [o for o in open_ if o[1] in ("impl", "trait")]
        direct = bool(open_) and open_[-1][1] in ("impl", "trait")
        modules = [o[2] for o in open_ if o[1] == "mod"]
        kind = KINDS.get(word)
        if word == "impl":
            name = plain(_owner(src, m.end() - len(m["name"] or ""), body))
            kind = None
        elif word == "fn":
            kind = None if body < 0 or (in_impl and not direct) else "method" if direct else "function"
        elif word == "type" and direct and open_[-1][1] == "trait":
            kind = None
        qualified = f"{open_[-1][2]}::{name}" if kind == "method" else "::".join(["crate", *modules, name]) if modules else name
        if kind:
            doc = _docs(src, m.start())
            out.append((file, "rust", kind, name, qualified, m.start(), end, line(m.start()), line(end - 1), "public" if (m["vis"] or "").strip() == "pub" else None, plain(doc) if doc is not None else None))
        if body >= 0:
            open_.append((end, word, name, body))
            at = body + 1
    return out


def python_symbols(file: str, content: str) -> list[tuple]:
    """Functions, classes and methods (anything defined below a class), with docstrings; a leading underscore is private.

    A file that does not parse is read by its indents, without docstrings.
    """
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError):
        return indented_symbols(file, content)
    starts = [0]
    for x in content.encode().split(b"\n"):
        starts.append(starts[-1] + len(x) + 1)
    out: list[tuple] = []
    todo: list[tuple[ast.AST, tuple[str, ...]]] = [(tree, ())]
    while todo:
        node, classes = todo.pop()
        for child in ast.iter_child_nodes(node):
            inner = classes
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(child, ast.ClassDef)
                kind = "class" if is_class else "method" if classes else "function"
                qualified = "::".join([*classes, child.name]) if kind == "method" else child.name
                out.append((file, "python", kind, child.name, qualified, starts[child.lineno - 1] + child.col_offset, starts[child.end_lineno - 1] + child.end_col_offset, child.lineno, child.end_lineno, "private" if child.name.startswith("_") else "public", ast.get_docstring(child)))
                inner = (*classes, child.name) if is_class else classes
            todo.append((child, inner))
    return out


def doc_attribute(attribute: str) -> str | None:
    """The text of #[doc = "..."], plain or raw, inner or outer; None for any other attribute."""
    m = re.fullmatch(r"""\s*#!?\[\s*doc\s*=\s*(?:"((?:\\.|[^"\\])*)"|r(#*)"(.*)"\2)\s*\]\s*""", attribute, re.S)
    if not m:
        return None
    plain = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}
    return m[3] if m[1] is None else re.sub(r"\\(.)", lambda x: plain.get(x[1], x[1]), m[1], flags=re.S)


def unquoted(literal: str) -> str | None:
    """The text of a Python string literal, without the indent that its lines share; None where it is none."""
    try:
        text = ast.literal_eval(literal.strip())
    except (SyntaxError, ValueError):
        return None
    return inspect.cleandoc(text) if isinstance(text, str) else None


def visibility(words: str) -> str | None:
    """What an item's first word says: public, private or protected; None for anything else, such as pub(crate)."""
    return {"pub": "public", "public": "public", "private": "private", "priv": "private", "protected": "protected"}.get(words.strip())


_DEFINES = re.compile(r"([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+([^\W\d]\w*)")


def indented_symbols(file: str, content: str) -> list[tuple]:
    """python_symbols() of a file with faults: a definition reaches down to the last line that is further in than it."""
    lines, starts = content.split("\n"), [0]
    for x in lines:
        starts.append(starts[-1] + len(x.encode()) + 1)
    width = [len(x.expandtabs()) - len(x.expandtabs().lstrip()) if x.strip() and not x.lstrip().startswith("#") else None for x in lines]
    out: list[tuple] = []
    around: list[tuple[int, str, bool]] = []  # the indent, name and kind of each block that is open
    for i, x in enumerate(lines):
        m = _DEFINES.match(x)
        if width[i] is not None:
            while around and around[-1][0] >= width[i]:
                around.pop()
        if not m:
            continue
        end = i
        for j in range(i + 1, len(lines)):
            if width[j] is not None and width[j] <= width[i]:
                break
            end = j if width[j] is not None else end
        name, is_class, classes = m[3], m[2] == "class", [n for _, n, c in around if c]
        kind = "class" if is_class else "method" if classes else "function"
        out.append((file, "python", kind, name, "::".join([*classes, name]) if kind == "method" else name, starts[i] + len(m[1].encode()), starts[end] + len(lines[end].rstrip("\r").encode()), i + 1, end + 1, "private" if name.startswith("_") else "public", None))
        around.append((width[i], name, is_class))
    return out


PARSERS = {"rust": rust_symbols, "python": python_symbols}


def extract(files: DataFrame, languages: list[str] | None = None, include_private: bool = True) -> DataFrame:
    """Symbols of files (path or file, content); languages are those asked for that have a parser, all of them by default."""
    wanted = [x for x in PARSERS if languages is None or x in {y.lower() for y in languages}]
    path = F.col("file" if "file" in files.columns else "path")
    slim = files.select(path.alias("file"), X.language_of(path).alias("lang"), "content").where(F.col("lang").isin(wanted) & F.col("content").isNotNull())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for f, lang, c in zip(batch["file"], batch["lang"], batch["content"]) for r in PARSERS[lang](f, c)]
            yield pd.DataFrame(sorted(rows, key=lambda r: (r[0], r[5], r[3])), columns=_NAMES)

    out = slim.mapInPandas(run, SCHEMA)
    return out if include_private else out.where("visibility is null or visibility = 'public'")
