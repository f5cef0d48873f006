"""Files, logs, symbol and session tables as DataFrames, and their sinks.

A tree's paths are listed by the driver, as Spark lists a table's files; contents are read by the executors.
"""

from __future__ import annotations

import json
import os
import re
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X

SYMBOLS = "file string, lang string, kind string, name string, qualified_name string, byte_start long, byte_end long, start_line long, end_line long, visibility string, doc string"
SESSIONS = "id string, timestamp string, success boolean, files long, engine string"
MANIFEST = SESSIONS.replace("files long", "files array<struct<original_path: string, rel_path: string, size_bytes: long, last_modified: string, checksum: string, symlink: boolean, link_target: string>>")


def ignore_regex(pattern: str) -> str:
    """The regular expression of an ignore file's glob: * and ? stay within a component, ** crosses them."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
        elif pattern[i] == "\\" and i + 1 < len(pattern):
            out, i = out + re.escape(pattern[i + 1]), i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(pattern[i], re.escape(pattern[i])), i + 1
    return out


class IgnoreRules:
    """An ignore file's rules for paths below its directory; the last rule that fits decides."""

    def __init__(self, text: str):
        self.rules: list[tuple[re.Pattern, bool, bool]] = []
        for line in text.splitlines():
            line = line if line.endswith("\\ ") else line.rstrip()
            if not line or line.startswith("#"):
                continue
            keep, line = line.startswith("!"), line.removeprefix("!")
            only_dir, line = line.endswith("/"), line.rstrip("/")
            anywhere = "" if "/" in line else "(?:.*/)?"
            self.rules.append((re.compile(anywhere + ignore_regex(line.removeprefix("/")), re.S), only_dir, keep))

    def ignores(self, path: str, is_dir: bool) -> bool | None:
        for rule, only_dir, keep in reversed(self.rules):
            if (is_dir or not only_dir) and rule.fullmatch(path):
                return not keep
        return None


def _rules(path: str) -> IgnoreRules | None:
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            return IgnoreRules(f.read())
    except OSError:
        return None


def walk(root: str, ignore: list[str] | None = None, include_hidden: bool = True, follow_symlinks: bool = False, max_depth: int | None = None, extensions: list[str] | None = None) -> list[str]:
    """Sorted paths of the regular files below root that no .ignore, .gitignore or extra glob leaves out.

    .gitignore, .git/info/exclude and the user's own ignore file count inside a repository only, the last one last. What can't
    be read is left out.
    """
    root = os.path.normpath(root)
    everywhere = _rules(os.path.join(os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config"), "git/ignore"))
    extra = [re.compile("(?:.*/)?" + ignore_regex(p) + "(?:/.*)?", re.S) for p in ignore or []]
    top = os.path.abspath(root)
    above = [top]
    while os.path.dirname(above[-1]) != above[-1] and not os.path.exists(f"{above[-1]}/.git"):
        above.append(os.path.dirname(above[-1]))
    in_repository = os.path.exists(f"{above[-1]}/.git")
    known: dict[str, list[IgnoreRules]] = {}

    def rules(directory: str) -> list[IgnoreRules]:
        if directory not in known:
            names = [".ignore", *([".gitignore", ".git/info/exclude"] if in_repository else [])]
            known[directory] = [r for n in names if (r := _rules(f"{directory}/{n}"))]
        return known[directory]

    def left_out(path: str, is_dir: bool) -> bool:
        if any(p.fullmatch(os.path.relpath(path, top)) for p in extra):
            return True
        directory = os.path.dirname(path)
        while True:
            for r in rules(directory):
                if (said := r.ignores(os.path.relpath(path, directory), is_dir)) is not None:
                    return said
            if directory == above[-1] or directory == os.path.dirname(directory):
                return bool(in_repository and everywhere and everywhere.ignores(os.path.relpath(path, above[-1]), is_dir))
            directory = os.path.dirname(directory)

    out = []
    for here, dirs, names in os.walk(root, followlinks=follow_symlinks):
        full = os.path.abspath(here)
        depth = 0 if full == top else os.path.relpath(full, top).count(os.sep) + 1
        seen = lambda n: include_hidden or not n.startswith(".")
        dirs[:] = [d for d in dirs if seen(d) and (max_depth is None or depth + 1 < max_depth) and (follow_symlinks or not os.path.islink(f"{full}/{d}")) and not left_out(f"{full}/{d}", True)]
        for n in names:
            p = f"{full}/{n}"
            if seen(n) and os.path.isfile(p) and (follow_symlinks or not os.path.islink(p)) and (extensions is None or n.rpartition(".")[2] in extensions) and not left_out(p, False):
                out.append(os.path.join(here, n))
    return sorted(out)


def scan(spark: SparkSession, root: str, **options) -> DataFrame:
    """(path, size, modified) of walk()'s files, with paths relative to root."""
    stats = [(os.path.relpath(p, root), os.path.getsize(p), os.path.getmtime(p)) for p in walk(root, **options)]
    return spark.createDataFrame(stats, "path string, size long, modified double").withColumn("modified", F.timestamp_micros((F.col("modified") * 1_000_000).cast("long")))


#: Fixed value: bytes from which a file that is no text counts as empty where texts are read strictly.
LARGE_FILE = 1 << 20


def read_texts(spark: SparkSession, root: str, strict: bool = False, **options) -> DataFrame:
    """(path, content) of walk()'s files, read by the executors; content that is not valid UTF-8 is null.

    strict: such a file of over LARGE_FILE bytes is empty instead, and a smaller one ends the job.
    """
    paths = walk(root, **options)
    base = os.path.abspath(root)
    full = [p for p in paths if os.path.getsize(p)]  # the reader passes empty files over
    empty = spark.createDataFrame([(os.path.relpath(p, root), "") for p in paths if not os.path.getsize(p)], "path string, content string")
    if not full:
        return empty
    raw = spark.read.format("binaryFile").load(["file://" + os.path.abspath(p) for p in full])
    text = F.col("content").cast("string")
    rel = F.substring(F.url_decode(F.replace(F.regexp_replace("path", "^file:/+", "/"), F.lit("+"), F.lit("%2B"))), len(base) + 2, 1 << 30)
    bad = F.lit(None).cast("string")
    if strict:
        bad = F.when(F.length("content") > LARGE_FILE, "").otherwise(F.raise_error(F.concat(F.lit("no UTF-8: "), rel)))
    return raw.select(rel.alias("path"), F.when(F.is_valid_utf8(text), text).otherwise(bad).alias("content")).unionByName(empty)


def read_conflicted(spark: SparkSession, root: str) -> DataFrame:
    """(file, content) of all files below root that have three lines of conflict marks or more; content is bytes."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    marks = F.regexp_count(F.decode("content", "ISO-8859-1"), F.lit(r"(?m)^(?:<{7}|={7}|>{7})"))
    return raw.where(marks >= 3).select(F.col("path").alias("file"), "content")


def read_symbols(spark: SparkSession, path: str) -> DataFrame:
    """A table of symbols from JSON lines; a line that is no object of this kind ends the job, see bad_lines()."""
    return spark.read.schema(SYMBOLS).option("mode", "FAILFAST").json(path)


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text) of the lines that read_symbols() fails on; a file is read as a whole, so this is for finding faults."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("pos", "text"))
    found = texts.where(F.trim("text") != "").withColumn("row", F.from_json("text", SYMBOLS + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    return found.where("row._bad is not null or row is null").select("file", (F.col("pos") + 1).cast("long").alias("line"), "text")


def in_order(symbols: DataFrame) -> DataFrame:
    return symbols.orderBy("file", "start_line", "byte_start", "name")


def write_symbols(symbols: DataFrame, path: str) -> None:
    """JSON lines in ranges of (file, start_line, byte_start, name): files in order make one ordered table."""
    symbols.select(*[x.split()[0] for x in SYMBOLS.split(", ")]).orderBy("file", "start_line", "byte_start", "name").write.mode("overwrite").json(path)


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """The index of sessions from JSON lines; malformed lines are left out."""
    return spark.read.schema(SESSIONS).option("mode", "DROPMALFORMED").json(path).where("id is not null")


def append_sessions(sessions: DataFrame, path: str) -> None:
    sessions.select(*[x.split()[0] for x in SESSIONS.split(", ")]).write.mode("append").json(path)


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """The manifests of the sessions below root that are done: those whose directory holds a DONE file."""
    jvm = spark.sparkContext._jvm

    def directories(name: str) -> set[str]:
        where = jvm.org.apache.hadoop.fs.Path(f"{root}/*/{name}")
        found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
        return {f.getPath().getParent().toString() for f in found or []}

    done = sorted(directories("DONE") & directories("manifest.json"))
    if not done:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).option("multiLine", True).json([f"{d}/manifest.json" for d in done])


def rebuild_sessions(manifests: DataFrame) -> DataFrame:
    """An index row for each manifest."""
    return manifests.select("id", "timestamp", "success", F.size("files").cast("long").alias("files"), "engine")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(log, text) of whole log files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("log"), F.col("value").alias("text"))


#: Folders that do not make an index stale, and how many folders down files count.
SKIPPED_FOLDERS = ("target", "node_modules", ".git", "build", "dist", ".next", "venv", "__pycache__", ".vscode", ".idea")
STALE_DEPTH = 5


def is_stale(files: DataFrame, index_modified, extensions: tuple[str, ...] = ("rs", "py", "js", "ts", "tsx", "go", "cpp", "h")) -> DataFrame:
    """One row, stale: whether a source file (path from the root, modified) is newer than the index.

    Paths with a component of SKIPPED_FOLDERS, and those more than STALE_DEPTH folders down, do not count.
    """
    parts = F.split("path", "/")
    seen = ~F.arrays_overlap(parts, F.array(*[F.lit(x) for x in SKIPPED_FOLDERS])) & (F.size(parts) <= STALE_DEPTH + 1)
    newer = seen & F.regexp_extract("path", r"\.([^./]+)$", 1).isin(*extensions) & (F.col("modified") > F.lit(index_modified))
    return files.agg(F.coalesce(F.bool_or(newer), F.lit(False)).alias("stale"))


def history_after(history: list[str], name: str, most: int = 100) -> list[str]:
    """A list of recent names with name in front where it was absent, cut to the most recent."""
    kept = [x.strip() for x in history if x.strip()]
    return (kept if name in kept else [name, *kept])[:most]


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes one file on any store that Spark reaches: under another name first, then moved to its own."""
    jvm = spark.sparkContext._jvm
    where, part = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, path + ".part"))
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = store.create(part, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    store.delete(where, False)
    if not store.rename(part, where):
        raise OSError(f"could not write {path}")


def write_chunk_files(chunks: DataFrame, path: str) -> int:
    """Files chunk_001.txt and on below path, and chunks_manifest.jsonl, of chunks in order of chunk_id; how many. One passes the driver at a time."""
    spark, lines = chunks.sparkSession, []
    names = ("symbol_path", "source_file", "start_line", "end_line", "token_count")
    for r in chunks.orderBy("chunk_id").toLocalIterator():
        file = f"chunk_{r['chunk_id']:03d}.txt"
        write_bytes(spark, f"{path}/{file}", r["content"].encode())
        lines.append(json.dumps({"chunk_id": r["chunk_id"], "file": file} | {n: r[n] for n in names}))
    write_bytes(spark, f"{path}/chunks_manifest.jsonl", "".join(x + "\n" for x in lines).encode())
    return len(lines)


def read_history(spark: SparkSession, path: str) -> list[str]:
    """The names in a history file, trimmed, without blank lines; none where there is no file."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return []
    return [x.strip() for r in spark.read.text(path, wholetext=True).collect() for x in r.value.split("\n") if x.strip()]


def write_history(spark: SparkSession, path: str, name: str, most: int = 100) -> list[str]:
    """history_after() of a history file, written back."""
    out = history_after(read_history(spark, path), name, most)
    write_bytes(spark, path, "".join(x + "\n" for x in out).encode())
    return out


def write_extract(found: DataFrame, path: str) -> None:
    """One file of found's texts (pos, text) in order, a line break between them."""
    rows = found.orderBy("pos").toLocalIterator()
    write_bytes(found.sparkSession, path, "\n".join(r["text"] for r in rows).encode())


def sample_paths(manifests: DataFrame, most: int = 3) -> DataFrame:
    """(id, files, sample) of manifests: how many files, and the first paths."""
    return manifests.select("id", F.size("files").cast("long").alias("files"), F.slice(F.transform("files", lambda f: f["original_path"]), 1, most).alias("sample"))


def load_config(directory: str, name: str, environ: dict[str, str] | None = None) -> dict:
    """Settings of the first of name.toml, name.yaml, name.json and .name.toml, under those of variables NAME_KEY.

    A variable NAME_TABLE_KEY sets key within a table of the file. YAML needs the yaml package.
    """

    def yaml(text: str) -> dict:
        try:
            from yaml import safe_load
        except ImportError as e:
            raise ValueError("a YAML file needs the yaml package") from e
        return safe_load(text) or {}

    out: dict = {}
    for file, read in ((f"{name}.toml", tomllib.loads), (f"{name}.yaml", yaml), (f"{name}.json", json.loads), (f".{name}.toml", tomllib.loads)):
        if os.path.isfile(f"{directory}/{file}"):
            with open(f"{directory}/{file}", encoding="utf-8") as f:
                out = read(f.read())
            break
    prefix = name.upper() + "_"
    for k, v in (environ if environ is not None else os.environ).items():
        if k.startswith(prefix):
            key = k[len(prefix) :].lower()
            table, _, rest = key.partition("_")
            if isinstance(out.get(table), dict) and rest:
                out[table] = out[table] | {rest: v}
            else:
                out[key] = v
    return out


def matching(files: DataFrame, globs: list[str], column: str = "path") -> DataFrame:
    """files whose path no glob fits, tested by one regular expression."""
    if not globs:
        return files
    return files.where(~F.col(column).rlike("^(?:" + "|".join(f"(?:.*/)?{ignore_regex(g)}(?:/.*)?" for g in globs) + ")$"))
