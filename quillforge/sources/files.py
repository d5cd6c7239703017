"""Source files as a table: walk, ignore rules, languages and fingerprints.

The walk lists names, sizes and times on the driver and reads the ignore files that it meets; what
is in the files is read by the tasks. Both go through Arrow's file systems, so a root is a local
path or the address of a store (file, hdfs, s3, gs, abfs) that the executors can open as well.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillforge.functions.text import ignored, md5_prefix

_LANGUAGE = {"py": "python", "rs": "rust"}
#: Ignore files of a directory, weakest first; the first counts inside a git tree only.
IGNORE_FILES = (".gitignore", ".ignore", ".quillignore")
#: Bytes of source in a task, about.
TASK_BYTES = 64 << 20

Rule = tuple[str, re.Pattern, bool]


def language_of(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, "\\.([^./]+)$", 1))
    return F.when(extension == "py", "python").when(extension == "rs", "rust")


def _glob(part: str) -> str:
    """One part of a path pattern; `*` and `?` stay inside the part."""
    out, at = "", 0
    while at < len(part):
        c = part[at]
        at += 1
        end = part.find("]", at + 1 + (part[at : at + 1] in ("!", "^"))) if c == "[" else -1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif end > 0:
            inside = part[at:end].replace("\\", "\\\\").replace("[", "\\[")
            out += "[" + ("^" + inside[1:] if inside[0] in "!^" else inside) + "]"
            at = end + 1
        elif c == "\\" and at < len(part):
            out += re.escape(part[at])
            at += 1
        else:
            out += re.escape(c)
    return out


def _pattern(text: str) -> tuple[str, bool, bool] | None:
    """(regular expression, for directories only, takes back) of a line of an ignore file."""
    line = text.rstrip("\r\n")
    while line.endswith(" ") and not line.endswith("\\ "):
        line = line[:-1]
    if line.startswith("#"):
        return None
    back = line.startswith("!")
    line = line[back:]
    parts = line.strip("/").split("/")
    if parts == [""]:
        return None
    body = "^" if "/" in line.rstrip("/") else "^(?:.*/)?"
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "**":
            body += ".+" if last else "(?:.*/)?"
        else:
            body += _glob(part) + ("" if last else "/")
    return body, line.endswith("/"), back


def gitignore_regex(pattern: str) -> tuple[str, bool] | None:
    """(regular expression over a file's relative path, whether it takes back) of a line of an ignore file."""
    if (found := _pattern(pattern)) is None:
        return None
    body, folder, back = found
    return body + ("/.*" if folder else "(?:/.*)?") + "$", back


def apply_ignore_file(files: DataFrame, lines: list[str], path: str = "path") -> DataFrame:
    """Rows that the patterns leave; a later pattern overrides an earlier one. Hidden parts are left out."""
    out = F.col(path).rlike("(^|/)\\.[^/.]")
    for found in filter(None, map(gitignore_regex, lines)):
        out = F.when(F.col(path).rlike(found[0]), F.lit(not found[1])).otherwise(out)
    return files.filter(~out)


def _rules(at: str, lines: list[str]) -> list[Rule]:
    return [(at, re.compile(body + ("/" if folder else "/?") + "$"), back) for body, folder, back in filter(None, map(_pattern, lines))]


def _left_out(path: str, rules: list[Rule]) -> bool:
    """The last rule that fits decides; a path of a directory ends with a slash."""
    for at, pattern, back in reversed(rules):
        if path.startswith(at) and pattern.match(path[len(at) :]):
            return not back
    return False


def _read(files: arrow_fs.FileSystem, path: str) -> bytes:
    with files.open_input_stream(path, compression=None) as stream:
        return stream.read()


def _git_above(path: str) -> bool:
    while path != os.path.dirname(path):
        path = os.path.dirname(path)
        if os.path.exists(os.path.join(path, ".git")):
            return True
    return False


def _open(root: str) -> tuple[arrow_fs.FileSystem, str]:
    files, base = arrow_fs.FileSystem.from_uri(root if "://" in root else os.path.abspath(root))
    return files, base.rstrip("/")


def walk(root: str, lines: list[str] | None = None) -> Iterator[tuple[str, int, object]]:
    """(path below the root, bytes, time) of the files that no hidden part and no ignore rule hides.

    Rules come from `lines`, a git tree's own exclude file and the ignore files of each directory; those
    further down override. What lies in a directory that is left out is never listed, and links are not followed."""
    files, base = _open(root)
    local = isinstance(files, arrow_fs.LocalFileSystem)
    todo = [("", _rules("", lines or []), local and _git_above(base))]
    while todo:
        below, rules, git = todo.pop()
        found = {i.base_name: i for i in files.get_file_info(arrow_fs.FileSelector(f"{base}/{below}".rstrip("/") or "/"))}
        own = list(IGNORE_FILES[1:])
        if git or ".git" in found:
            git, own = True, [".git/info/exclude", *IGNORE_FILES]
        for name in own:
            info = found.get(name) or (files.get_file_info(f"{base}/{below}{name}") if "/" in name else None)
            if info is not None and info.type == arrow_fs.FileType.File:
                rules = rules + _rules(below, _read(files, info.path).decode("utf-8", "replace").splitlines())
        for name in sorted(found):
            info, path = found[name], below + name
            folder = info.type == arrow_fs.FileType.Directory
            if name.startswith(".") or _left_out(path + "/" * folder, rules) or (local and os.path.islink(info.path)):
                continue
            if folder:
                todo.append((path + "/", rules, git))
            elif info.type == arrow_fs.FileType.File:
                yield path, info.size, info.mtime


def scan(spark: SparkSession, *roots: str, language: str | None = None, ignore: list[str] | None = None, ignore_lines: list[str] | None = None) -> DataFrame:
    """files(path, language, source, length, mtime) below the roots, each file once.

    Paths are relative to the root, or to what several roots have in common, so that files of the same
    name under two roots stay apart and a file under two overlapping roots counts once. The text is
    decoded as UTF-8 with replacement. Only the listing is held on the driver."""
    bases = {root: _open(root)[1] for root in roots}
    top = os.path.commonpath(bases.values()) if bases else ""
    listed: dict[str, tuple] = {}
    for root, base in bases.items():
        for below, size, time in walk(root, ignore_lines):
            stem, _, extension = below.rsplit("/", 1)[-1].rpartition(".")
            kind = _LANGUAGE.get(extension.lower()) if stem else None
            if kind is not None and language in (None, kind):
                path = os.path.relpath(f"{base}/{below}", top or ".")
                listed.setdefault(path, (path, kind, root, below, size or 0, time))
    rows = list(listed.values())
    tasks = max(1, min(len(rows), max(spark.sparkContext.defaultParallelism, -(-sum(r[4] for r in rows) // TASK_BYTES))))
    table = spark.createDataFrame(rows, "path string, language string, root string, below string, length bigint, mtime timestamp")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                path, kind, root, below, length, time = (batch.column(c).slice(k, 1) for c in range(6))
                files, base = _open(root[0].as_py())
                text = _read(files, f"{base}/{below[0].as_py()}").decode("utf-8", "replace") if length[0].as_py() else ""
                yield pa.RecordBatch.from_arrays([path, kind, pa.array([text], pa.string()), length, time], names=["path", "language", "source", "length", "mtime"])

    return table.filter(~ignored(F.col("path"), ignore)).repartition(tasks).mapInArrow(read, "path string, language string, source string, length bigint, mtime timestamp")


def fingerprint(files: DataFrame, settings: str = "") -> str:
    """A digest of all paths, sizes and times and of the settings; it does not depend on order."""
    each = md5_prefix(F.concat_ws("|", "path", F.col("length").cast("string"), F.col("mtime").cast("string"), F.lit(settings)))
    row = files.agg(F.sum(each.cast("decimal(38,0)")).cast("string").alias("f"), F.count("*").alias("n")).first()
    return f"{row.n}-{row.f or 0}"
