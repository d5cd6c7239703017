"""Renaming and moving a Python symbol: a plan of edits over a files table.

References are found file by file in one pass of mapInPandas; a file that does not parse gives
nothing. The plan is a DataFrame; sources.edits applies it to a local tree."""

from __future__ import annotations

import json
import keyword
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from quillforge.sources import rename_code
from quillforge.sources.edits import Edit, EditError, check

EDITS = "path string, start_byte bigint, end_byte bigint, line bigint, kind string, old_snippet string, new_snippet string"
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


@dataclass(frozen=True)
class Symbol:
    path: str
    name: str
    owner: str | None = None


def parse_symbol(text: str) -> Symbol:
    """`path::name` or `path::Type.member`."""
    path, mark, rest = text.rpartition("::")
    parts = rest.split(".")
    if not mark or not path or len(parts) > 2 or not all(map(_NAME.fullmatch, parts)):
        raise ValueError(f"{text!r}: path::name or path::Type.member is wanted")
    if not path.endswith(".py"):
        raise ValueError(f"{path!r}: only Python files are planned here")
    return Symbol(path, parts[-1], parts[0] if len(parts) == 2 else None)


def check_target(symbol: Symbol, new: str, destination: str | None) -> None:
    if not _NAME.fullmatch(new) or keyword.iskeyword(new):
        raise ValueError(f"{new!r} is no name")
    if symbol.owner and destination:
        raise ValueError("a method cannot be moved to another file")


def subclasses(files: DataFrame, owner: str) -> set[str]:
    """The owner and all classes below it: one row for each class, and only those that are linked stay."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text in frame["source"]:
                try:
                    rows += [(c, b) for c, bases in rename_code.classes(rename_code.Source(text or "").tree).items() for b in bases]
                except (SyntaxError, ValueError):
                    continue
            yield pd.DataFrame(rows, columns=["cls", "base"])

    pairs = files.select("source").mapInPandas(run, "cls string, base string").distinct()
    found, front = {owner}, {owner}
    while front:
        front = {r.cls for r in pairs.filter(pairs.base.isin(sorted(front))).select("cls").distinct().collect()} - found  # subclasses of one class
        found |= front
    return found


def plan(files: DataFrame, query: str, new: str, destination: str | None = None) -> DataFrame:
    """Edits in order of path and byte. An empty plan is an error."""
    spark: SparkSession = files.sparkSession
    symbol = parse_symbol(query)
    check_target(symbol, new, destination)
    files = files.filter("language = 'python'")
    aliases = subclasses(files, symbol.owner) if symbol.owner else set()
    name, owner, home = symbol.name, symbol.owner, symbol.path

    def edits_of(path: str, text: str) -> Iterator[tuple]:
        try:
            source = rename_code.Source(text)
        except (SyntaxError, ValueError):
            return
        defined = [d for d in rename_code.definitions(source) if d["name"] == name]
        if owner is None and path != home and any(d["top"] for d in defined):
            return
        mine = [d for d in defined if (d["owner"] in aliases if owner else path == home and d["owner"] is None and d["top"])]
        shadows = [d["whole"] for d in defined if d not in mine and d["owner"] is None and not d["top"]]
        for d in mine:
            yield path, d["start"], d["end"], d["line"], "definition", name, new
        for r in rename_code.references(source, name):
            if any(a <= r["start"] < b for a, b in shadows):
                continue
            if r["receiver"] in aliases if owner else r["kind"] in ("call", "import"):
                yield path, r["start"], r["end"], r["line"], r["kind"], name, new

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [e for path, text in frame.itertuples(index=False) for e in edits_of(path, text or "")]
            yield pd.DataFrame(rows, columns=[part.split()[0] for part in EDITS.split(", ")])

    edits = files.select("path", "source").mapInPandas(run, EDITS)
    if destination is not None:
        edits = _moved(spark, files, edits, symbol, new, destination)
    edits = edits.orderBy("path", "start_byte")
    if edits.isEmpty():
        raise EditError(f"{query}: nothing to change")
    return edits


def _moved(spark: SparkSession, files: DataFrame, edits: DataFrame, symbol: Symbol, new: str, destination: str) -> DataFrame:
    """The definition leaves its file, renamed, for the end of the destination: two files are read."""
    texts = {r.path: r.source or "" for r in files.filter(files.path.isin(symbol.path, destination)).select("path", "source").collect()}
    if symbol.path not in texts or destination not in texts:
        raise EditError("both files must be in the table")
    there = rename_code.Source(texts[destination])
    if any(d["name"] == new and d["top"] for d in rename_code.definitions(there)):
        raise EditError(f"{destination} already defines {new}")
    source = rename_code.Source(texts[symbol.path])
    found = [d for d in rename_code.definitions(source) if d["name"] == symbol.name and d["top"]]
    if len(found) != 1:
        raise EditError(f"{symbol.path} does not define {symbol.name} once")
    a, b = found[0]["whole"]
    own = sorted((r["start"], r["end"]) for r in [*rename_code.references(source, symbol.name), found[0]] if a <= r["start"] < b)
    body = source.data[a:b]
    for start, end in reversed(own):
        body = body[: start - a] + new.encode() + body[end - a :]
    size = len(there.data)
    lead = "" if not size or there.data.endswith(b"\n") else "\n"
    rows = [(symbol.path, a, b, found[0]["line"], "move", source.data[a:b].decode(), ""), (destination, size, size, texts[destination].count("\n") + 1, "move", "", lead + body.decode() + "\n")]
    outside = edits.filter(~((edits.path == symbol.path) & (edits.start_byte >= a) & (edits.start_byte < b)))
    return outside.unionByName(spark.createDataFrame(rows, EDITS))


def to_edits(planned: DataFrame) -> list[Edit]:
    """A plan for sources.edits.apply; a plan is as large as the change that a developer asked for."""
    edits = [Edit(r.path, r.start_byte, r.end_byte, r.new_snippet, r.old_snippet, r.line, r.kind) for r in planned.collect()]
    check(edits)
    return edits


def to_json(planned: DataFrame) -> str:
    """{"files": [...], "edits": [...]}."""
    rows = [r.asDict() for r in planned.collect()]
    return json.dumps({"files": sorted({r["path"] for r in rows}), "edits": rows}, ensure_ascii=False)
