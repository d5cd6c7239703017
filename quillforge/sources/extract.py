"""Tables from files(path, language, source): each is one pass of mapInPandas over the files.

A row of files makes its own rows only, so nothing is shuffled, and a pass makes one kind of row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from quillforge.sources import python_code, rust_code

_COMMON = "path string, language string, kind string, name string, owner string, line int, end_line int, inside_class boolean, parse_error boolean"
UNITS = _COMMON + "".join(f", {m} bigint" for m in python_code.MEASURES)


def _table(files: DataFrame, schema: str, make: Callable[[str, str, str], Iterator[dict]]) -> DataFrame:
    names = [part.split()[0] for part in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [row for path, language, source in frame.itertuples(index=False) for row in make(path, language, source or "")]
            out = pd.DataFrame(rows, columns=names)
            for part in schema.split(", "):
                name, kind = part.split()
                if kind in ("bigint", "int"):
                    out[name] = out[name].astype("Int64")
                elif kind == "boolean":
                    out[name] = out[name].astype("boolean")
            yield out

    return files.select("path", "language", "source").mapInPandas(run, schema)


def _of(language: str):
    return python_code if language == "python" else rust_code


def units(files: DataFrame) -> DataFrame:
    return _table(files, UNITS, lambda path, language, source: ({"path": path, "language": language, "parse_error": False} | row for row in _of(language).units(path, source)))


def complexity(files: DataFrame) -> DataFrame:
    """(path, name, complexity) of Python functions."""
    return _table(files.filter("language = 'python'"), "path string, name string, complexity bigint", lambda path, language, source: ({"path": path, "name": name, "complexity": n} for name, n in python_code.complexities(source)))


def imports(files: DataFrame) -> DataFrame:
    """(path, language, import, kind)."""

    def make(path: str, language: str, source: str) -> Iterator[dict]:
        for item in _of(language).imports(source):
            name, kind = item if isinstance(item, tuple) else (item, "py")
            yield {"path": path, "language": language, "import": name, "kind": kind}

    return _table(files, "path string, language string, import string, kind string", make)


def chunks(files: DataFrame) -> DataFrame:
    return _table(files, "path string, language string, name string, start_line int, end_line int, text string", lambda path, language, source: ({"path": path, "language": language} | row for row in _of(language).chunks(source)))


def definitions(files: DataFrame) -> DataFrame:
    return _table(files, "file string, language string, name string, kind string, line int, owner string", lambda path, language, source: ({"file": path, "language": language} | row for row in _of(language).definitions(source)))


def references(files: DataFrame) -> DataFrame:
    """(file, language, ref) distinct in a file."""
    return _table(files, "file string, language string, ref string", lambda path, language, source: ({"file": path, "language": language, "ref": ref} for ref in sorted(_of(language).references(source))))


def test_usages(files: DataFrame) -> DataFrame:
    return _table(files, "test_file string, test_id string, ref string", lambda path, language, source: ({"test_file": path, "test_id": t, "ref": ref} for t, ref in _of(language).test_usages(source)))


def bindings(files: DataFrame) -> DataFrame:
    return _table(files, "file string, module string, name string", lambda path, language, source: ({"file": path, "module": m, "name": n} for m, n in _of(language).bindings(source)))


def frameworks(files: DataFrame) -> DataFrame:
    """(path, uses): whether a file imports a test framework and holds a test."""
    return _table(files, "path string, uses boolean", lambda path, language, source: iter([{"path": path, "uses": _of(language).uses_test_framework(source)}]))
