"""Analyses of a small source tree, with the rows that they must give.

The rows wanted stand beside each case as text. They were printed by the case itself and then read
against the rules, most of them value by value (not the token counts of chunks nor every Rust measure);
from then on they hold the case. No table is read; these are tests, not queries of the catalogue."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillforge.functions import text as T
from quillforge.operators import coarsen, graph, render, resolve, rules
from quillforge.plans import rename
from quillforge.plans.analysis import Corpus
from quillforge.sources import config, extract

CASES: dict = {}
WANTED: dict = {}


def query(sql: str):
    def add(f):
        CASES[f.__name__], WANTED[f.__name__] = f, sql
        return f

    return add


CART = '''import os
from typing import TYPE_CHECKING, Protocol
from shop import stock

if TYPE_CHECKING:
    import json

LIMIT = 3


class Priced(Protocol):
    def price(self): ...


class Cart:
    def __init__(self, owner, *items, cash=True, strict=False):
        self.owner = owner
        self.items = items

    @property
    def total(self):
        total = 0
        for item in self.items:
            if item.cost > LIMIT:
                total += item.cost
            elif item.cost:
                total -= 1
            else:
                total = total
        return total

    async def send(self, to, *, by, at=None):
        try:
            parts = stock.find(to)
            first, rest = parts
            print(first, rest)
        except OSError:
            return None, False
        with open(to) as out:
            out.write(by)

        def note(text):
            return lambda: text

        return note(first)
'''
STOCK = '''import shop.cart as cart
from .prices import SHELVES


def find(name):
    found = []
    for shelf in SHELVES:
        if name in shelf and len(shelf) > 3:
            found.append(shelf[name])
        else:
            found.append(None)
    print(found, name, "looked up")
    return found


def _hidden(x, y, z, w):
    match x:
        case 1:
            return y
        case _:
            return z


def process(rows):
    return [find(row) for row in rows]
'''
PRICES = '''SHELVES = []


def lookup(name):
    found = []
    for shelf in SHELVES:
        if name in shelf and len(shelf) > 5:
            found.append(shelf[name])
        else:
            found.append(None)
    print(found, name, "looked up")
    return found


def process(rows):
    return rows
'''
TESTS = '''import pytest
from shop.cart import Cart
from shop.prices import process


def test_total():
    assert Cart("me").total == 0


class TestStock:
    def test_find(self):
        from shop import stock
        assert stock.find("x") == [] and process([]) == []
'''
LIB = '''mod util;
use std::collections::HashMap;
use util::{double, helper as aid};

pub struct Store { items: HashMap<String, i32> }
pub enum Kind { A, B }
pub trait Named { fn name(&self) -> String; }

impl Store {
    pub fn put(&mut self, key: String, fresh: bool) -> i32 {
        let (a, b) = (double(1), 2);
        if fresh && a > b {
            for i in 0..3 {
                self.items.insert(key.clone(), i);
            }
            return a;
        } else if b > 4 {
            let run = |x: i32| x + 1;
            return run(b);
        }
        match a { 1 => b, _ => aid(b) }
    }
    #[inline]
    fn peek(&self) -> usize { self.items.len() }
}

#[cfg(test)]
mod tests {
    #[test]
    fn puts() { let s = super::Store { items: Default::default() }; s.peek(); }
}
'''
UTIL = '''pub fn double(x: i32) -> i32 { x * 2 }

pub fn helper(x: i32) -> i32 {
    let y = double(x);
    y + 1
}
'''
TREE = (
    ("src/shop/__init__.py", "python", "from shop import cart\n"),
    ("src/shop/cart.py", "python", CART),
    ("src/shop/stock.py", "python", STOCK),
    ("src/shop/prices.py", "python", PRICES),
    ("src/shop/lonely.py", "python", "def alone(a, b, c, d):\n    return a\n"),
    ("src/shop/broken.py", "python", "def sound():\n    return 1\n\ndef unsound(:\n    pass\n"),
    ("tests/test_shop.py", "python", TESTS),
    ("rs/src/lib.rs", "rust", LIB),
    ("rs/src/util.rs", "rust", UTIL),
)


def tree(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TREE), "path string, language string, source string")


_held: dict[str, Corpus] = {}


def corpus(spark: SparkSession) -> Corpus:
    """One for each application, so that its tables are made once for all queries."""
    return _held.setdefault(spark.sparkContext.applicationId, Corpus(tree(spark)))


def changed(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.createDataFrame([(p,) for p in paths], "file string")


def rows_sql(kinds: str, rows: Iterable[tuple]) -> str:
    """VALUES as SQL; kinds is "name type, ..."."""
    names, types = zip(*(part.split() for part in kinds.split(", ")), strict=True)
    quoted = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)
    values = ", ".join("(" + ", ".join(map(quoted, row)) + ")" for row in rows)
    casts = ", ".join(f'CAST("{n}" AS {t}) AS "{n}"' for n, t in zip(names, types, strict=True))
    return f"SELECT {casts} FROM (VALUES {values}) AS v({', '.join(f'"{n}"' for n in names)})"


def lines(text: str, kinds: str) -> list[tuple]:
    """Rows of a table written out below: a line for each, columns between bars, `-` for null."""
    types = [part.split()[1] for part in kinds.split(", ")]
    value = lambda v, t: None if v == "-" else v if t == "VARCHAR" else v == "true" if t == "BOOLEAN" else float(v) if t == "DOUBLE" else int(v)
    return [tuple(value(v.strip(), t) for v, t in zip(line.split("|"), types, strict=True)) for line in text.strip().split("\n")]


def expects(kinds: str, text: str):
    return query(rows_sql(kinds, lines(text, kinds)))


PY_MEASURES = ("statements_per_function", "positional_args", "keyword_only_args", "max_indentation_depth", "nested_function_depth", "returns_per_function", "return_values_per_function", "branches_per_function", "local_variables_per_function", "statements_per_try_block", "boolean_parameters", "annotations_per_function", "calls_per_function")
RS_MEASURES = ("statements_per_function", "arguments_per_function", "max_indentation_depth", "nested_function_depth", "returns_per_function", "branches_per_function", "local_variables_per_function", "boolean_parameters", "annotations_per_function", "calls_per_function")
FILE_MEASURES = ("statements_per_file", "lines_per_file", "functions_per_file", "interface_types_per_file", "concrete_types_per_file", "imported_names_per_file")


def kinds_of(texts: str = "", numbers: tuple[str, ...] = ()) -> str:
    return ", ".join([*(f"{c} VARCHAR" for c in texts.split()), *(f"{c} BIGINT" for c in numbers)])


@expects(kinds_of("path name", PY_MEASURES), """
src/shop/broken.py | sound | 1 | 0 | 0 | 1 | 0 | 1 | 1 | 0 | 0 | 0 | 0 | 0 | 0
src/shop/cart.py | __init__ | 2 | 2 | 2 | 1 | 0 | 0 | 0 | 0 | 0 | 0 | 2 | 0 | 0
src/shop/cart.py | note | 1 | 1 | 0 | 1 | 0 | 1 | 1 | 0 | 0 | 0 | 0 | 0 | 0
src/shop/cart.py | price | 1 | 0 | 0 | 1 | 0 | 0 | 0 | 0 | 0 | 0 | 0 | 0 | 0
src/shop/cart.py | send | 8 | 1 | 2 | 3 | 1 | 2 | 2 | 0 | 3 | 3 | 0 | 0 | 5
src/shop/cart.py | total | 7 | 0 | 0 | 4 | 0 | 1 | 1 | 2 | 1 | 0 | 0 | 1 | 0
src/shop/lonely.py | alone | 1 | 4 | 0 | 1 | 0 | 1 | 1 | 0 | 0 | 0 | 0 | 0 | 0
src/shop/prices.py | lookup | 7 | 1 | 0 | 4 | 0 | 1 | 1 | 1 | 1 | 0 | 0 | 0 | 4
src/shop/prices.py | process | 1 | 1 | 0 | 1 | 0 | 1 | 1 | 0 | 0 | 0 | 0 | 0 | 0
src/shop/stock.py | _hidden | 3 | 4 | 0 | 3 | 0 | 2 | 1 | 2 | 0 | 0 | 0 | 0 | 0
src/shop/stock.py | find | 7 | 1 | 0 | 4 | 0 | 1 | 1 | 1 | 1 | 0 | 0 | 0 | 4
src/shop/stock.py | process | 1 | 1 | 0 | 1 | 0 | 1 | 1 | 0 | 0 | 0 | 0 | 0 | 1
tests/test_shop.py | test_find | 1 | 0 | 0 | 1 | 0 | 0 | 0 | 0 | 0 | 0 | 0 | 0 | 2
tests/test_shop.py | test_total | 1 | 0 | 0 | 1 | 0 | 0 | 0 | 0 | 0 | 0 | 0 | 0 | 1
""")
def py_function_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.units(tree(spark)).filter("language = 'python' and kind in ('function', 'method')").select("path", "name", *PY_MEASURES)


@expects(kinds_of("path name", RS_MEASURES), """
rs/src/lib.rs | peek | 1 | 0 | 0 | 0 | 0 | 0 | 0 | 0 | 1 | 1
rs/src/lib.rs | put | 8 | 2 | 2 | 1 | 2 | 2 | 3 | 1 | 0 | 5
rs/src/util.rs | double | 1 | 1 | 0 | 0 | 0 | 0 | 0 | 0 | 0 | 0
rs/src/util.rs | helper | 2 | 1 | 0 | 0 | 0 | 0 | 1 | 0 | 0 | 1
""")
def rust_function_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.units(tree(spark)).filter("language = 'rust' and kind in ('function', 'method')").select("path", "name", *RS_MEASURES)


@expects("path VARCHAR, parse_error BOOLEAN, " + kinds_of("", FILE_MEASURES), """
rs/src/lib.rs | false | 9 | 31 | 2 | 1 | 2 | -
rs/src/util.rs | false | 3 | 6 | 2 | 0 | 0 | 0
src/shop/__init__.py | false | 0 | 1 | 0 | 0 | 0 | -
src/shop/broken.py | true | 1 | 5 | 1 | 0 | 0 | 0
src/shop/cart.py | false | 18 | 45 | 5 | 1 | 1 | 4
src/shop/lonely.py | false | 1 | 2 | 1 | 0 | 0 | 0
src/shop/prices.py | false | 8 | 16 | 2 | 0 | 0 | 0
src/shop/stock.py | false | 11 | 25 | 3 | 0 | 0 | 2
tests/test_shop.py | false | 2 | 13 | 2 | 0 | 1 | 4
""")
def file_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.units(tree(spark)).filter("kind = 'module'").select("path", "parse_error", *FILE_MEASURES)


@expects("path VARCHAR, kind VARCHAR, name VARCHAR, owner VARCHAR, line INTEGER, end_line INTEGER, inside_class BOOLEAN, methods_per_class BIGINT", """
rs/src/lib.rs | class | Kind | - | 6 | 6 | false | -
rs/src/lib.rs | class | Store | - | 5 | 5 | false | -
rs/src/lib.rs | impl | Store | - | 9 | 25 | false | 2
rs/src/lib.rs | method | peek | Store | 24 | 24 | true | -
rs/src/lib.rs | method | put | Store | 10 | 22 | true | -
rs/src/lib.rs | module | lib | - | 1 | 31 | false | -
rs/src/util.rs | function | double | - | 1 | 1 | false | -
rs/src/util.rs | function | helper | - | 3 | 6 | false | -
rs/src/util.rs | module | util | - | 1 | 6 | false | -
src/shop/__init__.py | module | __init__ | - | 1 | 1 | false | -
src/shop/broken.py | function | sound | - | 1 | 2 | false | -
src/shop/broken.py | module | broken | - | 1 | 5 | false | -
src/shop/cart.py | class | Cart | - | 15 | 45 | false | 4
src/shop/cart.py | class | Priced | - | 11 | 12 | false | 1
src/shop/cart.py | function | note | - | 42 | 43 | false | -
src/shop/cart.py | method | __init__ | Cart | 16 | 18 | true | -
src/shop/cart.py | method | price | Priced | 12 | 12 | true | -
src/shop/cart.py | method | send | Cart | 32 | 45 | true | -
src/shop/cart.py | method | total | Cart | 21 | 30 | true | -
src/shop/cart.py | module | cart | - | 1 | 45 | false | -
src/shop/lonely.py | function | alone | - | 1 | 2 | false | -
src/shop/lonely.py | module | lonely | - | 1 | 2 | false | -
src/shop/prices.py | function | lookup | - | 4 | 12 | false | -
src/shop/prices.py | function | process | - | 15 | 16 | false | -
src/shop/prices.py | module | prices | - | 1 | 16 | false | -
src/shop/stock.py | function | _hidden | - | 16 | 21 | false | -
src/shop/stock.py | function | find | - | 5 | 13 | false | -
src/shop/stock.py | function | process | - | 24 | 25 | false | -
src/shop/stock.py | module | stock | - | 1 | 25 | false | -
tests/test_shop.py | class | TestStock | - | 10 | 13 | false | 1
tests/test_shop.py | function | test_total | - | 6 | 7 | false | -
tests/test_shop.py | method | test_find | TestStock | 11 | 13 | true | -
tests/test_shop.py | module | test_shop | - | 1 | 13 | false | -
""")
def code_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.units(tree(spark)).select("path", "kind", "name", "owner", "line", "end_line", "inside_class", "methods_per_class")


@expects("path VARCHAR, name VARCHAR, complexity BIGINT", """
src/shop/broken.py | sound | 1
src/shop/cart.py | __init__ | 1
src/shop/cart.py | note | 1
src/shop/cart.py | price | 1
src/shop/cart.py | send | 3
src/shop/cart.py | total | 4
src/shop/lonely.py | alone | 1
src/shop/prices.py | lookup | 4
src/shop/prices.py | process | 1
src/shop/stock.py | _hidden | 3
src/shop/stock.py | find | 4
src/shop/stock.py | process | 2
tests/test_shop.py | test_find | 3
tests/test_shop.py | test_total | 2
""")
def cyclomatic_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.complexity(tree(spark))


@expects("path VARCHAR, import VARCHAR, kind VARCHAR", """
rs/src/lib.rs | std | use
rs/src/lib.rs | util | mod
rs/src/lib.rs | util | use
src/shop/__init__.py | shop | py
src/shop/__init__.py | shop.cart | py
src/shop/cart.py | json | py
src/shop/cart.py | os | py
src/shop/cart.py | shop | py
src/shop/cart.py | shop.stock | py
src/shop/cart.py | typing | py
src/shop/cart.py | typing.Protocol | py
src/shop/cart.py | typing.TYPE_CHECKING | py
src/shop/stock.py | prices | py
src/shop/stock.py | prices.SHELVES | py
src/shop/stock.py | shop.cart | py
tests/test_shop.py | pytest | py
tests/test_shop.py | shop | py
tests/test_shop.py | shop.cart | py
tests/test_shop.py | shop.cart.Cart | py
tests/test_shop.py | shop.prices | py
tests/test_shop.py | shop.prices.process | py
tests/test_shop.py | shop.stock | py
""")
def source_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.imports(tree(spark)).select("path", "import", "kind")


@expects("path VARCHAR, name VARCHAR, start_line INTEGER, end_line INTEGER, tokens INTEGER", """
rs/src/lib.rs | peek | 24 | 24 | 7
rs/src/lib.rs | put | 10 | 22 | 63
rs/src/lib.rs | puts | 30 | 30 | 13
rs/src/lib.rs | tests | 28 | 31 | 18
rs/src/util.rs | double | 1 | 1 | 11
rs/src/util.rs | helper | 3 | 6 | 15
src/shop/broken.py | sound | 1 | 2 | 2
src/shop/cart.py | __init__ | 16 | 18 | 6
src/shop/cart.py | note | 42 | 43 | 3
src/shop/cart.py | price | 12 | 12 | 3
src/shop/cart.py | send | 32 | 45 | 27
src/shop/cart.py | total | 21 | 30 | 25
src/shop/lonely.py | alone | 1 | 2 | 2
src/shop/prices.py | lookup | 4 | 12 | 24
src/shop/prices.py | process | 15 | 16 | 2
src/shop/stock.py | _hidden | 16 | 21 | 10
src/shop/stock.py | find | 5 | 13 | 24
src/shop/stock.py | process | 24 | 25 | 6
tests/test_shop.py | test_find | 11 | 13 | 12
tests/test_shop.py | test_total | 6 | 7 | 4
""")
def code_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.size(T.tokens(T.normalize_code(F.col("text")))).alias("tokens")
    return extract.chunks(tree(spark)).select("path", "name", "start_line", "end_line", size)


@expects("file VARCHAR, name VARCHAR, kind VARCHAR, line INTEGER, owner VARCHAR", """
rs/src/lib.rs | Kind | class | 6 | -
rs/src/lib.rs | Store | class | 5 | -
rs/src/lib.rs | peek | method | 24 | Store
rs/src/lib.rs | put | method | 10 | Store
rs/src/util.rs | double | function | 1 | -
rs/src/util.rs | helper | function | 3 | -
src/shop/broken.py | sound | function | 1 | -
src/shop/cart.py | Cart | class | 15 | -
src/shop/cart.py | __init__ | method | 16 | Cart
src/shop/cart.py | send | method | 32 | Cart
src/shop/cart.py | total | method | 21 | Cart
src/shop/lonely.py | alone | function | 1 | -
src/shop/prices.py | lookup | function | 4 | -
src/shop/prices.py | process | function | 15 | -
src/shop/stock.py | find | function | 5 | -
src/shop/stock.py | process | function | 24 | -
""")
def code_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark).definitions.select("file", "name", "kind", "line", "owner")


@expects("file VARCHAR, ref VARCHAR", """
rs/src/util.rs | double
rs/src/util.rs | helper
rs/src/util.rs | i32
rs/src/util.rs | x
rs/src/util.rs | y
src/shop/prices.py | SHELVES
src/shop/prices.py | append
src/shop/prices.py | found
src/shop/prices.py | len
src/shop/prices.py | name
src/shop/prices.py | print
src/shop/prices.py | rows
src/shop/prices.py | shelf
""")
def code_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the two smallest sources of each language."""
    return extract.references(tree(spark).filter("path in ('rs/src/util.rs', 'src/shop/prices.py')")).select("file", "ref")


@expects("test_file VARCHAR, test_id VARCHAR, ref VARCHAR", """
rs/src/lib.rs | tests::puts | Default
rs/src/lib.rs | tests::puts | Store
rs/src/lib.rs | tests::puts | default
rs/src/lib.rs | tests::puts | items
rs/src/lib.rs | tests::puts | peek
rs/src/lib.rs | tests::puts | s
tests/test_shop.py | TestStock::test_find | find
tests/test_shop.py | TestStock::test_find | process
tests/test_shop.py | TestStock::test_find | stock
tests/test_shop.py | test_total | Cart
tests/test_shop.py | test_total | total
""")
def test_usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.test_usages(tree(spark))


@expects("file VARCHAR, module VARCHAR, name VARCHAR", """
src/shop/__init__.py | shop | cart
src/shop/cart.py | shop | stock
src/shop/cart.py | typing | Protocol
src/shop/cart.py | typing | TYPE_CHECKING
src/shop/stock.py | prices | SHELVES
tests/test_shop.py | shop | stock
tests/test_shop.py | shop.cart | Cart
tests/test_shop.py | shop.prices | process
""")
def import_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.bindings(tree(spark))


@expects("path VARCHAR, test BOOLEAN", """
pkg/_test.py | false
pkg/a_test.py | true
pkg/conftest.py | true
rs/src/lib.rs | false
rs/src/util.rs | false
src/shop/__init__.py | false
src/shop/broken.py | false
src/shop/cart.py | false
src/shop/lonely.py | false
src/shop/prices.py | false
src/shop/stock.py | false
tests/test_shop.py | true
util/checks.py | true
util/plain.py | false
x/test_y.rs | true
""")
def test_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By name, directory, or a framework with a test."""
    more = [("util/checks.py", "python", "import unittest\n\nclass TestIt:\n    pass\n"), ("util/plain.py", "python", "import unittest\n"), ("pkg/a_test.py", "python", ""), ("pkg/_test.py", "python", ""), ("pkg/conftest.py", "python", ""), ("x/test_y.rs", "rust", "")]
    return Corpus(spark.createDataFrame([*TREE, *more], "path string, language string, source string")).is_test.select("path", "test")


@expects("language VARCHAR, src VARCHAR, dst VARCHAR", """
python | shop | shop.cart
python | shop.cart | shop
python | shop.cart | shop.stock
python | shop.stock | shop.cart
python | shop.stock | shop.prices
python | tests.test_shop | shop
python | tests.test_shop | shop.cart
python | tests.test_shop | shop.prices
python | tests.test_shop | shop.stock
rust | lib | util
""")
def module_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark).all_edges()


@expects("node VARCHAR, path VARCHAR, fan_in BIGINT, fan_out BIGINT, indirect_dependencies BIGINT, dependency_depth BIGINT, cycle_size BIGINT", """
lib | rs/src/lib.rs | 0 | 1 | 0 | 1 | 0
shop | src/shop/__init__.py | 2 | 1 | 2 | 3 | 3
shop.broken | src/shop/broken.py | 0 | 0 | 0 | 0 | 0
shop.cart | src/shop/cart.py | 3 | 2 | 1 | 2 | 3
shop.lonely | src/shop/lonely.py | 0 | 0 | 0 | 0 | 0
shop.prices | src/shop/prices.py | 2 | 0 | 0 | 0 | 0
shop.stock | src/shop/stock.py | 2 | 2 | 1 | 2 | 3
tests.test_shop | tests/test_shop.py | 0 | 4 | 0 | 1 | 0
util | rs/src/util.rs | 1 | 0 | 0 | 0 | 0
""")
def module_graph_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = corpus(spark)
    return found.module_metrics("python").unionByName(found.module_metrics("rust"))


@expects("file VARCHAR, line INTEGER, unit_name VARCHAR, metric VARCHAR, value BIGINT, threshold BIGINT, suggestion VARCHAR", """
rs/src/lib.rs | 1 | lib | interface_types_per_file | 1 | 0 | Move some to files of their own.
src/shop/__init__.py | 1 | shop | cycle_size | 3 | 0 | Remove the edge that the fewest others need.
src/shop/broken.py | 1 | shop.broken | orphan_module | 0 | 0 | Use it, or remove it.
src/shop/cart.py | 16 | __init__ | boolean_parameters | 2 | 1 | Use two functions, or an enumeration.
src/shop/lonely.py | 1 | alone | positional_args | 4 | 3 | Make more of them keyword-only.
src/shop/lonely.py | 1 | shop.lonely | orphan_module | 0 | 0 | Use it, or remove it.
src/shop/stock.py | 16 | _hidden | positional_args | 4 | 3 | Make more of them keyword-only.
""")
def tree_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark).violations().drop("message")


@expects("line VARCHAR", """
VIOLATION:positional_args:src/shop/stock.py:16:_hidden: positional_args is 4 (threshold: 3) Make more of them keyword-only.
""")
def violation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of one file in focus."""
    held = corpus(spark).violations(changed(spark, "src/shop/stock.py"))
    return held.select(rules.violation_line(F.col("metric"), F.col("file"), F.col("line"), F.col("unit_name"), F.col("message"), F.col("suggestion")).alias("line"))


@expects("file VARCHAR, name VARCHAR, line INTEGER", """
rs/src/lib.rs | Kind | 6
rs/src/util.rs | double | 1
rs/src/util.rs | helper | 3
src/shop/broken.py | sound | 1
src/shop/lonely.py | alone | 1
src/shop/prices.py | lookup | 4
""")
def tree_uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark).uncovered.select("file", "name", "line")


@expects("file VARCHAR, line INTEGER, unit_name VARCHAR, metric VARCHAR, message VARCHAR, suggestion VARCHAR", """
rs/src/lib.rs | 6 | Kind | test_coverage | 75% covered. Add test coverage for this code unit. | 
rs/src/util.rs | 1 | double | test_coverage | 0% covered. Add test coverage for this code unit. | 
rs/src/util.rs | 3 | helper | test_coverage | 0% covered. Add test coverage for this code unit. | 
src/shop/broken.py | 1 | sound | test_coverage | 0% covered. Add test coverage for this code unit. No test module imports this module. | Add an import in a test file, or remove if dead.
src/shop/lonely.py | 1 | alone | test_coverage | 0% covered. Add test coverage for this code unit. No test module imports this module. | Add an import in a test file, or remove if dead.
src/shop/prices.py | 4 | lookup | test_coverage | 50% covered. Add test coverage for this code unit. (candidates: tests.test_shop) | 
""")
def coverage_violation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark).coverage_violations().drop("value", "threshold")


@expects("name VARCHAR, file VARCHAR", """
run | b.py
""")
def names_by_importer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ambiguous names that the imports of the test files which use them decide."""
    rows = lambda kinds, *values: spark.createDataFrame(list(values), kinds)
    definitions = rows("file string, name string", ("a.py", "run"), ("b.py", "run"), ("a.py", "both"), ("b.py", "both"), ("a.py", "out"), ("z.py", "out"), ("a.py", "own"))
    usages = rows("test_file string, ref string", ("t1.py", "run"), ("t2.py", "both"), ("t1.py", "out"), ("t3.py", "run"), ("t1.py", "own"))
    modules = rows("file string, module string", ("a.py", "a"), ("b.py", "b"), ("t1.py", "t1"), ("t2.py", "t2"), ("t3.py", "t3"))
    edges = rows("src string, dst string", ("t1", "b"), ("t2", "a"), ("t2", "b"), ("a", "b"))
    return resolve.chosen_by_import(definitions, usages, modules, edges)


@expects("file VARCHAR, name VARCHAR, test_file VARCHAR, test_id VARCHAR", """
rs/src/lib.rs | Store | rs/src/lib.rs | tests::puts
rs/src/lib.rs | peek | rs/src/lib.rs | tests::puts
rs/src/lib.rs | put | rs/src/lib.rs | tests::puts
src/shop/cart.py | Cart | tests/test_shop.py | test_total
src/shop/cart.py | __init__ | tests/test_shop.py | test_total
src/shop/cart.py | send | tests/test_shop.py | test_total
src/shop/cart.py | total | tests/test_shop.py | test_total
src/shop/prices.py | process | tests/test_shop.py | TestStock::test_find
src/shop/stock.py | find | tests/test_shop.py | TestStock::test_find
src/shop/stock.py | process | tests/test_shop.py | TestStock::test_find
""")
def tree_covering_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark).covering()


@expects("test_file VARCHAR, test_id VARCHAR", """
rs/src/lib.rs | tests::puts
tests/test_shop.py | test_total
""")
def tests_of_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark).tests_of(changed(spark, "src/shop/cart.py", "rs/src/lib.rs"))


@expects("language VARCHAR, command VARCHAR", """
python | python -m pytest tests/test_shop.py::TestStock::test_find tests/test_shop.py::test_total
rust | cargo test -- tests::puts
""")
def test_command_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark).test_commands(changed(spark, "src/shop/cart.py", "rs/src/lib.rs", "tests/test_shop.py"))


@expects("line VARCHAR", """
1.000  src/shop/prices.py:4-12  src/shop/stock.py:5-13
""")
def dry_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark).dry_lines(changed(spark, "src/shop/prices.py"))


@expects("line VARCHAR", """
VIOLATION:duplication:src/shop/prices.py:4:lookup: 100% similar, 2 copies: [src/shop/prices.py:4-12, src/shop/stock.py:5-13]. Extract common code into a shared function.
""")
def duplicate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.duplicate_lines(*corpus(spark).duplicate_clusters("python")).select("line")


@expects("violations BIGINT, orphans BIGINT, duplicate_clusters BIGINT, failed BOOLEAN, exit_code INTEGER", """
7 | 2 | 1 | true | 1
""")
def check_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark).status()


@expects("line VARCHAR", """
Analyzed: 9 files, 33 code_units, 54 statements, 9 graph_nodes, 10 graph_edges
""")
def analysis_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark).summary_line()


@expects("part INTEGER, ord VARCHAR, line VARCHAR", """
0 | 0 | # Proposed Layout for `shop`
0 | 1 | ## Summary
0 | 2 | Current layout has 1 cycle and 4 cross-directory dependencies.
1 | py:shop | - cycle: "py:shop → py:shop.cart → py:shop.stock"; break: "py:shop -> py:shop.cart"
2 | 000000 py:shop.broken | - level 0 (Foundation): py:shop.broken
2 | 000000 py:shop.lonely | - level 0 (Foundation): py:shop.lonely
2 | 000000 py:shop.prices | - level 0 (Foundation): py:shop.prices
2 | 000000 rs:util | - level 0 (Foundation): rs:util
2 | 000001 py:shop | - level 1 (Domain): py:shop
2 | 000001 py:shop.cart | - level 1 (Domain): py:shop.cart
2 | 000001 py:shop.stock | - level 1 (Domain): py:shop.stock
2 | 000001 rs:lib | - level 1 (Domain): rs:lib
2 | 000002 py:tests.test_shop | - level 2 (Application): py:tests.test_shop
3 | 0 | Breaking suggested edges reduces cycles from 1 to 1.
""")
def layout_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark).layout("shop")


@expects("cycles BIGINT, remaining_cycles BIGINT, layers BIGINT", """
2 | 0 | 4
""")
def what_if_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "c")], "src string, dst string")
    return graph.what_if(spark.createDataFrame([(n,) for n in "abcdef"], "node string"), edges)


@expects("language VARCHAR, metric VARCHAR, op VARCHAR, threshold BIGINT", """
python | annotations_per_function | <= | 5
python | boolean_parameters | <= | 1
python | branches_per_function | <= | 9
python | calls_per_function | <= | 20
python | concrete_types_per_file | <= | 1
python | cycle_size | <= | 0
python | dependency_depth | <= | 3
python | functions_per_file | <= | 10
python | imported_names_per_file | <= | 30
python | indirect_dependencies | <= | 10
python | interface_types_per_file | <= | 1
python | keyword_only_args | <= | 3
python | lines_per_file | <= | 300
python | local_variables_per_function | <= | 15
python | max_indentation_depth | <= | 4
python | methods_per_class | <= | 10
python | nested_function_depth | <= | 2
python | positional_args | <= | 3
python | return_values_per_function | <= | 3
python | returns_per_function | <= | 5
python | statements_per_file | <= | 200
python | statements_per_function | <= | 35
python | statements_per_try_block | <= | 3
rust | annotations_per_function | <= | 1
rust | arguments_per_function | <= | 8
rust | boolean_parameters | <= | 1
rust | branches_per_function | <= | 9
rust | calls_per_function | <= | 45
rust | concrete_types_per_file | <= | 8
rust | cycle_size | <= | 0
rust | dependency_depth | <= | 3
rust | functions_per_file | <= | 40
rust | imported_names_per_file | <= | 50
rust | indirect_dependencies | <= | 10
rust | interface_types_per_file | <= | 0
rust | lines_per_file | <= | 900
rust | local_variables_per_function | <= | 20
rust | max_indentation_depth | <= | 5
rust | methods_per_class | <= | 10
rust | nested_function_depth | <= | 2
rust | returns_per_function | <= | 5
rust | statements_per_file | <= | 250
rust | statements_per_function | <= | 35
""")
def rule_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark).rules().select("language", "metric", "op", "threshold")


@expects("language VARCHAR, metric VARCHAR, threshold BIGINT", """
python | arguments_per_function | 4
python | lines_per_file | 120
python | max_indentation_depth | 9
python | returns_per_function | 2
rust | arguments_per_function | 4
rust | returns_per_function | 2
""")
def layered_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two settings texts change, the later one key by key; a section with an error is left out."""
    first, _, _ = config.parse("[python]\nmax_indentation = 9\nlines_per_file = 100\n[shared]\nreturns_per_function = 2\n", strict=False)
    second, _, _ = config.parse("[python]\nlines_per_file = 120\n[rust]\nno_such_limit = 1\nlines_per_file = 7\n[thresholds]\narguments = 4\n", strict=False)
    return spark.createDataFrame([(*k, v) for k, v in (first | second).items()], "language string, metric string, threshold bigint")


@expects("ord INTEGER, message VARCHAR", """
0 | [python]: unknown key 'statement_per_file'; did you mean 'statements_per_file'?
1 | unknown section [pyton]; did you mean [python]?
2 | [gate] min_similarity: out of range
3 | [rust] lines_per_file: a whole number from 0 is wanted
4 | [gate] duplication_enabled: wrong kind of value
""")
def settings_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = ["[python]\nstatement_per_file = 1", "[pyton]\nlines_per_file = 1", "[gate]\nmin_similarity = 2", "[rust]\nlines_per_file = -1", "[gate]\nduplication_enabled = 1"]
    return spark.createDataFrame([(k, e) for k, t in enumerate(texts) for e in config.parse(t, strict=False)[2]], "ord int, message string")


@expects("percent BIGINT, min_percent BIGINT, definitions BIGINT, threshold BIGINT, passed BOOLEAN", """
63 | 0 | 16 | 90 | false
""")
def tree_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark).gate()


@expects("file VARCHAR, definitions BIGINT, covered BIGINT, percent BIGINT", """
rs/src/lib.rs | 4 | 3 | 75
rs/src/util.rs | 2 | 0 | 0
src/shop/broken.py | 1 | 0 | 0
src/shop/lonely.py | 1 | 0 | 0
src/shop/prices.py | 2 | 1 | 50
""")
def failing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark).failing_files()


@expects("line VARCHAR", """
STAT:annotations_per_function:1:rs/src/lib.rs:24:peek
STAT:arguments_per_function:4:src/shop/cart.py:16:__init__
STAT:boolean_parameters:2:src/shop/cart.py:16:__init__
STAT:branches_per_function:2:rs/src/lib.rs:10:put
STAT:calls_per_function:5:rs/src/lib.rs:10:put
STAT:concrete_types_per_file:2:rs/src/lib.rs:1:lib
STAT:cycle_size:3:src/shop/__init__.py:1:shop
STAT:dependency_depth:3:src/shop/__init__.py:1:shop
STAT:fan_in:3:src/shop/cart.py:1:shop.cart
STAT:fan_out:4:tests/test_shop.py:1:tests.test_shop
STAT:functions_per_file:5:src/shop/cart.py:1:cart
STAT:imported_names_per_file:4:src/shop/cart.py:1:cart
STAT:indirect_dependencies:2:src/shop/__init__.py:1:shop
STAT:interface_types_per_file:1:rs/src/lib.rs:1:lib
STAT:inv_test_coverage:100:rs/src/util.rs:1:util
STAT:keyword_only_args:2:src/shop/cart.py:16:__init__
STAT:lines_per_file:45:src/shop/cart.py:1:cart
STAT:local_variables_per_function:3:rs/src/lib.rs:10:put
STAT:max_indentation_depth:4:src/shop/cart.py:21:total
STAT:methods_per_class:4:src/shop/cart.py:15:Cart
STAT:nested_function_depth:1:rs/src/lib.rs:10:put
STAT:positional_args:4:src/shop/lonely.py:1:alone
STAT:return_values_per_function:2:src/shop/cart.py:32:send
STAT:returns_per_function:2:rs/src/lib.rs:10:put
STAT:statements_per_file:18:src/shop/cart.py:1:cart
STAT:statements_per_function:8:rs/src/lib.rs:10:put
STAT:statements_per_try_block:3:src/shop/cart.py:32:send
""")
def stat_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest value of each metric."""
    return corpus(spark).top(1).select(render.stat_line().alias("line"))


@expects("line VARCHAR", """
...way/down/to/the/package/of/modules.py work                 function      12      7     2     3     1     1      4       -     -       -      -      -
b.py                                     b                    module         1      -     -     -     -     -      -       -    40       3      2      0
""")
def wide_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("src/a/very/long/way/down/to/the/package/of/modules.py", "work", "function", 12, 7, 2, 3, 1, 1, 4, None, None, None, None, None), ("b.py", "b", "module", 1, None, None, None, None, None, None, None, 40, 3, 2, 0)]
    names = [c for c, _ in render.WIDE] + [c for c, _ in render.WIDE_NUMBERS]
    kinds = ", ".join(f"{c} {'string' if k < 3 else 'bigint'}" for k, c in enumerate(names))
    return spark.createDataFrame(rows, kinds).select(F.rtrim(render.wide_line()).alias("line"))


RENAMED = "path VARCHAR, start_byte BIGINT, end_byte BIGINT, line BIGINT, kind VARCHAR, old_snippet VARCHAR, new_snippet VARCHAR"


@expects(RENAMED, """
src/shop/stock.py | 440 | 444 | 25 | call | find | seek
src/shop/stock.py | 59 | 63 | 5 | definition | find | seek
""")
def rename_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rename.plan(tree(spark), "src/shop/stock.py::find", "seek")


@expects(RENAMED, """
src/shop/cart.py | 328 | 333 | 21 | definition | total | sum_up
tests/test_shop.py | 115 | 120 | 7 | method | total | sum_up
""")
def rename_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rename.plan(tree(spark), "src/shop/cart.py::Cart.total", "sum_up")


@expects("path VARCHAR, start_byte BIGINT, end_byte BIGINT, line BIGINT, kind VARCHAR, old_md5 VARCHAR, new_md5 VARCHAR", """
src/shop/lonely.py | 0 | 35 | 1 | move | 0b795152ee46665ae62c42b77ce9fe10 | d41d8cd98f00b204e9800998ecf8427e
src/shop/prices.py | 292 | 292 | 17 | move | d41d8cd98f00b204e9800998ecf8427e | 03aa9db44279a5a3b8b83a461e4811ad
""")
def move_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = rename.plan(tree(spark), "src/shop/lonely.py::alone", "solo", "src/shop/prices.py")
    return planned.select("path", "start_byte", "end_byte", "line", "kind", F.md5("old_snippet").alias("old_md5"), F.md5("new_snippet").alias("new_md5"))


@expects("path VARCHAR, module VARCHAR, prefix VARCHAR, entry BOOLEAN, ignored BOOLEAN, in_tests BOOLEAN", """
/home/u/proj/deep/util.rs | proj.deep.util | proj/deep | false | false | false
bin/tool.rs | bin.tool | bin | true | false | false
crates/x/src/lib.rs | lib |  | true | false | false
src/a/b/mod.rs | a.b | a/b | false | false | false
src/env.rs | env |  | false | false | false
src/vendored/y.rs | vendored.y | vendored | false | true | false
src/venv/x.rs | venv.x | venv | false | true | false
x/tests/it_integration.rs | it_integration | x/tests | true | false | true
""")
def path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = ["src/a/b/mod.rs", "crates/x/src/lib.rs", "x/tests/it_integration.rs", "/home/u/proj/deep/util.rs", "src/venv/x.rs", "src/vendored/y.rs", "src/env.rs", "bin/tool.rs"]
    p = F.col("path")
    frame = spark.createDataFrame([(x,) for x in paths], "path string")
    return frame.select("path", T.module_name_rs(p).alias("module"), T.path_prefix(p, 2).alias("prefix"), T.is_entry_point(T.module_name_rs(p)).alias("entry"), T.ignored(p, ["vend/"]).alias("ignored"), T.in_tests_dir(p).alias("in_tests"))


@expects("k INTEGER, line BIGINT, word VARCHAR", """
1 | 3 | plain/x.py::t
2 | 1 | 'it'"'"'s'
3 | 2 | ''
4 | 1 | '-x'
5 | 3 | 'a b'
""")
def places_and_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of a byte, and a word quoted for a shell."""
    rows = [(1, "a\nb\nc", 4, "plain/x.py::t"), (2, "é\né\n", 2, "it's"), (3, "é\né\n", 3, ""), (4, "abc", 0, "-x"), (5, "\n\n", 2, "a b")]
    frame = spark.createDataFrame(rows, "k int, text string, byte int, word string")
    return frame.select("k", T.line_of(F.col("text"), F.col("byte")).alias("line"), T.shell_quoted(F.col("word")).alias("word"))


@expects("grp VARCHAR, title VARCHAR, nodes BIGINT", """
(other) | mixed | 2
a | a | 3
b | b | 2
""")
def coarse_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven modules in four directories as three groups, by their paths."""
    nodes = spark.createDataFrame([("a1", "src/a/x.py"), ("a2", "src/a/y.py"), ("a3", "src/a/z.py"), ("b1", "src/b/x.py"), ("b2", "src/b/y.py"), ("c1", "src/c/k/x.py"), ("d1", "src/d/x.py")], "node string, path string")
    groups, _ = coarsen.coarsen(nodes, spark.createDataFrame([("a1", "b1")], "src string, dst string"), 3)
    size = groups.groupBy("grp").agg(F.count("*").alias("nodes"))
    return size.join(coarsen.titles(groups, nodes), "grp").select("grp", "title", "nodes")


@expects("node VARCHAR, grp VARCHAR", """
a | a
b | a
c | c
d | c
e | e
f | e
""")
def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three pairs that need each other, and one edge between two of them, as three groups."""
    edges = [("a", "b"), ("b", "a"), ("c", "d"), ("d", "c"), ("e", "f"), ("f", "e"), ("b", "c")]
    nodes = spark.createDataFrame([(n, None) for n in "abcdef"], "node string, path string")
    groups, _ = coarsen.coarsen(nodes, spark.createDataFrame(edges, "src string, dst string"), 3)
    return groups


@expects("zoom DOUBLE, nodes INTEGER", """
0.0 | 1
0.25 | 3
0.5 | 6
1.0 | 10
""")
def zoom_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(z, graph.target_nodes(10, z)) for z in (0.0, 0.25, 0.5, 1.0)], "zoom double, nodes int")


@expects("node VARCHAR", """
py:shop
py:shop.cart
py:shop.prices
py:shop.stock
py:tests.test_shop
rs:lib
rs:util
""")
def merged_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ends of the edges of both languages, prefixed."""
    found, whole = corpus(spark), None
    for language, prefix in (("python", "py"), ("rust", "rs")):
        _, edges = graph.with_prefix(found.nodes(language).select("node"), found.edges(language), prefix)
        ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
        whole = ends if whole is None else whole.unionByName(ends)
    return whole.distinct()


@expects("language VARCHAR, metric VARCHAR, threshold BIGINT", """
python | annotations_per_function | 1
python | boolean_parameters | 2
python | branches_per_function | 2
python | calls_per_function | 5
python | keyword_only_args | 2
python | local_variables_per_function | 3
python | max_indentation_depth | 4
python | nested_function_depth | 1
python | positional_args | 4
python | return_values_per_function | 2
python | returns_per_function | 2
python | statements_per_function | 8
python | statements_per_try_block | 3
rust | annotations_per_function | 1
rust | boolean_parameters | 1
rust | branches_per_function | 2
rust | calls_per_function | 5
rust | local_variables_per_function | 3
rust | max_indentation_depth | 2
rust | nested_function_depth | 1
rust | returns_per_function | 2
rust | statements_per_function | 8
""")
def learned_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits that the tree just meets, of the measures of functions."""
    held = corpus(spark).mimic()
    return spark.createDataFrame([(*k, v) for k, v in held.items() if k[1] in PY_MEASURES], "language string, metric string, threshold bigint")


@expects("coverage BIGINT, duplicates BOOLEAN, orphans BOOLEAN", """
0 | false | false
""")
def learned_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = corpus(spark).mimic_gate()
    return spark.createDataFrame([(held["test_coverage_threshold"], held["duplication_enabled"], held["orphan_module_enabled"])], "coverage bigint, duplicates boolean, orphans boolean")
