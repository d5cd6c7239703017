"""Row-local text and path expressions; all are built-in functions on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The code points of Unicode white space but the space itself.
WHITE = "\t\n\x0b\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def normalize_code(text: Column) -> Column:
    """ASCII lower case, digit runs as N, white space runs (Unicode) as one space, trimmed."""
    low = F.translate(text, UPPER + WHITE, LOWER + " " * len(WHITE))
    return F.trim(F.regexp_replace(F.regexp_replace(low, "[0-9]+", "N"), "  +", " "))


def tokens(text: Column) -> Column:
    """White space tokens of a normalised text; none for an empty one."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))


def words(text: Column) -> Column:
    """Runs of bytes other than ASCII white space."""
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda t: t != "")


def line_count(text: Column) -> Column:
    """Lines as an editor counts them: a last line end adds none; an empty text has none."""
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (ends + F.when((F.length(text) > 0) & ~text.endswith("\n"), 1).otherwise(0)).cast("long")


def line_of(text: Column, byte: Column) -> Column:
    """The line (from 1) that a byte offset of a text's UTF-8 form is in."""
    ahead = F.substring(F.encode(text, "UTF-8"), F.lit(1), byte.cast("int"))
    return (F.length(ahead) - F.length(F.encode(F.replace(F.decode(ahead, "ISO-8859-1"), F.lit("\n"), F.lit("")), "ISO-8859-1")) + 1).cast("long")


def shell_quoted(text: Column) -> Column:
    """A word for a POSIX shell."""
    safe = text.rlike("^[A-Za-z0-9_./:=,][A-Za-z0-9_./:=,-]*$")
    return F.when(safe, text).otherwise(F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\"'\"'")), F.lit("'")))


def shingles(tokens_col: Column, k: int) -> Column:
    """Windows of k tokens joined by a space; none if there are fewer or k is 0."""
    if k <= 0:
        return F.array().cast("array<string>")
    at = F.when(F.size(tokens_col) >= k, F.sequence(F.lit(1), F.size(tokens_col) - (k - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(tokens_col, i, F.lit(k)), " "))


def md5_prefix(text: Column) -> Column:
    """The first 60 bits of the MD5 as a long; the same number in other SQL engines."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def truncate_left(text: Column, most: int) -> Column:
    """The end of a long text behind three points."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.lit("..."), F.right(text, F.lit(most - 3))))


def path_parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def stem(path: Column) -> Column:
    """The file name without its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), "(.)\\.[^.]*$", "$1")


def _dirs(path: Column) -> Column:
    """Directory parts; points inside a part are left out of module names."""
    parts = path_parts(path)
    return F.when(F.size(parts) > 1, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<string>"))


def _after(dirs: Column, marks: tuple[str, ...]) -> Column:
    """The parts after the last of the marks, or all of them."""
    last = F.greatest(*(F.size(dirs) + 1 - F.coalesce(F.nullif(F.array_position(F.reverse(dirs), m), F.lit(0)), F.size(dirs) + 1) for m in (*marks, marks[0])))
    return F.slice(dirs, last + 1, F.size(dirs))


def module_name_py(path: Column) -> Column:
    """Dotted module name from the directories after the last `src`; a package's own file names the package."""
    dirs = _after(_dirs(path), ("src",))
    whole = F.when(stem(path) == "__init__", dirs).otherwise(F.concat(dirs, F.array(stem(path))))
    return F.array_join(F.transform(whole, lambda p: F.translate(p, ".", "")), ".")


def bare_name_py(path: Column) -> Column:
    dirs = _dirs(path)
    return F.when((stem(path) == "__init__") & (F.size(dirs) > 0), F.element_at(dirs, -1)).otherwise(stem(path))


def module_name_rs(path: Column) -> Column:
    """Dotted module name after the last `src` or `tests`; mod.rs names its directory."""
    dirs = _dirs(path)
    marked = F.arrays_overlap(dirs, F.array(F.lit("src"), F.lit("tests")))
    near = F.when(~marked & path.startswith("/") & (F.size(dirs) > 2), F.slice(dirs, -2, 2)).otherwise(_after(dirs, ("src", "tests")))
    whole = F.when((stem(path) == "mod") & (F.size(near) > 0), near).otherwise(F.concat(near, F.array(stem(path))))
    return F.array_join(whole, ".")


def module_suffix(path: Column) -> Column:
    return F.array_join(F.concat(_dirs(path), F.array(stem(path))), ".")


def path_identifiers(path: Column) -> Column:
    return F.array_distinct(F.concat(_dirs(path), F.array(stem(path))))


def path_prefix(path: Column, depth: int) -> Column:
    """The first `depth` directories after the last `src` (or of the last two of an absolute path)."""
    dirs = _dirs(path)
    marked = F.array_contains(dirs, "src")
    near = F.when(~marked & path.startswith("/") & (F.size(dirs) > 2), F.slice(dirs, -2, 2)).otherwise(_after(dirs, ("src",)))
    return F.array_join(F.slice(near, 1, depth), "/")


def is_test_path(path: Column) -> Column:
    """Python: test_*.py, *_test.py with a name before it, conftest.py, or a tests directory."""
    name = F.element_at(F.split(path, "/"), -1)
    return name.rlike("^test_.*\\.py$") | (name.endswith("_test.py") & (F.length(name) > 8)) | (name == "conftest.py") | in_tests_dir(path)


def is_test_path_rs(path: Column) -> Column:
    return path.endswith(".rs") & (stem(path).endswith("_test") | stem(path).startswith("test_") | stem(path).endswith("_integration") | in_tests_dir(path))


def in_tests_dir(path: Column) -> Column:
    return F.arrays_overlap(path_parts(path), F.array(F.lit("tests"), F.lit("test")))


def ignored(path: Column, prefixes: list[str] | None = None) -> Column:
    """A directory that is always left out, or one that starts with a given prefix."""
    # Directories that no scan enters.
    always = ("__pycache__", "node_modules", ".venv", "venv", "env")
    dirs = _dirs(path)
    cleaned = [p.strip().rstrip("/") for p in prefixes or [] if p.strip().rstrip("/")]
    out = F.arrays_overlap(dirs, F.array(*map(F.lit, always)))
    if cleaned:
        out = out | F.exists(dirs, lambda d: F.exists(F.array(*map(F.lit, cleaned)), lambda p: F.startswith(d, p)))
    return F.coalesce(out, F.lit(False))


def is_identifier(text: Column) -> Column:
    return text.rlike("^[A-Za-z_][A-Za-z0-9_]*$")


def is_entry_point(module: Column) -> Column:
    """Modules that nothing needs to import."""
    # Last segments that start programs, builds and tests.
    names = ("main", "lib", "build", "__main__", "__init__", "tests", "conftest", "setup")
    bare = F.element_at(F.split(module, "\\."), -1)
    return module.rlike("(^|\\.)tests(\\.|$)|(^|\\.)bin\\.") | (module == "bin") | bare.isin(*names) | bare.rlike("^test_|_test$|_integration|_bench")


def dot_label(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def mermaid_label(text: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def mermaid_id(prefix: str, text: Column) -> Column:
    """prefix__name in lower case, with anything but ASCII letters and digits as _."""
    made = F.concat(F.lit(prefix + "__"), F.translate(F.regexp_replace(text, "[^A-Za-z0-9]", "_"), UPPER, LOWER))
    return F.when(made.rlike("^[0-9]"), F.concat(F.lit("n"), made)).otherwise(made)


def candidates_text(names: Column, most: int = 3) -> Column:
    """The first names, with a mark that more follow."""
    return F.concat(F.array_join(F.slice(names, 1, most), ", "), F.when(F.size(names) > most, F.lit(", …")).otherwise(F.lit("")))


def fnv1a64(value: Column) -> Column:
    """FNV-1a in 64 bits over a string's UTF-8 bytes, as 16 hexadecimal digits.

    Products wrap around at 2^64 by keeping two halves of 32 bits: the prime is 2^40 + 435."""
    half = F.lit(0xFFFFFFFF)
    each = F.transform(F.regexp_extract_all(F.hex(value.cast("binary")), F.lit(".."), F.lit(0)), lambda x: F.conv(x, 16, 10).cast("long"))
    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))

    def step(h: Column, byte: Column) -> Column:
        lo = h["lo"].bitwiseXOR(byte)
        low = lo * 435
        return F.struct((h["hi"] * 435 + F.shiftright(low, 32) + F.shiftleft(lo, 8)).bitwiseAND(half).alias("hi"), low.bitwiseAND(half).alias("lo"))

    digits = lambda x: F.lpad(F.hex(x), 8, "0")
    return F.aggregate(each, start, step, lambda h: F.lower(F.concat(digits(h["hi"]), digits(h["lo"]))))
