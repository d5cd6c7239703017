"""Secret scans: three base patterns, and zstandard novelty for strings in a sensitive context.

The value of every base span is measured, and so is every other candidate: a run of SHORTEST or more
token characters with a sensitive word in the AROUND characters on either side (of a run that holds
such words, what stands before, between and after them), or of ASSIGNED or more right behind a sensitive name and
`=` or `:`. Its novelty is what it adds to the compressed size of its surroundings, for each of its
own bytes, under a compressor primed with a dictionary of identifiers: a known or repeated name adds
next to nothing, a random string about its own length. A candidate that touches no base span and
reaches NOVEL is reported as `novel`. AROUND, SHORTEST, ASSIGNED and NOVEL define what a sensitive
context and an incompressible string are; they hold for every text alike.

Cases: null and empty texts have no spans; spans are code points, end exclusive; a very long text is
scanned whole, in time that grows with its length; equal starts go by kind as listed, so equal texts
give equal spans, and repeated rows are rows each; an empty table gives no rows; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession

from quillforge.llm.common import mapped, slices, strings, table

KINDS = ("assign", "access", "hex", "novel")
AROUND, SHORTEST, ASSIGNED = 512, 16, 12
NOVEL = 0.75
LEVEL = 6

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
# A run of one class that is too short fails as a whole, so the least length can stand in the pattern.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_SENSITIVE = re.compile(r"password|passwd|secret|token|api[_-]?key|credential|authorization|bearer|private[_-]?key|access[_-]?key|signature", re.IGNORECASE | re.ASCII)
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % ASSIGNED)
_ASSIGNMENT = re.compile(r"""["']?\s*[:=]\s*["']?""")
#: A superset of what any of the above can match; RE2 runs it over whole columns.
_GATE = r"[0-9a-f]{16}|AKIA[A-Z0-9]{14}|(?i:passw|secret|token|api[_-]?key|credential|authorization|bearer|private[_-]?key|access[_-]?key|signature)"

#: Names that code and configuration use around secrets, as the dictionary's content.
IDENTIFIERS = (
    "access_key access_token account address algorithm api_key apikey application authorization bearer bucket "
    "certificate class client_id client_secret config connection const content cookie credential credentials database "
    "default description digest endpoint environment example export expires function header host hostname https "
    "identifier import index integer localhost message method number object options output parameter password "
    "placeholder private_key production property protocol provider public_key redirect region request required "
    "resource response return secret secret_key security self server service session_token settings signature "
    "staging static string struct subscription template tenant timeout token undefined update username value version "
    "webhook 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ your_api_key_here changeme xxxxxxxxxxxxxxxx"
)


#: (start, end, kind, start of the value, novelty of the value)
Span = tuple[int, int, str, int, float]


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, start of the value) of the three base patterns."""
    found = [(m.start(), m.end(), "assign", m.start(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [(m.start(), m.end(), "access", m.start()) for m in _ACCESS.finditer(text)]
    return found + [(m.start(), m.end(), "hex", m.start()) for m in _HEX.finditer(text)]


@functools.cache
def _press() -> zstandard.ZstdCompressor:
    """One compressor a process, with the dictionary digested once."""
    primed = zstandard.ZstdCompressionDict((IDENTIFIERS + " ").encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    primed.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=primed, write_checksum=False, write_content_size=False)


def novelty(candidate: str, before: str, after: str) -> float:
    """Marginal compressed bytes of the candidate for each of its own, given its surroundings."""
    context = (before + "\n" + after + "\n").encode("utf-8", "ignore")
    own = candidate.encode("utf-8", "ignore")
    return (len(_press().compress(context + own)) - len(_press().compress(context))) / max(1, len(own))


def _measure(text: str, a: int, b: int) -> float:
    return novelty(text[a:b], text[max(0, a - AROUND) : a], text[b : b + AROUND])


def novel_spans(text: str, base: list[tuple[int, int, str, int]]) -> list[Span]:
    words = [m.span() for m in _SENSITIVE.finditer(text)]
    if not words:
        return []
    starts, ends = [a for a, _ in words], [b for _, b in words]
    taken: list[list[int]] = []  # base spans, those that overlap as one
    for a, b in sorted((a, b) for a, b, _, _ in base):
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(b, taken[-1][1])
        else:
            taken.append([a, b])
    taken_ends = [b for _, b in taken]
    found: list[Span] = []
    for m in _CANDIDATE.finditer(text):
        a, b = m.span()
        near = bisect.bisect_right(ends, b + AROUND) - bisect.bisect_left(starts, a - AROUND)
        if near <= 0:
            continue
        inner = words[bisect.bisect_right(ends, a) : bisect.bisect_left(starts, b)]
        # a run that holds such words itself is measured before, between and after them
        edges = [a, *itertools.chain.from_iterable(inner), b]
        parts = list(zip(edges[::2], edges[1::2], strict=True)) if inner else []
        for x, y in [(a, b)] * (near > len(inner)) + parts:
            named = range(bisect.bisect_left(ends, x - 8), bisect.bisect_left(ends, x))
            least = ASSIGNED if any(_ASSIGNMENT.fullmatch(text, ends[q], x) for q in named) else SHORTEST
            t = bisect.bisect_right(taken_ends, x)
            if y - x < least or (t < len(taken) and taken[t][0] < y):
                continue
            if (new := _measure(text, x, y)) >= NOVEL:
                found.append((x, y, "novel", x, new))
                if (x, y) == (a, b):
                    break
    return found


def find_spans(text: str) -> list[Span]:
    """All spans by start, then kind as listed."""
    base = base_spans(text)
    found = [(a, b, kind, v, _measure(text, v, b)) for a, b, kind, v in base]
    return sorted(found + novel_spans(text, base), key=lambda s: (s[0], KINDS.index(s[2])))


def _gate(texts: pa.Array) -> list[bool]:
    return pc.match_substring_regex(texts, _GATE).to_pylist()


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) of every row; spans are an array of (kind, start, end, value_start, novelty)."""
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value_start", pa.int64()), ("novelty", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = strings(batch.column(1))
            spans = [[{"kind": k, "start": a, "end": b, "value_start": v, "novelty": x} for a, b, k, v, x in find_spans(t.as_py())] if hit else [] for t, hit in zip(texts, _gate(texts), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(span))], names=["id", "spans"])

    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, spans array<struct<kind:string,start:long,end:long,value_start:long,novelty:double>>")
    return out.withColumnRenamed("id", id_col)


def redact(text: str, mark: str = "[REDACTED]") -> str:
    """The text with the value of each span replaced; overlapping values count as one."""
    parts, at = [], 0
    for a, b in sorted((v, b) for _, b, _, v, _ in find_spans(text)):
        if a >= at:
            parts += [text[at:a], mark]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def redact_texts(docs: DataFrame) -> DataFrame:
    """`docs` with secrets replaced in `text`, and `n_chars` (if there) set to the new length."""
    k, n = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, k):
            hits = _gate(strings(batch.column(k)))
            texts = [redact(t) if hit and t is not None else t for t, hit in zip(batch.column(k).to_pylist(), hits, strict=True)]
            columns = list(batch.columns)
            columns[k] = pa.array(texts, batch.schema.field(k).type)
            if n is not None:
                columns[n] = pa.array([old if t is None or not hit else len(t) for t, hit, old in zip(texts, hits, batch.column(n).to_pylist(), strict=True)], batch.schema.field(n).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return mapped(docs, run)


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    kind = scanned.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).to_pylist()
            count = lambda k: pa.array([sum(s["kind"] == k for s in r) for r in rows], pa.int64())
            joined = lambda r: ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in r)
            base = [hashlib.sha256(joined([s for s in r if s["kind"] != "novel"]).encode()).hexdigest() for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), count("assign"), count("access"), count("hex"), count("novel"), pa.array(base, pa.string()), pa.array(list(map(joined, rows)), pa.string()), pa.array([max((s["novelty"] for s in r), default=None) for r in rows], pa.float64())], names=["id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans", "most_novel"])

    return scanned.select(scanned[id_col].alias("id"), "spans").mapInArrow(run, f"id {kind}, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string, most_novel double").withColumnRenamed("id", id_col)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: base patterns and novel strings."""
    return digest(scan(table(spark, sf_dir, "documents")))
