"""How the sources of a language differ in their words: chi-square terms over add-one frequencies, exact.

A language keeps the terms that at least LEAST of its documents hold. A group (a language's source) gives
each kept term p = 1 + floor(SCALE * (count + 1) / (N + V)); two groups differ by the sum of
f(p, q) = floor((p - q)^2 / q) over all V kept terms, most of which a group lacks.

That sum is not gone through term by term: each pair starts at V * f of both zero counts, and only what
departs from it is added. (1) A term that one group holds alone counts as f(p, q0) - f(p0, q0), or
the other way round; how many of a group's terms have which count decides it, whatever the terms are. (2) A
term that both hold takes back both of these and puts f(p, q) in their place; it is found where the
term's postings meet, in arrays, a bounded number of pairs at a time, summed before they leave the task.
Words are counted in the slices that hold the texts and combined by Spark before and after the shuffle; a
frequent word, language or source is some rows a task. Small tables of groups are joined in SALTS parts.

Cases: null text, language or source reads as empty, as which it is a group like any other; a group without kept
terms has p of zero counts throughout; a language without kept terms differs by 0; a language with one
source has no pair; equal values are ordered by item; texts are taken whole, about 4 MB or one longer text
at once; rows that repeat an id are documents of their own; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillforge.llm.common import byte_view, materialise, parallelism, slices, strings, table

LEAST, SCALE, TERMS = 3, 1_000_000_000, 200
#: Parts into which the rows of a group are dealt where they meet the small table of groups.
SALTS = 16
#: Pairs of postings that are compared at once.
PAIRS = 1 << 19

_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def terms_of(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The text of each term, and the terms, in order."""
    data, offsets = byte_view(texts)
    inside = _LETTER[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start = np.flatnonzero(first)
    ends = np.concatenate([[0], np.cumsum(np.flatnonzero(last) + 1 - start)]).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(_LOWER[data[inside]]))])
    return np.searchsorted(offsets, start, side="right") - 1, found.dictionary_encode()


def counted(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with the sum of their values and how many there were."""
    by = np.argsort(keys, kind="stable")
    keys, values = keys[by], values[by]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(values, at) if len(at) else values, np.diff(np.append(at, len(keys)))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, c, d): occurrences in a group, and its documents that hold the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            doc, coded = terms_of(strings(batch.column(2)))
            names = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            number = {name: k for k, name in enumerate(dict.fromkeys(names))}
            group = np.array([number[name] for name in names], dtype=np.int64)
            size = max(1, len(coded.dictionary))
            held, c, _ = counted(doc * size + coded.indices.to_numpy(), np.ones(len(doc), np.int64))
            keys, c, d = counted(group[held // size] * size + held % size, c)
            of, each = pa.array(keys // size), list(number)
            columns = [pa.array([x[k] for x in each], pa.string()).take(of) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*columns, coded.dictionary.take(pa.array(keys % size)).cast(pa.string()), pa.array(c), pa.array(d)], names=["lang", "source", "term", "c", "d"])

    found = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, c long, d long")
    return found.groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """p; decimals keep the product exact."""
    up = (count + 1).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", up, (total + kept).cast("decimal(19,0)")).cast("long") + 1


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def salted(rows: DataFrame, groups: DataFrame, on: list[str], by: str) -> DataFrame:
    """rows joined with a small table; the rows of a large group do not meet in one task."""
    copies = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(by, F.lit(13)), F.lit(SALTS)).cast("int")).join(copies, [*on, "salt"]).drop("salt")


def kept_terms(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, source, term, c, lang_c, head): counts of kept terms; head marks one row of each term."""
    term = Window.partitionBy("lang", "term")
    counts = term_counts(docs).select("lang", "source", "term", "c", F.sum("d").over(term).alias("held"), F.sum("c").over(term).alias("lang_c"), (F.min("source").over(term) == F.col("source")).alias("head"))
    return counts.filter(F.col("held") >= least).drop("held")


def group_table(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, n, v, lang_n, p0) of every group."""
    own = kept.groupBy("lang", "source").agg(F.sum("c").alias("n"))
    of_lang = kept.filter("head").groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_c").alias("lang_n"))
    groups = docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["n", "v", "lang_n"])
    return groups.withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0), F.col("n"), F.col("v"))).otherwise(F.lit(1)).cast("long"))


def _codes(rows: pa.Table, name: str) -> tuple[np.ndarray, pa.Array]:
    coded = rows.column(name).combine_chunks().dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def met(rows: pa.Table, most: int = PAIRS) -> Iterator[pa.RecordBatch]:
    """(lang, a, b, delta) of all pairs of postings of a term; rows are in the order of (lang, term)."""

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) * (p - q) // q

    (lang, langs), (source, sources), (term, _) = (_codes(rows, c) for c in ("lang", "source", "term"))
    p, p0 = rows.column("p").to_numpy(), rows.column("p0").to_numpy()
    start = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (lang[1:] != lang[:-1])]))
    n = np.diff(np.append(start, len(term)))
    begin, reach = np.repeat(start, n), np.repeat(n, n)
    upto, low, size = np.cumsum(reach), 0, len(sources)
    while low < len(term):
        high = max(low + 1, int(np.searchsorted(upto, upto[low] - reach[low] + most, side="right")))
        k = reach[low:high]
        left = np.repeat(np.arange(low, high), k)
        right = np.repeat(begin[low:high], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        left, right = left[left != right], right[left != right]
        a, b, a0, b0 = p[left], p[right], p0[left], p0[right]
        keys, total, _ = counted((lang[left] * size + source[left]) * size + source[right], f(a, b) - f(a, b0) - f(a0, b) + f(a0, b0))
        pair = keys % (size * size)
        named = [langs.take(pa.array(keys // (size * size))), sources.take(pa.array(pair // size)), sources.take(pa.array(pair % size))]
        yield pa.RecordBatch.from_arrays([*named, pa.array(total)], names=["lang", "a", "b", "delta"])
        low = high


def shared_terms(known: DataFrame, most: int = PAIRS) -> DataFrame:
    """(lang, a, b, delta): what terms that both sources hold add, over what they add alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            last = tuple(batch.column(c)[-1].as_py() for c in ("lang", "term"))
            (lang, langs), (term, terms) = (_codes(pa.Table.from_batches([batch]), c) for c in ("lang", "term"))
            open_ = (lang == langs.index(last[0]).as_py()) & (term == terms.index(last[1]).as_py())
            at = int(np.argmax(open_))  # where the last term's postings begin, which may go on
            if at:
                yield from met(pa.Table.from_batches([*rest, batch.slice(0, at)]), most)
                rest = []
            elif rest and tuple(rest[0].column(c)[0].as_py() for c in ("lang", "term")) != last:
                yield from met(pa.Table.from_batches(rest), most)
                rest = []
            rest.append(batch.slice(at))
        if rest:
            yield from met(pa.Table.from_batches(rest), most)

    dealt = known.select("lang", "term", "source", "p", "p0").repartition(parallelism(known.sparkSession), "lang", "term").sortWithinPartitions("lang", "term")
    return dealt.mapInArrow(run, "lang string, a string, b string, delta long")


def lone_terms(known: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, delta): what the terms of one source add where the other's count is zero."""
    equal = known.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("k"))
    p, p0, q0, k = (F.col(c) for c in ("p", "p0", "q0", "k"))
    others = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0"))
    both = salted(equal, others, ["lang"], "p").filter("source <> other")
    row = lambda a, b, new, old: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), (k * (new - old)).alias("delta"))
    rows = F.array(row("source", "other", apart(p, q0), apart(p0, q0)), row("other", "source", apart(q0, p), apart(q0, p0)))
    return both.select("lang", F.explode(rows).alias("x")).select("lang", "x.a", "x.b", "x.delta")


def divergence(docs: DataFrame, least: int = LEAST, terms: int = TERMS, most: int = PAIRS) -> DataFrame:
    """(lang, source, part, item, value, rank); docs has lang, source and text."""
    read = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept = materialise(kept_terms(read, least), "kept")
    groups = materialise(group_table(read, kept), "groups")
    known = salted(kept, groups, ["lang", "source"], "term")
    known = materialise(known.select("lang", "source", "term", "p0", share(F.col("c"), F.col("n"), F.col("v")).alias("p"), share(F.col("lang_c"), F.col("lang_n"), F.col("v")).alias("q")), "known")
    own = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    above = known.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    first = above.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= terms)
    others = groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("q0"))
    pairs = groups.join(others, "lang").filter("source <> b").select("lang", F.col("source").alias("a"), "b", (F.col("v") * apart(F.col("p0"), F.col("q0"))).alias("delta"))
    parts = pairs.unionByName(lone_terms(known, groups)).unionByName(shared_terms(known, most))
    summed = parts.groupBy("lang", "a", "b").agg(F.sum(F.col("delta").cast("decimal(20,0)")).cast("long").alias("value"))
    whole = summed.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value")
    return whole.withColumn("rank", F.row_number().over(own)).unionByName(first)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every source of a language, how far each other one is, and the terms that it has above the language."""
    return divergence(table(spark, sf_dir, "documents"))


OP13_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (SELECT d, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs),
kept AS (SELECT lang, term, count(*)::HUGEINT AS lang_c FROM words GROUP BY ALL HAVING count(DISTINCT d) >= {LEAST}),
counts AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(c)::HUGEINT AS n FROM counts GROUP BY ALL),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(lang_c)::HUGEINT AS n FROM kept GROUP BY ALL),
groups AS (SELECT DISTINCT docs.lang, docs.source, coalesce(totals.n, 0) AS n, coalesce(v, 0) AS v FROM docs LEFT JOIN totals USING (lang, source) LEFT JOIN langs ON langs.lang = docs.lang),
shares AS (SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, 1 + {SCALE} * (coalesce(c, 0) + 1) // (g.n + g.v) AS p FROM groups g JOIN kept k USING (lang) LEFT JOIN counts USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (
    SELECT s.lang, s.source, 'term' AS part, s.term AS item, (s.p - q) * (s.p - q) // q AS value
    FROM shares s JOIN (SELECT lang, term, 1 + {SCALE} * (lang_c + 1) // (n + v) AS q FROM kept JOIN langs USING (lang)) USING (lang, term) WHERE c > 0 AND s.p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM every UNION ALL FROM terms))
WHERE part = 'pair' OR rank <= {TERMS}
"""
