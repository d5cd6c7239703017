import collections
import random
import re

import compare
import pytest
from pyspark.sql import functions as F
from quillforge.llm import divergence as dv
from quillforge.llm.queries import ORACLES, QUERIES

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, limit=200):
    count, held, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), collections.defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        found = collections.Counter(t.translate(LOWER) for t in TERM.findall(text or ""))
        count[lang, source].update(found)
        held[lang].update(set(found))
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for t, n in held[lang].items() if n >= 3)
        totals = {s: sum(count[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (count[lang, s][t] + 1) // (totals[s] + len(kept)) for t in kept} for s in sources}
        whole = {t: sum(count[lang, s][t] for s in sources) for t in kept}
        q = {t: 1 + 10**9 * (whole[t] + 1) // (sum(whole.values()) + len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), "pair") for o in sources if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode(), "term") for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            out |= {(lang, s, part, item.decode(), -v, r + 1) for found in (sorted(pairs), sorted(terms)[:limit]) for r, (v, item, part) in enumerate(found)}
    return out


def found(spark, rows, parts=3, limit=200, pairs=dv.PAIRS):
    frame = spark.createDataFrame([(*r, 1) for r in rows], "lang string, source string, text string, `a.b` int").repartition(parts)
    frame = frame.withColumns({c: F.lit("x") for c in ("term", "p0", "salt", "value", "item")})
    got = [tuple(r) for r in dv.divergence(frame, terms=limit, most=pairs).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_query_matches_its_sql(spark, sf_dir):
    rows = compare.rows_of_frame(QUERIES["op13_divergence"](spark, sf_dir))
    assert rows == compare.rows_of_sql(compare.connect(sf_dir), ORACLES["op13_divergence"]) and rows[1]


@pytest.mark.parametrize("pairs", [7, 1 << 19])
def test_cases(spark, pairs):
    """Nulls, empty texts and groups, a hot source, a very long text, ties, repeats and odd letters."""
    draw = random.Random(2)
    pool = ["The", "the", "Ähre", "ähre", "x1y", "a-b", "é", "naïve", "中文", "z" * 300, "don't", "[q]", "İ"]
    rows = [(draw.choice(["en", "en", "de", None, ""]), draw.choice(["web", "web", "web", "book", None, "Z", "ß", "news"]), " ".join(draw.choices(pool, k=draw.randrange(0, 12)))) for _ in range(120)]
    rows += [("fr", "one", "seul seul"), ("it", "a", "mai due"), ("it", "b", "mai"), ("xx", "a", None), ("xx", "b", ""), (None, None, None), ("en", "empty", "12 34 --")]
    rows += [("en", "web", "the same row")] * 5 + [("en", "long", "the word ähre " * 120_000)]
    for parts in (1, 4):
        assert found(spark, rows, parts, pairs=pairs) == brute(rows)


def test_only_first_terms_and_no_rows(spark):
    rows = [("en", s, " ".join(f"{s}word{chr(97 + k // 26)}{chr(97 + k % 26)} shared" for k in range(n))) for s, n in (("a", 30), ("b", 9)) for _ in range(3)]
    rows = [(x, s, re.sub(r"\d", "", t)) for x, s, t in rows]
    assert found(spark, rows, limit=5) == brute(rows, 5)
    assert found(spark, []) == set()


def test_postings_that_span_batches(spark):
    """A term's postings may go on in the next batch, and in the one after that."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        rows = [("en", f"s{k}", t) for k in range(11) for t in ("alpha beta", "alpha", "alpha gamma beta")] + [("de", f"s{k}", "alpha alpha") for k in range(3)]
        assert found(spark, rows) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
