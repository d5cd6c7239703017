import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from brute import words
from quillforge.llm import fingerprints as fp
from quillforge.llm.queries import QUERIES


def shingles(text, k=5):
    w = words(text, True)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(text, after):
    cut = len(text) // 4
    return text[: len(text) - cut] + after[:cut]


def test_query_on_the_whole_table(spark, sf_dir):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in QUERIES["op11_fingerprints"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    off = []
    for k, (d, text) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        r, changed = got[d], edited(text, after)
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert len(r.fingerprint) in (0, fp.BINS * fp.BITS // 4)
        off += [abs(r.near_edited - jaccard(text, changed)), abs(r.near_next - jaccard(text, after))]
    assert np.mean(off) < 0.02 and np.max(off) < 0.13
    by_text = {}
    for d, text in docs:
        assert by_text.setdefault(text, got[d].fingerprint) == got[d].fingerprint


def rows_of(spark, rows, parts, schema="doc_id long, text string, hash string, `a.b` int"):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], schema).repartition(parts)
    return sorted((tuple(r) for r in fp.compared(fp.successors(frame)).collect()), key=repr)


@pytest.mark.parametrize("arcs", [1, 7])
def test_cases(spark, monkeypatch, arcs):
    """Nulls, empty and long texts, ties, repeats; the same answer however the order is cut."""
    monkeypatch.setattr(fp, "parallelism", lambda _: arcs)
    draw = random.Random(4)
    pool = [f"w{i}" for i in range(400)]
    rows = [(3, None), (1, ""), (2, "Ünïcode ’text’ with few"), (-5, " \t\n "), (8, "one"), (2**62, "x y z " * 3), (9, " ".join(draw.choices(pool, k=60_000)))]
    rows += [(k, " ".join(draw.choices(pool, k=draw.randrange(1, 90)))) for k in range(20, 60)]
    got = {r[0]: r for r in rows_of(spark, rows, 3)}
    ids = sorted(d for d, _ in rows)
    text = {d: t or "" for d, t in rows}
    for k, d in enumerate(ids):
        after = text[ids[(k + 1) % len(ids)]]
        _, n, sha, near, following, own, other = got[d]
        changed = edited(text[d], after)
        assert (n, sha) == (len(text[d]), hashlib.sha256(changed.encode()).hexdigest())
        assert abs(near - jaccard(text[d], changed)) < 0.15 and abs(following - jaccard(text[d], after)) < 0.15
        assert (own == "") == (not text[d].split()) and own == fp.fingerprint(pa.array([text[d]]))[0].hex()


@pytest.mark.parametrize("arcs", [1, 5])
def test_repeated_and_missing_ids(spark, monkeypatch, arcs):
    monkeypatch.setattr(fp, "parallelism", lambda _: arcs)
    rows = [(7, f"text {k} of one id and more words") for k in range(30)] + [(None, f"no id {k}") for k in range(20)] + [(1, "first"), (7, "same"), (7, "same"), (None, None)]
    orders = [rows_of(spark, draw, parts) for draw, parts in ((rows, 1), (rows[::-1], 4))]
    assert orders[0] == orders[1] and len(orders[0]) == len(rows)
    shas = {hashlib.sha256(edited(a or "", b or "").encode()).hexdigest() for _, a in rows for _, b in rows}
    assert {r[2] for r in orders[0]} <= shas


def test_one_row_and_none(spark):
    assert rows_of(spark, [(5, "a b c d e f g h")], 1)[0][3:5] == (pytest.approx(jaccard("a b c d e f g h", "a b c d e f a b"), abs=0.15), 1.0)
    assert rows_of(spark, [], 1) == []
    assert fp.fingerprints(spark.createDataFrame([], "`x.y` string, text string"), id_col="x.y").collect() == []
    assert [r.id for r in fp.fingerprints(spark.createDataFrame([("q", None)], "`x.y` string, text string"), id_col="x.y").collect()] == ["q"]


def test_densification_and_bias():
    """Few shingles fill all bins, in the same way for every text; unlike texts come out near 0."""
    dense = fp.densify(fp.bin_minima(pa.array(["a b c", "", "b c d"]), bins=64))
    assert len(set(dense[0].tolist())) == 1 and (dense[1] == 2**64 - 1).all()
    one, none, two = fp.pack(dense, 4)
    assert none == b"" and len(one) == 32 and fp.likeness([one, none, one], [two, none, none], 64, 4) == [pytest.approx(0, abs=0.2), 1.0, 0.0]
    draw = np.random.default_rng(1)
    texts = [" ".join(f"w{i}" for i in draw.integers(0, 10**6, 300)) for _ in range(80)]
    found = fp.fingerprint(pa.array(texts), bins=128, bits=1)
    raw = np.array(fp.likeness(found[:40], found[40:], 128, 1))
    assert raw.mean() < 0.08  # one bit agrees in half of the bins
