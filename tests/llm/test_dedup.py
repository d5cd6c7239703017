import hashlib
import random

import numpy as np
import pytest
from brute import near_duplicates, repeats
from pyspark.sql import functions as F
from quillforge.llm import ledger, neardup, substrings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk int, row string, id long"


def frame(spark, docs, parts=3):
    return spark.createDataFrame([(d, t, None, "s", None if t is None else len(t), 1, "x", 5) for d, t in docs], SCHEMA).repartition(parts)


def corpus(seed, n=120):
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    text = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    base, passage = text(150), text(60)
    docs = []
    for d in range(n):
        kind = d % 6
        if kind == 0:
            w = text(draw.randrange(0, 80))
        elif kind == 1:
            w = list(base)
            for _ in range(draw.randrange(0, 14)):
                w[draw.randrange(len(w))] = draw.choice(vocabulary)
        elif kind == 2:
            w = text(30) + passage[draw.randrange(0, 30) :] + text(20)
        elif kind == 3:
            w = docs[draw.randrange(len(docs))][1].split() if docs else []
        elif kind == 4:
            w = text(draw.randrange(0, 4))
        else:
            w = [draw.choice("ab")] * draw.randrange(0, 40)
        docs.append((d * 7 + 3, draw.choice([" ", "\n", "\t  "]).join(w)))
    return docs


@pytest.mark.parametrize("k", [2, 5])
def test_components_match_brute_force(spark, k):
    docs = corpus(k)
    found = {r.id: (r.n, r.component_id) for r in neardup.components(frame(spark, docs), k=k).collect()}
    assert found == near_duplicates(docs, k)


def test_components_of_chains_across_lists(spark, monkeypatch):
    """Neighbours in a drifting chain link although its ends do not; lists are cut into blocks."""
    monkeypatch.setattr(neardup, "LIST", 8)
    draw = random.Random(9)
    w, docs = [f"v{k}" for k in range(200)], []
    for d in range(60):
        docs.append((d, " ".join(w)))
        for _ in range(3):
            w[draw.randrange(len(w))] = f"n{draw.random()}"
    want = near_duplicates(docs, 2)
    assert {r.id: (r.n, r.component_id) for r in neardup.components(frame(spark, docs), k=2).collect()} == want
    assert len({c for _, c in want.values()}) < 10


def test_across_finds_matches_that_leaders_miss():
    base = np.arange(64, dtype=np.uint16)
    a, b, c = base.copy(), base.copy(), base.copy()
    b[:20] += 1000
    c[:34] += 2000
    rows = {"id": np.array([1, 2, 3]), "sig": np.stack([a, b, c]), "n": np.full(3, 100), "comp": np.array([1, 2, 2]), "home": np.ones(3, bool)}
    pairs = lambda: {tuple(p) for x in neardup._across(neardup.List(rows, np.arange(3), 80)) for p in np.stack(x, axis=1).tolist()}
    assert pairs() == {(1, 2)}
    rows["n"] = np.array([100, 79, 100])
    assert pairs() == set()


def test_the_filter_of_ids_loses_none(spark, monkeypatch):
    docs = spark.range(-3000, 3000).selectExpr("id", "'x' as text")
    ids = docs.filter("id % 7 = 0").select("id")
    want = {r.id for r in ids.collect()}
    found = {r.id for r in neardup._among(docs, ids).collect()}
    assert want <= found and len(found) < 1.1 * len(want)
    monkeypatch.setattr(neardup, "FILTER_BITS", 64)  # full: all pass
    assert want <= {r.id for r in neardup._among(docs, ids).collect()}
    assert neardup._among(docs, ids.filter("false")).collect() == []


def test_links_inside_a_block():
    draw = np.random.default_rng(3)
    base = np.arange(100, dtype=np.uint64)
    sets = [np.unique(np.concatenate([np.delete(base, draw.integers(0, 100, draw.integers(0, 16))), draw.integers(1000, 10**6, 3).astype(np.uint64)])) for _ in range(60)]
    ids = np.arange(60)
    links = list(neardup._links_inside(ids, ids.copy(), np.ones(60, bool), sets, 80))
    alike = lambda x, y: 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y))
    assert all(alike(sets[a], sets[b]) for a, b in links)

    def groups(pairs):
        root = list(range(60))
        for a, b in pairs:
            a, b = root[a], root[b]
            root = [min(a, b) if r in (a, b) else r for r in root]
        return root

    assert groups(links) == groups([(a, b) for a in range(60) for b in range(a) if alike(sets[a], sets[b])])


def test_dedup_edge_cases(spark):
    docs = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (6, "one two"), (None, "one two"), (7, "x " * 30000)]
    rows = neardup.components(frame(spark, docs), k=2).collect()
    found = {(r.id, r.n): r.component_id for r in rows}
    assert len(rows) == len(docs)
    assert found == {(1, 0): 1, (2, 0): 2, (3, 0): 3, (4, 1): 4, (5, 1): 4, (6, 1): 6, (None, 1): None, (7, 1): 7}
    empty = frame(spark, docs).filter("false")
    assert neardup.components(empty).collect() == []
    kept = neardup.keep_one(frame(spark, docs))
    assert kept.columns == frame(spark, docs).columns
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == [1, 2, 3, 4, 6, 6, 7]


@pytest.mark.parametrize("parts", [1, 3, 4])
def test_every_text_of_an_id_links(spark, parts):
    """The same groups in whatever order the rows of a repeated id come."""
    one, two = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    docs = [(5, one), (5, two), (7, one + " x"), (9, two + " y"), (11, "far from these"), (5, one), (3, "far away " * 9), (11, "far away " * 8 + "far off")]
    for rows in (docs, docs[::-1], sorted(docs, key=repr)):
        made = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts).withColumn("a.b", F.lit(1))
        found = {(r.id, r.component_id) for r in neardup.components(made).collect()}
        assert found == {(5, 5), (7, 5), (9, 5), (11, 11), (3, 3)}
        kept = neardup.keep_one(made)
        assert kept.columns == made.columns and sorted(r.doc_id for r in kept.collect()) == [3, 5, 5, 5, 11, 11]


@pytest.mark.parametrize("length", [1, 5, 13, 50])
def test_repeats_match_brute_force(spark, length):
    docs = corpus(length)
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.digest(frame(spark, docs), length).collect()}
    assert found == repeats(docs, length)


def test_cut_texts_keeps_bytes_and_columns(spark):
    shared = " ".join(f"p{k}" for k in range(60))
    docs = [(1, f"a  b {shared} c"), (2, f"\tx\n{shared}  y z"), (3, None), (4, ""), (5, f"{shared} {shared}")]
    out = substrings.cut_texts(frame(spark, docs), 50)
    rows = {r.doc_id: r for r in out.collect()}
    assert out.columns == frame(spark, docs).columns
    assert rows[1].text == docs[0][1] and rows[2].text == "\tx\ny z" and rows[3].text is None and rows[4].text == "" and rows[5].text == ""
    assert rows[2].n_chars == len("\tx\ny z") and rows[3].n_chars is None and rows[1].n_chars == len(docs[0][1])


def test_repeats_edge_cases(spark):
    text = " ".join(map(str, range(20)))
    docs = [(None, text), (2, text), (2, text), (3, "x " * 100000)]
    rows = substrings.digest(frame(spark, docs), 13).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in rows) == [(0, 20), (2, 0), (2, 0), (3, 0)]
    assert substrings.digest(frame(spark, docs).filter("false"), 13).collect() == []
    assert next(r for r in rows if r.doc_id == 2).kept_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert substrings.levels(13) == [7, 13] and substrings.levels(50) == [7, 13, 25, 50]


def test_find_tells_keys_apart_that_share_a_word():
    table = np.array([[1, 5], [1, 9], [4, 0]], dtype=np.uint64)
    keys = np.array([[1, 9], [1, 7], [4, 0], [5, 5], [1, 5]], dtype=np.uint64)
    assert ledger.find(table, keys).tolist() == [1, -1, 2, -1, 0]
