import hashlib
import importlib
import itertools
import math
import os
import random
import struct
import zlib

import compare
import numpy as np
import public_tokenizers
import pytest
import tokenizers
from brute import base_secrets, near_duplicates, repeats, word_scores
from pyspark.sql import functions as F
from quillforge.llm import lattice, pieces, search
from quillforge.llm.queries import ORACLES, QUERIES


def brute_top(vectors, k):
    found = set()
    for q, v in vectors:
        if q % 20 == 0:
            scores = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in vectors if i != q and len(w) == len(v)))
            found |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])}
    return found


@pytest.mark.parametrize("shard_rows", [40, 8192])
def test_top_k_matches_brute_force(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(search, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(search, "LEAF", 8)
    draw = random.Random(3)
    rows = [(d, [draw.choice([-0.5, 0.0, 0.25, 1.0, draw.random()]) for _ in range(5)]) for d in range(200)]
    rows += [(400, [0.1] * 5), (420, [0.1] * 5), (440, [1.0, 2.0]), (460, [1.0, 3.0])]
    bad = [(500, None), (520, []), (540, [1.0, None, 1.0, 1.0, 1.0]), (560, [1.0, math.nan, 1.0, 1.0, 1.0]), (580, [math.inf] * 5)]
    frame = spark.createDataFrame([(d, v, 1, "x") for d, v in rows + bad], "vec_id long, embedding array<float>, label int, shard string").repartition(3)
    as_float = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    whole = [(d, [math.floor(64 * as_float(x)) for x in v]) for d, v in rows]
    found = search.top_k(frame, F.col("vec_id") % 20 == 0)
    assert {tuple(r) for r in found.collect()} == brute_top(whole, 20)
    assert search.top_k(frame.filter("false"), F.col("vec_id") % 20 == 0).collect() == []


@pytest.mark.parametrize("shard_rows", [10, 8192])
def test_repeated_ids_and_hot_vectors(spark, monkeypatch, shard_rows):
    """One shard or many, the same answers: an id asks once, with its shortest and then least vector."""
    monkeypatch.setattr(search, "SHARD_ROWS", shard_rows)
    draw = random.Random(8)
    rows = [(d, [float(draw.randrange(-9, 9)) for _ in range(3)]) for d in range(1, 60)]
    rows += [(d, [1.0, 2.0, 3.0]) for d in range(100, 180)]  # many copies of one vector
    rows += [(20, [5.0, 1.0, 0.0]), (20, [-9.0, 0.5, 2.0]), (20, [1.0, 1.0]), (30, [2.0, 2.0, 2.0]), (7, [1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    scaled = [(d, [math.floor(64 * x) for x in v]) for d, v in rows]
    want = set()
    for q in {d for d, _ in rows if d % 20 == 0}:
        v = min((w for d, w in scaled if d == q), key=lambda w: (len(w), w))
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), d) for d, w in scaled if d != q and len(w) == len(v))
        want |= {(q, r + 1, d, -s) for r, (s, d) in enumerate(scores[:20])}
    assert {tuple(r) for r in search.top_k(frame, F.col("vec_id") % 20 == 0).collect()} == want


def test_cells_deal_copies_and_strangers():
    draw = np.random.default_rng(5)
    rows = draw.integers(-5, 5, (500, 4)).astype(float)
    cells = search.Cells(rows, 16)
    assert cells.count == 16 and np.bincount(cells.of(rows)).max() < 80
    assert search.Cells(np.ones((9, 3)), 8).count == 1
    assert set(search.Cells(np.array([[1.0], [1.0], [1.0], [2.0]]), 4).of(np.array([[1.0], [2.0], [9.0]])).tolist()) == {0, 1}


def test_large_components_stay_exact(spark):
    rows = [(20, [1e15, 3.0]), (21, [1e15, 1.0]), (22, [-1e15, 5.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {r.vec_id: r.score for r in search.top_k(frame, F.col("vec_id") == 20).collect()}
    assert found[21] == min(64 * 10**15 * 64 * 10**15 + 3 * 64 * 64, 2**63 - 1)


def test_bounds_hold():
    draw = np.random.default_rng(1)
    rows = draw.integers(-64, 64, (300, 6)).astype(float)
    tree = search.Tree(np.arange(300), rows, 16)
    query = draw.integers(-64, 64, (1, 6)).astype(float)
    for node, (a, b) in enumerate(tree.spans):
        assert tree.bounds(query)[node, 0] >= (tree.rows[a:b] @ query[0]).max()


def slow_marginal(word, weights):
    """Sum over all ways to cut the word into pieces."""
    text = "▁".encode() + word
    total = 0.0
    for n in range(len(text)):
        for cut in itertools.combinations(range(1, len(text)), n):
            parts = [text[a:b] for a, b in zip((0, *cut), (*cut, len(text)), strict=True)]
            if all(p in weights for p in parts):
                total += math.prod(weights[p] for p in parts)
    return total


def test_forward_recursion_and_expected_counts(monkeypatch):
    model = pieces.load(public_tokenizers.path(pieces.MODEL))
    lat = lattice.load(public_tokenizers.path(pieces.MODEL))
    log_p = lat.log_weights()
    names = {}
    for k, name in enumerate(model.names):
        if np.isfinite(log_p[k]) and lat.piece.max() >= k:
            byte = bytes([int(name[3:5], 16)]) if model.kinds[k] == 6 else name
            names.setdefault(byte, math.exp(log_p[k]))
    words = [b"the", b"a", "né".encode(), b"xq", b"hello"]
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    start = end - [len(w) for w in words]
    counts = np.array([3, 1, 2, 1, 5])
    found, expected = lat.words(data, start, end, log_p, counts)
    assert np.allclose(np.exp(found), [slow_marginal(w, names) for w in words], rtol=1e-9)
    monkeypatch.setattr(lattice, "LONG", 0)  # the same sums by the walk for long words
    again, same = lat.words(data, start, end, log_p, counts)
    assert np.allclose(again, found) and np.allclose(same, expected)
    step = 1e-6  # expected counts are the gradient in log weights
    for k in np.argsort(-expected)[:5]:
        moved = log_p.copy()
        moved[k] += step
        rise = ((lat.words(data, start, end, moved)[0] - found) * counts).sum() / step
        assert math.isclose(rise, expected[k], rel_tol=1e-3)


def test_scores_match_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = word_scores(rows)
    for r in QUERIES["op9_lattice"](spark, sf_dir).collect():
        n, known, train, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, train) and math.isclose(r.base_score, base, rel_tol=1e-9)
        assert r.score < 0


def cuts(word, names):
    """All ways to cut the bytes of a word into pieces, as lists of ids; names maps bytes to an id."""
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if (piece := names.get(word[:n])) is not None:
            for rest in cuts(word[n:], names):
                yield [piece, *rest]


def test_trained_scores_match_brute_force(spark, tmp_path):
    draw = random.Random(12)
    some = ["the", "then", "\u2581\u2581a", "é", "a", "on", "日", "Ünd", "\u2581", "x1"]
    docs = [(d, " ".join(draw.choices(some, k=draw.randrange(1, 12)))) for d in range(40)] + [(50, None), (51, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    lat, model = lattice.load(public_tokenizers.path(pieces.MODEL)), pieces.load(public_tokenizers.path(pieces.MODEL))
    names = {model.names[k]: k for k in range(len(model.names)) if model.kinds[k] == 1}
    for k, kind in enumerate(model.kinds):
        if kind == pieces.BYTE:
            names.setdefault(bytes([int(model.names[k][3:5], 16)]), k)
    lower = lambda t: (t or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()
    ways = {w: list(cuts("\u2581".encode() + w, names)) for _, t in docs for w in lower(t)}
    total = lambda w, log_p: math.log(math.fsum(math.exp(sum(log_p[p] for p in way)) for way in ways[w]))
    train = [d for d, _ in docs if zlib.crc32(str(d).encode()) % 5 != 1]
    start, expected = lat.log_weights(), np.zeros(lat.size + 1)
    for d, t in docs:
        if d in train:
            expected[-1] += 1
            for w in lower(t):
                all_of = total(w, start)
                for way in ways[w]:
                    for p in way:
                        expected[p] += math.exp(sum(start[q] for q in way) - all_of)
    with np.errstate(divide="ignore"):
        log_p = np.log((expected + lattice.PRIOR * lat.start) / (expected.sum() + lattice.PRIOR))
    least = min(model.scores[k] for k in range(len(model.names)) if model.kinds[k] == 1) - 1
    own = [least if model.kinds[k] == pieces.BYTE else model.scores[k] for k in range(len(model.names))]

    def raw(w):
        sums = [sum(own[p] for p in way) for way in ways[w]]
        return max(sums) + math.log(math.fsum(math.exp(x - max(sums)) for x in sums))

    for r in QUERIES["op9_lattice"](spark, str(tmp_path)).collect():
        text = dict(docs)[r.doc_id]
        want = sum(total(w, log_p) for w in lower(text)) + log_p[-1]
        assert math.isclose(r.score, want / math.log(10), rel_tol=1e-6) and r.held_out == (r.doc_id not in train)
        assert math.isclose(r.vocabulary_score, sum(map(raw, lower(text))) / math.log(10), rel_tol=1e-9, abs_tol=1e-9)


def test_score_edge_cases(spark):
    docs = [(1, None), (2, ""), (3, "Word word"), (3, "Word word"), (None, "x"), (5, "z" * 3000)]
    frame = spark.createDataFrame([(d, t, "k") for d, t in docs], "doc_id long, text string, score string")
    rows = lattice.score_texts(frame, F.lit(True)).collect()
    assert len(rows) == 6 and {r.train_tokens for r in rows} == {6 + 2 * 2 + 1 + 1}
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    none = lattice.score_texts(frame, F.lit(False)).collect()
    assert {r.train_tokens for r in none} == {0} and all(r.base_score == 0 for r in none)
    assert lattice.score_texts(frame.filter("false"), F.lit(True)).collect() == []


def test_oracle_of_search(spark, sf_dir):
    got = compare.rows_of_frame(QUERIES["op5_search"](spark, sf_dir))
    assert got == compare.rows_of_sql(compare.connect(sf_dir), ORACLES["op5_search"])


def rough_documents():
    """Nulls in every column, empty and very long texts, ties, repeated rows and ids, copies, secrets, shared passages."""
    draw = random.Random(21)
    words = {"en": "the cat and the dog are in the house with that thing".split(), "de": "der hund und die katze sind nicht in dem haus mit einer".split()}
    text = lambda lang, n: " ".join(draw.choice(words[lang]) + str(draw.randrange(40)) * (draw.random() < 0.5) for _ in range(n))
    passage = text("en", 70)
    rows = [(d, text(lang, draw.randrange(5, 200)), lang, "s", 1) for d, lang in enumerate(["en", "de"] * 20, 10)]
    rows += [(60, f"{text('en', 30)} {passage} {text('en', 20)}", "en", None, 1), (61, f"{text('en', 25)}\n{passage}\n{text('en', 30)}", None, "s", None)]
    rows += [(62, rows[0][1], "en", "t", 5), (63, rows[0][1].replace("the", "a", 1), "en", "t", 5), (64, rows[0][1], "de", "t", 5)]
    rows += [(70, f'{text("en", 20)} password = "q7Zk29fLx0PvB3mWn8Rt" {text("en", 9)}', "en", "s", 2), (71, text("de", 40) + " 0123456789abcdef0123 " + text("de", 9), "de", "s", 2)]
    rows += [(80, None, "en", "s", None), (81, "", "en", "s", 0), (82, "123 456 !", None, "s", 9), (83, "жзий цчшъ бвгд", None, "s", 14), (84, "the", None, None, None)]
    rows += [(90, text("en", 40000), "en", "s", 1), (None, text("de", 50), None, None, None), (91, rows[3][1] + " more", "de", "s", 1), (91, text("de", 60), "de", "s", 1)]
    return [(*r, 7, "x") for r in rows]


def test_pipeline_matches_brute_force(spark):
    """Stage by stage on rough documents; extra columns are named as the operators name theirs."""
    pipeline = importlib.import_module("corpus_pipeline")
    schema = "doc_id long, text string, lang string, source string, n_chars long, chunk int, id string"
    docs = pipeline.materialise(spark.createDataFrame(rough_documents(), schema).repartition(3), "rough")
    stages, at = dict(pipeline.STAGES), {}
    for name in list(stages)[:-1]:
        before = docs.collect()
        docs = pipeline.materialise(stages[name](spark, docs, ""), name)
        assert docs.schema == spark.createDataFrame([], schema).schema
        at[name] = (before, docs.collect())
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")
    before, after = at["language_id"]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == {80, 81, 82, 83} and len(after) == len(before) - 4
    assert {r.doc_id: r.lang for r in after if r.doc_id in (61, 84, None)} == {61: "en", 84: "en", None: "de"}
    assert [r.text for r in sorted(after, key=key)] == [r.text for r in sorted(before, key=key) if r.doc_id not in (80, 81, 82, 83)]
    before, after = at["near_dedup"]
    once = [(r.doc_id, r.text) for r in before if r.doc_id not in (None, 91)]
    want = near_duplicates(once, 5)
    assert {r.doc_id for r in after} - {None, 91} == {d for d, _ in once if want[d][1] == d} and {62, 64}.isdisjoint(r.doc_id for r in after)
    assert any(r.doc_id is None for r in after)
    before, after = at["substring_dedup"]
    cut = repeats([(math.inf if r.doc_id is None else r.doc_id, r.text) for r in before if r.doc_id != 91], 50)
    for r in after:
        if r.doc_id != 91:
            kept = " ".join(r.text.split()) if r.text.isascii() else r.text
            assert hashlib.sha256(kept.encode()).hexdigest() == cut[math.inf if r.doc_id is None else r.doc_id][2]
    assert cut[61][1] == 70 and next(r for r in after if r.doc_id == 61).n_chars == len(next(r for r in after if r.doc_id == 61).text)
    before, after = at["secret_scan"]
    texts = {key(r)[:2]: r.text for r in before}
    for r in after:
        clean = texts[key(r)[:2]] if r.doc_id != 91 else None
        assert base_secrets(r.text) == "" and (r.doc_id in (70, 71, 91) or r.text == clean)
    assert [r.text.count("[REDACTED]") for r in sorted(after, key=key) if r.doc_id in (70, 71)] == [1, 1]
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = stages["packing"](spark, docs.filter("doc_id <> 91"), "")
    want = {r.doc_id: [*library.encode(r.text, add_special_tokens=False).ids, 0] for r in docs.collect() if r.doc_id not in (None, 91)}
    got = {}
    for r in packed.collect():
        ids = want[r.doc_id]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        got.setdefault(r.doc_id, []).append((r.start, r.length))
    assert {d: sorted(p) for d, p in got.items()}.keys() == want.keys() and all(sum(n for _, n in got[d]) == len(want[d]) for d in want)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("table", ["sf0.001", "sf0.01"])
def test_op1_loses_no_link_of_the_whole_table(spark, table):
    if not os.path.isdir(f"/root/testdata/{table}"):
        pytest.skip("no such table here")
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/{table}/documents.parquet").collect()]
    want = near_duplicates(docs, 2)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op1_neardup"](spark, f"/root/testdata/{table}").collect()}
    assert found == want


def test_pipeline_keeps_columns_and_decisions(spark, sf_dir):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = pipeline.table(spark, sf_dir, "documents")
    want = near_duplicates([(r.doc_id, r.text) for r in docs.collect()], 5)
    for name, stage in pipeline.STAGES[:-1]:
        before, out = docs.count(), pipeline.materialise(stage(spark, docs, sf_dir), name)
        assert out.columns == docs.columns
        if name == "near_dedup":
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect() if want[r.doc_id][1] == r.doc_id}
        else:
            assert out.count() == before
        docs = out
    packed = pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "secret_scan", "packing"]
