"""Results kept part by part, rows told apart, distributions that merge, and digests."""

import random

import pytest
from pyspark.sql import functions as F
from quillforge.functions import text as T
from quillforge.operators import profile, resolve
from quillforge.plans import parts
from quillforge.sources import rejects


def totals(rows):
    return rows.groupBy(F.col("src").alias("part")).agg(F.count("*").alias("n"), F.sum("x").alias("x"))


def test_only_changed_parts_are_made_again(spark, tmp_path):
    folder = str(tmp_path / "kept")
    rows = [(s, k) for s in ("a", "b", "c", None) for k in range(10)]
    schema = "src string, x long"

    def refresh(data, version="1"):
        seen = []

        def make(rows):
            seen.append(rows.count())
            return totals(rows)

        found, again = parts.refreshed(folder, spark.createDataFrame(data, schema), "src", make, version)
        return {r.part: (r.n, r.x) for r in found.collect()}, {r.part for r in again.collect()}, seen[0]

    want = lambda data: {s: (len(v), sum(v)) for s in {r[0] for r in data} for v in [[x for t, x in data if t == s]]}
    assert refresh(rows) == (want(rows), {"a", "b", "c", None}, 40)
    assert refresh(rows[::-1]) == (want(rows), set(), 0)  # order tells nothing
    changed = [(s, x + (s == "b")) for s, x in rows] + [(None, 5)]
    assert refresh(changed) == (want(changed), {"b", None}, 21)
    fewer = [r for r in changed if r[0] != "a"]
    assert refresh(fewer) == (want(fewer), set(), 0)
    assert refresh(changed) == (want(changed), {"a"}, 10)
    assert refresh(changed, "2") == (want(changed), {"a", "b", "c", None}, 41)
    runs = [p.name for p in (tmp_path / "kept").iterdir()]
    assert sorted(n.split("-")[0] for n in runs) == ["manifest", "run"]
    assert refresh([]) == ({}, set(), 0)


def test_a_second_writer_of_a_manifest_fails(spark, tmp_path):
    folder = parts.Folder(spark, str(tmp_path / "kept"))
    manifest = spark.createDataFrame([("a", "1", "run-0")], "part string, fingerprint string, run string")
    folder.commit(manifest, 1)
    with pytest.raises(RuntimeError, match="another writer"):
        folder.commit(manifest, 1)
    assert folder.names() == ["manifest-1"]


def test_rows_are_told_apart_and_counted(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (-3, "b"), (-4, None), (None, "c")], "n int, t string")
    found = rejects.told_apart(rows, {"negative": F.col("n") >= 0, "no text": F.col("t").isNotNull()})
    assert [tuple(r) for r in found.good.collect()] == [(1, "a")]
    assert {tuple(r) for r in found.rejects.collect()} == {(2, None, "no text"), (-3, "b", "negative"), (-4, None, "negative"), (None, "c", "negative")}
    assert found.counts == {"good": 1, "negative": 3, "no text": 1}
    nothing = rejects.told_apart(rows.filter("false"), {"negative": F.col("n") >= 0})
    assert nothing.good.collect() == [] and nothing.rejects.collect() == [] and nothing.counts == {"good": 0, "negative": 0}


def test_merged_distributions_give_the_percentiles_of_the_whole(spark):
    draw = random.Random(7)
    rows = [(draw.choice("ab"), draw.choice("xyz"), draw.randrange(30)) for _ in range(500)]
    long = spark.createDataFrame(rows, "metric string, part string, value long")
    kept = profile.counts(long, ["part", "metric"])
    got = profile.percentiles_of_counts(profile.merged(kept, ["metric"]), ["metric"]).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, profile.percentiles(long, ["metric"]).collect()))


# Published test vectors of FNV-1a in 64 bits.
@pytest.mark.parametrize("text,want", [("", "cbf29ce484222325"), ("a", "af63dc4c8601ec8c"), ("foobar", "85944171f73967e8")])
def test_fnv(spark, text, want):
    assert spark.createDataFrame([(text,)], ["t"]).select(T.fnv1a64(F.col("t"))).first()[0] == want


def test_fnv_of_any_text(spark):
    def slow(text):
        h = 0xCBF29CE484222325
        for b in text.encode():
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
        return f"{h:016x}"

    texts = ["é" * 50, "x" * 3000, "\x00\x01", "naïve ’quotes’"]
    got = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", T.fnv1a64(F.col("t")).alias("h")).collect()
    assert {r.t: r.h for r in got} == {t: slow(t) for t in texts} | {None: None}


def test_uses_go_to_one_definition(spark):
    defs = spark.createDataFrame([("f1", "run"), ("f2", "run"), ("f3", "run"), ("f1", "lone"), ("f2", "won"), ("f3", "won")], "file string, name string")
    ident = spark.createDataFrame([("f1", "one"), ("f2", "two"), ("f3", "three")], "file string, ident string")
    uses = spark.createDataFrame([("t", "a", r) for r in ("run", "three", "lone")] + [("t", "b", r) for r in ("run", "won", "else")] + [("t", "c", r) for r in ("run", "run", "two", "three")], "test_file string, test_id string, ref string")
    won = spark.createDataFrame([("won", "f3")], "name string, file string")
    found = {(r.test_id, r.name): (r.file, r.evidence) for r in resolve.resolved_uses(defs, uses, ident, won).collect()}
    assert found == {("a", "run"): ("f3", 2), ("a", "lone"): ("f1", 1), ("b", "run"): ("f1", 0), ("b", "won"): ("f3", 1), ("c", "run"): ("f2", 2)}
