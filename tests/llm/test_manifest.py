import hashlib
import random
import zlib

import compare
import pytest
from pyspark.sql import functions as F
from quillforge.llm import manifest
from quillforge.llm.queries import ORACLES, QUERIES


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][k : k + 2]) for k in range(0, len(out[-1]), 2)])
    return out


def brute(rows):
    """{(id, leaf): (subroot, root, digest of siblings, folded, verified)} of rows in the order of FIELDS."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels_of([leaf_of(r) for r in sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))]) for g in groups}
    top = levels_of([trees[g][-1][0] for g in order])
    out = {}
    for place, g in enumerate(order):
        for k, row in enumerate(sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))):
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None
            node, met = leaf_of((*row[:3], row[3] + 1, row[4])) if hit else leaf_of(row), []
            for tree, at in ((trees[g], k), (top, place)):
                for level in tree[:-1]:
                    other = level[at ^ 1] if at ^ 1 < len(level) else None
                    met += [other] if other else []
                    node = sha(node) if other is None else sha(other, node) if at & 1 else sha(node, other)
                    at >>= 1
            out[row[0], trees[g][0][k]] = (trees[g][-1][0], top[-1][0], sha(*met), node, node == top[-1][0])
    return out


def found(spark, rows, bits=10, extra=""):
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    if extra:
        frame = frame.withColumns({c: F.lit(1) for c in ("digest", "rank", "tree", "a.b", "n", "path")})
    return {(r.doc_id, r.leaf): (r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in manifest.tampered(frame, bits).collect()}


@pytest.mark.parametrize("bits", [1, 3, None])
def test_documents_match_the_sql(spark, sf_dir, bits):
    """The same rows whatever a block holds; None: the query itself."""
    found = manifest.tampered(spark.read.parquet(f"{sf_dir}/documents.parquet"), bits) if bits else QUERIES["op12_manifest"](spark, sf_dir)
    rows = compare.rows_of_frame(found)
    assert rows == compare.rows_of_sql(compare.connect(sf_dir), ORACLES["op12_manifest"])
    assert {r[-1] for r in rows[1]} == {True, False}


@pytest.mark.parametrize("bits", [2, 10])
def test_nulls_empties_long_texts_and_repeats(spark, bits):
    draw = random.Random(6)
    rows = [(k, draw.choice(["web", None, ""]), draw.choice(["en", "en", "en", None, "", "é", "z", "zz"]), draw.choice([k, None]), draw.choice(["", None, "text é"])) for k in range(150)]
    rows += [(5, "a", "en", 1, "one"), (5, "a", "en", 1, "two"), (None, "a", "en", 3, "no id"), (None, None, None, None, None), (2**60, "b", "long", 2_000_000, "ab " * 700_000)]
    assert found(spark, rows, bits, "clashing names") == brute(rows)


@pytest.mark.parametrize("rows", [[], [(7, "s", "en", 4, "text")], [(k, "s", x, 1, "t") for k, x in enumerate(["b", None, "a"])], [(k, "s", None, 1, "t") for k in range(5)], [(3, "s", "en", 1, "same")] * 4 + [(4, "s", "de", 1, "other")]])
def test_small_tables(spark, rows):
    got = found(spark, rows)
    if len(set(rows)) == len(rows):
        assert got == brute(rows)
    else:  # equal rows have equal leaves, and proofs of their own
        assert {k[1] for k in got} == {leaf_of(r) for r in rows}


def test_a_changed_row_is_found_and_paths_fold(spark):
    nodes = [sha(str(k)) for k in range(11)]
    paths = [[] for _ in nodes]
    root = manifest.visit(nodes, 4, paths)
    assert root == levels_of(nodes)[-1][0]
    assert {manifest.fold(x, "".join(p)) for x, p in zip(nodes, paths, strict=True)} == {root}
    assert manifest.fold(sha("other"), "".join(paths[10])) != root
    assert len(manifest.siblings("".join(paths[10]))) == 2
