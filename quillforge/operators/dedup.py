"""Near-duplicate chunks: MinHash signatures, banding, verification and clusters.

Signatures use h_i(x) = (a_i x + b_i) mod p on 60-bit MD5 prefixes reduced mod p = 2^31 - 1, which is
exact in 64-bit integers and gives the same numbers in other SQL engines. A unit without shingles
has a signature of p everywhere, so such units are alike. A unit is one row, so its minima are taken
where it lies, over arrays of a batch; nothing is exploded or shuffled for them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillforge.functions.text import normalize_code, shingles, tokens
from quillforge.operators.components import connected_components
from quillforge.sources.scratch import materialise

PRIME = (1 << 31) - 1
#: Characters of text whose shingles are hashed at once.
HASHED = 1 << 20


def coefficients(n: int) -> list[tuple[int, int]]:
    """A fixed rule: powers of a primitive root of the prime."""
    return [(pow(7, 5 * k + 1, PRIME), pow(7, 5 * k + 3, PRIME)) for k in range(n)]


def shingle_rows(units: DataFrame, unit: str, text: str, k: int = 3) -> DataFrame:
    """(unit, shingle) distinct."""
    return _tokens(units, unit, text).select(unit, F.explode(F.array_distinct(shingles(F.col("_t"), k))).alias("shingle"))


def shingle_sets(units: DataFrame, unit: str, text: str, k: int = 3) -> DataFrame:
    """(unit, s): the distinct shingles of each row as an array."""
    return _tokens(units, unit, text).select(unit, F.array_distinct(shingles(F.col("_t"), k)).alias("s"))


def _tokens(units: DataFrame, unit: str, text: str) -> DataFrame:
    """Tokens as a column of their own: a lambda would work out an expression again for every window."""
    return units.select(unit, tokens(normalize_code(F.col(text))).alias("_t"))


def _hashed(text: str | None, k: int) -> np.ndarray:
    """Distinct shingles of a normalised text as numbers below the prime."""
    words = text.split(" ") if text else []
    if k <= 0 or len(words) < k:
        return np.zeros(0, np.int64)
    made = {" ".join(words[i : i + k]) for i in range(len(words) - k + 1)}
    first = b"".join(hashlib.md5(m.encode(), usedforsecurity=False).digest()[:8] for m in made)
    return (np.frombuffer(first, ">u8") >> np.uint64(4)).astype(np.int64) % PRIME


def _least(texts: list[str | None], k: int, hashes: int) -> np.ndarray:
    """Signatures of texts as rows."""
    out = np.full((len(texts), hashes), PRIME, dtype=np.int64)
    each = [_hashed(t, k) for t in texts]
    full = np.flatnonzero([len(x) for x in each])
    if len(full):
        flat = np.concatenate([each[d] for d in full.tolist()])
        at = np.cumsum([0, *(len(each[d]) for d in full[:-1].tolist())])
        for j, (a, b) in enumerate(coefficients(hashes)):
            out[full, j] = np.minimum.reduceat((flat * a + b) % PRIME, at)
    return out


def signatures(units: DataFrame, unit: str, text: str, k: int = 3, hashes: int = 100) -> DataFrame:
    """(unit, signature): least values over the distinct shingles of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, start = batch.column(1).to_pylist(), 0
            while start < len(texts):
                end, held = start, 0
                while end < len(texts) and (end == start or held + len(texts[end] or "") <= HASHED):
                    held += len(texts[end] or "")
                    end += 1
                least = _least(texts[start:end], k, hashes)
                offsets = pa.array(np.arange(end - start + 1) * hashes, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), pa.ListArray.from_arrays(offsets, pa.array(least.ravel()))], names=["unit", "signature"])
                start = end

    kind = units.schema[unit].dataType.simpleString()
    made = units.select(F.col(unit).alias("unit"), normalize_code(F.col(text)).alias("text")).mapInArrow(run, f"unit {kind}, signature array<bigint>")
    return made.withColumnRenamed("unit", unit)


def similarity(a: Column, b: Column) -> Column:
    """Share of equal places of two signatures; 0 if both are empty."""
    same = F.size(F.filter(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: p["x"] == p["y"]))
    return F.when(F.greatest(F.size(a), F.size(b)) == 0, F.lit(0.0)).otherwise(same / F.greatest(F.size(a), F.size(b)))


def band_rows(signed: DataFrame, unit: str, bands: int) -> DataFrame:
    """(band, key, unit); signature places that do not fill a band are not used."""
    if bands < 1:
        raise ValueError("there must be one band at least")
    each = F.floor(F.size("signature") / bands).cast("int")
    rows = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.struct(i.alias("band"), F.array_join(F.slice("signature", i * each + 1, each), ":").alias("key")))
    return signed.select(unit, F.explode(rows).alias("_b")).select(F.col("_b.band").alias("band"), F.md5("_b.key").alias("key"), unit)


def candidates(signed: DataFrame, unit: str, bands: int = 20, largest: int = 100, exact: bool = False) -> DataFrame:
    """(id1, id2) that meet in a bucket of 2 to `largest` members. The cap is the operator's own
    parameter: larger buckets are left out, which bounds a unit's partners in a band.

    With `exact` there is no cap and nothing is left out: units of an equal signature are a class, linked
    to its least unit, and only least units are paired in their buckets. Copies cost one row each; pairs
    of a bucket's distinct signatures are all made."""
    links, kept = None, signed
    if exact:
        first = signed.groupBy("signature").agg(F.min(unit).alias("_first"))
        links = signed.join(first, "signature").filter(F.col("_first") < F.col(unit)).select(F.col("_first").alias("id1"), F.col(unit).alias("id2"))
        kept = first.select(F.col("_first").alias(unit), "signature")
    rows = band_rows(kept, unit, bands)
    sizes = rows.groupBy("band", "key").agg(F.count("*").alias("_n")).filter((F.col("_n") > 1) & (F.lit(exact) | (F.col("_n") <= largest)))
    fit = rows.join(sizes.select("band", "key"), ["band", "key"], "left_semi")
    left, right = fit.withColumnRenamed(unit, "id1"), fit.withColumnRenamed(unit, "id2")
    pairs = left.join(right, ["band", "key"]).filter("id1 < id2").select("id1", "id2")
    return (pairs if links is None else pairs.unionByName(links)).distinct()


#: Members of a bucket that are compared at once.
BLOCK = 1024


class _Members:
    """Some members of one bucket, and how alike they are."""

    def __init__(self, table: pa.Table, least: float):
        self.units, self.least = table.column("unit").to_pylist(), least
        self.sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.int32).reshape(len(self.units), -1)
        self.home = table.column("home").to_numpy(zero_copy_only=False)
        self.comp = np.unique(np.array(table.column("comp").to_pylist(), dtype=object).astype(str), return_inverse=True)[1]

    def alike(self, one: int, others: np.ndarray) -> np.ndarray:
        return others[(self.sig[others] == self.sig[one]).sum(axis=1) / max(1, self.sig.shape[1]) >= self.least]

    def stars(self) -> Iterator[tuple[int, int]]:
        """Links that connect whatever is alike here: members to a leader, then groups of leaders to each other."""
        left, group = np.arange(len(self.units)), np.arange(len(self.units))
        while len(left) > 1:
            hit = self.alike(left[0], left[1:])
            group[hit] = left[0]
            yield from ((int(left[0]), int(x)) for x in hit)
            left = left[1:][~np.isin(left[1:], hit)]
        self.comp = group
        yield from self.across()

    def across(self) -> Iterator[tuple[int, int]]:
        """From each member outside the largest group, one link to every other group that it is alike to."""
        largest = np.argmax(np.bincount(self.comp))
        for y in np.flatnonzero(self.comp != largest).tolist():
            hit = self.alike(y, np.flatnonzero((self.comp != self.comp[y]) & (self.home | self.home[y])))
            yield from ((y, int(hit[k])) for k in np.unique(self.comp[hit], return_index=True)[1])

    def pairs(self, bands: int, band: int) -> Iterator[tuple[int, int, float]]:
        """Pairs inside a block (all at home) or across two, in the first of their common bands only."""
        each = self.sig.shape[1] // bands
        head = self.sig[:, : each * bands].reshape(len(self.units), bands, each)
        for y in range(1, len(self.units)):
            other = np.arange(y) if self.home.all() else np.flatnonzero(self.comp[:y] != self.comp[y])
            equal = (self.sig[other] == self.sig[y]).sum(axis=1) / max(1, self.sig.shape[1])
            fit = equal >= self.least
            first = (head[other[fit]] == head[y]).all(axis=2).argmax(axis=1)
            yield from ((int(x), y, float(v)) for x, v, b in zip(other[fit], equal[fit], first, strict=True) if b == band)


def _classes(signed: DataFrame, unit: str) -> tuple[DataFrame, DataFrame]:
    """Units of an equal signature as their least unit (unit, signature), and links from it to the others."""
    first = signed.groupBy("signature").agg(F.min(unit).alias("unit"))
    copies = signed.select(F.col(unit).alias("_u"), "signature").join(first, "signature").filter(F.col("unit") < F.col("_u"))
    return first.select("unit", "signature"), copies.select(F.col("unit").alias("id1"), F.col("_u").alias("id2"))


def _posted(classes: DataFrame, bands: int) -> DataFrame:
    """(band, key, unit, sig, blocks) of buckets of two and more; sig is the signature in 32 bits a place."""
    rows = band_rows(classes, "unit", bands)
    sizes = rows.groupBy("band", "key").agg(F.count("*").alias("_n")).filter("_n > 1").select("band", "key", F.ceil(F.col("_n") / BLOCK).cast("int").alias("blocks"))
    fit = rows.join(sizes, ["band", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = [np.array(x, np.int64).astype(np.int32).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigs, pa.binary())], names=["unit", "sig"])

    packed = classes.select("unit", "signature").mapInArrow(run, f"unit {classes.schema['unit'].dataType.simpleString()}, sig binary")
    return fit.join(packed, "unit").select("band", "key", "unit", "sig", "blocks")


def _met(rows: DataFrame, find: Callable[[_Members, int], Iterator[tuple]], least: float, kind: str) -> DataFrame:
    """(id1, id2, similarity) found in each (band, key, salt); rows has (band, key, salt, unit, sig, home, comp)."""
    schema = pa.schema([("id1", rows_type(kind)), ("id2", rows_type(kind)), ("similarity", pa.float64())])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("unit")
        held = _Members(table, least)
        found = [(*sorted((held.units[f[0]], held.units[f[1]])), f[2] if len(f) > 2 else None) for f in find(held, key[0].as_py())]
        return pa.table([list(c) for c in zip(*found, strict=True)] if found else [[], [], []], schema=schema)

    return rows.groupBy("band", "key", "salt").applyInArrow(run, f"id1 {kind}, id2 {kind}, similarity double")


def rows_type(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def alike_pairs(signed: DataFrame, unit: str, bands: int = 20, least: float = 0.8) -> DataFrame:
    """(id1, id2, similarity): the pairs of distinct signatures that share a band and are `least` alike, and each
    copy of a signature with its first unit. Pairs are tested where a bucket's members lie and leave the task
    only if they are alike, once for all bands; a large bucket is dealt into blocks that meet two by two."""
    kind = signed.schema[unit].dataType.simpleString()
    classes, copies = _classes(signed, unit)
    posted = _posted(classes, bands)
    own = F.pmod(F.xxhash64("unit", "key"), F.col("blocks")).cast("int")
    dealt = posted.withColumn("_own", own).withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # a pair of blocks is one task
    met = dealt.withColumns({"_low": F.least("_own", "_with"), "_high": F.greatest("_own", "_with")})
    rows = met.withColumns({"salt": F.col("_low") * F.col("blocks") + F.col("_high"), "home": F.col("_low") == F.col("_high"), "comp": F.col("_own")})
    found = _met(rows.select("band", "key", "unit", "sig", "salt", "home", "comp"), lambda held, band: held.pairs(bands, band), least, kind)
    return found.unionByName(copies.withColumn("similarity", F.lit(1.0)))


def alike_links(signed: DataFrame, unit: str, bands: int = 20, least: float = 0.8) -> DataFrame:
    """(id1, id2): links that join the same clusters as `alike_pairs`, about one for each unit and bucket.

    (1) In each block of a bucket members are linked to a leader, and leaders' groups to each other. (2) Of a
    bucket of several blocks, one member of each component so far meets the others'. (3) What is outside a
    bucket's largest component by then visits all its blocks. Near copies by the thousand are one component after
    (2); only buckets of many unlike members cost more."""
    kind = signed.schema[unit].dataType.simpleString()
    classes, copies = _classes(signed, unit)
    posted = materialise(_posted(classes, bands), "posted")
    own = F.pmod(F.xxhash64("unit", "key"), F.col("blocks")).cast("int")
    rows = posted.withColumns({"salt": own, "home": F.lit(True), "comp": F.col("unit")})
    member = ["band", "key", "unit", "sig", "salt", "home", "comp"]
    links = materialise(_met(rows.select(member), lambda held, _: held.stars(), least, kind).select("id1", "id2").distinct(), "links")
    large = rows.filter("blocks > 1").drop("comp")
    if not large.isEmpty():
        for several in (True, False):
            known = connected_components(links, "id1", "id2").select(F.col("id").alias("unit"), "component")
            placed = materialise(large.join(known, "unit", "left").withColumn("comp", F.coalesce("component", "unit")).drop("component"), "placed")
            if several:
                one = placed.groupBy("band", "key", "comp").agg(F.min(F.struct("unit", "sig")).alias("x"), F.max("blocks").alias("blocks")).select("band", "key", "comp", "x.unit", "x.sig", "blocks")
                # dealt by component into no more blocks than before, and fewer where components are few
                count = one.groupBy("band", "key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_few"))
                meet = one.join(count, ["band", "key"]).withColumns({"salt": F.pmod(F.xxhash64("unit", F.lit(3)), F.col("_few")).cast("int"), "home": F.lit(True)})
                more = _met(meet.select(member), lambda held, _: held.stars(), least, kind)
            else:
                sizes = placed.groupBy("band", "key", "comp").agg(F.count("*").alias("c")).groupBy("band", "key").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("several")).filter("several > 1")
                visits = F.when(F.col("comp") == F.col("main"), F.array("salt")).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
                spread = placed.join(sizes, ["band", "key"]).withColumnRenamed("salt", "_own").withColumn("salt", F.col("_own")).withColumn("salt", F.explode(visits)).withColumn("home", F.col("salt") == F.col("_own"))
                more = _met(spread.select(member), lambda held, _: held.across(), least, kind)
            links = materialise(links.unionByName(more.select("id1", "id2")).distinct(), "links")
    return links.unionByName(copies)


def verified(pairs: DataFrame, signed: DataFrame, unit: str, least: float) -> DataFrame:
    """(id1, id2, similarity) of pairs at least that alike."""
    one = signed.select(F.col(unit).alias("id1"), F.col("signature").alias("s1"))
    two = signed.select(F.col(unit).alias("id2"), F.col("signature").alias("s2"))
    return pairs.join(one, "id1").join(two, "id2").select("id1", "id2", similarity(F.col("s1"), F.col("s2")).alias("similarity")).filter(F.col("similarity") >= least)


def touching(pairs: DataFrame, units: DataFrame, unit: str, files: DataFrame, file: str = "path") -> DataFrame:
    """Pairs of which either side lies in one of the files; all pairs where there is none."""
    if files.isEmpty():
        return pairs
    inside = units.join(files.select(F.col(files.columns[0]).alias(file)).distinct(), file, "left_semi").select(F.col(unit).alias("_u"))
    hit = pairs.select("id1", "id2", F.explode(F.array("id1", "id2")).alias("_u")).join(inside, "_u", "left_semi").select("id1", "id2").distinct()
    return pairs.join(hit, ["id1", "id2"], "left_semi").select(*pairs.columns)


def drop_nested(pairs: DataFrame, units: DataFrame, unit: str, file: str = "path", start: str = "start_line", end: str = "end_line") -> DataFrame:
    """Without pairs of one file whose line ranges contain one another."""
    one = units.select(F.col(unit).alias("id1"), F.col(file).alias("_f1"), F.col(start).alias("_a1"), F.col(end).alias("_b1"))
    two = units.select(F.col(unit).alias("id2"), F.col(file).alias("_f2"), F.col(start).alias("_a2"), F.col(end).alias("_b2"))
    inside = (F.col("_f1") == F.col("_f2")) & (((F.col("_a1") <= F.col("_a2")) & (F.col("_b2") <= F.col("_b1"))) | ((F.col("_a2") <= F.col("_a1")) & (F.col("_b1") <= F.col("_b2"))))
    return pairs.join(one, "id1").join(two, "id2").filter(~inside).select(*pairs.columns)


def clusters(pairs: DataFrame) -> DataFrame:
    """(id, cluster_id): groups linked by pairs; the id is the smallest member's."""
    return connected_components(pairs, "id1", "id2").select("id", F.col("component").alias("cluster_id"))


def cluster_summary(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster_id, size, avg_similarity): the mean goes over the pairs that were found."""
    size = members.groupBy("cluster_id").agg(F.count("*").alias("size"))
    mean = pairs.join(members.withColumnRenamed("id", "id1"), "id1").groupBy("cluster_id").agg(F.avg("similarity").alias("avg_similarity"))
    return size.join(mean, "cluster_id")
