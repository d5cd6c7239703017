"""Near-duplicates by an inverted join over the coordinates of MinHash signatures.

A text's set is its distinct shingles of k words; a signature holds the least value of each of
COORDINATES hash functions over the set. Documents with equal sets form a class and go on as one. Every (coordinate, value) pair is a token and a class is posted under its tokens; two
classes whose sets are alike to `percent` share at least MATCH tokens but for about four pairs in
10^6 at the bound itself (the binomial tail of 64 at 0.8), fewer above it.

Prefix: with all tokens ordered from rare to frequent, two classes that share MATCH tokens meet in
the first COORDINATES - MATCH + 1 of each. Skip: tokens of one class alone are not posted, and a
class with fewer than MATCH shared tokens is skipped altogether. Lists are merged where they meet:
collisions over the whole signature are counted for a list's members against a few leaders, never
for all pairs; pairs with MATCH and more are kept and confirmed on the full sets.

All links are found without all pairs of a group. (1) The members of a list are matched with a few
leaders, and each group of a leader with the other groups, one match for each member and group; so
whatever matches is connected, and what matches connect is a family. (2) Matches are confirmed,
which makes the components so far. (3) A link that is still missing lies inside a family, between
components: the full sets are intersected in the task that holds them, and only links that join
components leave it. Lists and families over LIST members, and families over SET_ROWS shingles, are dealt
into blocks; members outside the largest component visit every block, so that every pair across
components still meets. (A family of many texts of which few are linked costs the square of its blocks.)

Cases: null text, empty text or text without words has an empty set, linked with nothing; fewer
than k words make one shingle of them all; a null id links with nothing and is kept; rows that
repeat an id are one document, which every one of its texts links (so all its rows have one component,
in whatever order they come); of documents alike the smallest id names the component, and there are no
other ties; very long texts are taken whole; an empty table gives no rows; extra columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillforge.llm import ledger
from quillforge.llm.common import Words, materialise, mix, parallelism, slices, strings, table, windows
from quillforge.operators.components import connected_components

COORDINATES, MATCH = 64, 36
PREFIX = COORDINATES - MATCH + 1
#: Members of a list or family that are compared at once.
LIST = 2048
POSTINGS_A_BUCKET = 20_000
#: Shingles of a block of a family.
SET_ROWS = 4 << 20
#: Bits of the filter of family members that is sent to the tasks: 4 MB, whatever their number.
FILTER_BITS, BITMAP = 1 << 25, 32768
#: Parts into which the rows of each group are dealt where they meet a small table of groups.
SALTS = 16

_draw = np.random.default_rng(20240229)
_TIMES = _draw.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _draw.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingle_sets(texts: pa.Array, k: int, lower: bool = True) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    words = Words(texts, lower)
    h, whole = words.hash, windows(words.hash, k)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(whole[a : b - k + 1]))
        else:
            out.append(windows(h[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def set_hash(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Rows of COORDINATES least values; empty sets have zeros."""
    sizes = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), COORDINATES), dtype=np.uint32)
    full = np.flatnonzero(sizes)
    if len(full):
        flat = np.concatenate([sets[d] for d in full.tolist()])
        at = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        for j in range(COORDINATES):
            v = (flat ^ (flat >> np.uint64(29))) * _TIMES[j] + _PLUS[j]
            out[full, j] = np.minimum.reduceat((v >> np.uint64(32)).astype(np.uint32), at)
    return out


def sketches(docs: DataFrame, k: int, lower: bool, id_col: str, text_col: str) -> DataFrame:
    """(id, n, set_hash, sig) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(strings(batch.column(1)), k, lower)
            sig = signatures(sets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(map(set_hash, sets), pa.binary()), pa.array([s.tobytes() for s in sig], pa.binary())],
                names=["id", "n", "set_hash", "sig"],
            )

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "id long, n long, set_hash binary, sig binary")


def _matrix(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(-1, COORDINATES)


def _tokens(sig: np.ndarray) -> np.ndarray:
    return mix((np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)) | sig.astype(np.uint64))


def postings(classes: DataFrame) -> DataFrame:
    """(token, df, id, n, sig) for the prefix tokens that other classes share; sig in 16 bits a coordinate."""
    spark = classes.sparkSession
    rows = classes.count()
    chunks = ledger.chunk_count(rows * COORDINATES * 4, rows, parallelism(spark))
    buckets = max(parallelism(spark), chunks)
    dealt = classes.withColumn("chunk", ledger.chunk_of(chunks, "id"))

    def post(key: tuple, rows: pa.Table) -> pa.Table:
        tokens = _tokens(_matrix(rows.column("sig"), np.uint32)).ravel()
        return ledger.posts(key[0].as_py(), *ledger.combine(tokens, np.ones(len(tokens), np.int64), ledger.add), buckets)

    shared = ledger.replies(dealt.groupBy("chunk").applyInArrow(post, ledger.POST), ledger.add, lambda whole, own, mark: whole > 1)

    def prefix(key: tuple, rows: pa.Table, reply: pa.Table) -> pa.Table:
        keys, counts = ledger.sorted_reply(reply)
        sig = _matrix(rows.column("sig"), np.uint32)
        tokens = _tokens(sig)
        at = ledger.find(keys, tokens.ravel()).reshape(tokens.shape)
        df = np.where(at >= 0, counts[at], 1) if len(counts) else np.ones(tokens.shape, np.int64)
        df[(df > 1).sum(axis=1) < MATCH] = 1  # cannot match anything
        first = np.lexsort((tokens, df))[:, :PREFIX]
        row, col = np.nonzero(np.take_along_axis(df, first, axis=1) > 1)
        col = first[row, col]
        short = [s.tobytes() for s in sig.astype(np.uint16)]
        mine = lambda c: pa.array(rows.column(c).to_numpy()[row])
        return pa.table([pa.array(tokens[row, col].view(np.int64)), pa.array(df[row, col]), mine("id"), mine("n"), pa.array([short[r] for r in row.tolist()], pa.binary())], names=["token", "df", "id", "n", "sig"])

    return dealt.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(prefix, "token long, df long, id long, n long, sig binary")


class List:
    """Members of one posting list, or of one block of it."""

    def __init__(self, rows: dict[str, np.ndarray], part: np.ndarray, percent: int):
        self.ids, self.sig, self.n, self.comp, self.home = (rows[c][part] for c in ("id", "sig", "n", "comp", "home"))
        self.percent = percent

    def alike(self, one: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the others, those that match enough and whose sizes allow the similarity; with their matches."""
        others = others[100 * np.minimum(self.n[others], self.n[one]) >= self.percent * np.maximum(self.n[others], self.n[one])]
        n = (self.sig[others] == self.sig[one]).sum(axis=1)
        return others[n >= MATCH], n[n >= MATCH]


Found = Iterator[tuple[np.ndarray, np.ndarray]]


def _leaders(rows: List) -> Found:
    """Members against leaders; then from each member outside the largest group of a leader one match
    in every other group that it matches, so that what matches in a list is connected."""
    left, group = np.argsort(rows.ids, kind="stable"), np.arange(len(rows.ids))
    while len(left) > 1:
        hit, _ = rows.alike(left[0], left[1:])
        if len(hit):
            group[hit] = left[0]
            yield np.full(len(hit), rows.ids[left[0]]), rows.ids[hit]
        left = left[1:][~np.isin(left[1:], hit)]
    rows.comp = group
    alone = np.bincount(group, minlength=len(group))[group] == 1
    # two leaders alone have met already
    yield from _across(rows, alone)


def _across(rows: List, met: np.ndarray | None = None) -> Found:
    """From each member outside the largest group, one match in every other group that it matches."""
    names, sizes = np.unique(rows.comp, return_counts=True)
    if len(names) < 2 or (met is not None and met.all()):
        return
    largest = names[np.argmax(sizes)]
    for y in np.flatnonzero(rows.comp != largest).tolist():
        fit = (rows.comp != rows.comp[y]) & (rows.home | rows.home[y])
        if met is not None and met[y]:
            fit &= ~met
        other, _ = rows.alike(y, np.flatnonzero(fit))
        if len(other):
            other = other[np.unique(rows.comp[other], return_index=True)[1]]
            yield np.minimum(rows.ids[other], rows.ids[y]), np.maximum(rows.ids[other], rows.ids[y])


def _salted(rows: DataFrame, small: DataFrame, group: str) -> DataFrame:
    """rows joined with one row for each of some groups; a large group's rows do not meet in one task."""
    copies = small.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_part", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(SALTS)).cast("int")).join(copies, [group, "_part"]).drop("_part")


def _spread(rows: DataFrame, group: str, within: str) -> DataFrame:
    """Rows (id, n, ...) of groups that hold more than one value of `within`, dealt into blocks of a group.

    Rows of a group's largest `within` go to their own block, the others to every block. Groups are
    counted by (group, within) before anything of them meets."""
    held = rows.groupBy(group, within).agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    blocks = F.greatest(F.ceil(F.sum("c") / LIST), F.ceil(F.sum("s") / SET_ROWS)).cast("int")
    mixed = held.groupBy(group).agg(F.count("*").alias("_some"), F.max(F.struct("c", F.col(within).alias("main"))).alias("x"), blocks.alias("_blocks")).filter("_some > 1").select(group, "x.main", "_blocks")
    dealt = _salted(rows, mixed, group).withColumn("_own", F.pmod(F.xxhash64("id", group), F.col("_blocks")).cast("int"))
    visits = F.when((F.col(within) == F.col("main")) | (F.col("_blocks") == 1), F.array("_own")).otherwise(F.sequence(F.lit(0), F.col("_blocks") - 1))
    return dealt.withColumn("salt", F.explode(visits)).withColumn("home", F.col("salt") == F.col("_own")).drop("_blocks")


def _merge_lists(posted: DataFrame, total: int, percent: int, pairs_of: Callable) -> DataFrame:
    """Distinct candidate pairs of all lists; posted has (token, salt, id, sig, n, comp, home)."""
    buckets = max(parallelism(posted.sparkSession), -(-total // POSTINGS_A_BUCKET))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = {c: table.column(c).to_numpy(zero_copy_only=False) for c in ("token", "salt", "id", "n", "comp", "home")}
        rows["sig"] = _matrix(table.column("sig"), np.uint16)
        by = np.lexsort((rows["id"], rows["salt"], rows["token"]))
        token, salt = rows["token"][by], rows["salt"][by]
        at = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])]))
        found = [np.zeros((0, 2), np.int64)]
        for a, b in zip(at.tolist(), [*at[1:].tolist(), len(by)], strict=True):
            if b - a > 1:
                found += [np.stack(p, axis=1) for p in pairs_of(List(rows, by[a:b], percent))]
        both = np.unique(np.concatenate(found), axis=0)
        return pa.table([pa.array(both[:, 0]), pa.array(both[:, 1])], schema=_PAIRS)

    needed = posted.select("token", "salt", "id", "sig", "n", "comp", "home")
    return needed.withColumn("bucket", F.pmod(F.xxhash64("token", "salt"), F.lit(buckets)).cast("int")).groupBy("bucket").applyInArrow(run, "a long, b long").filter("a <> b").distinct()


def _among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is among `ids`, and some others: a filter of FILTER_BITS bits, so that texts which
    are not wanted are not shuffled. With very many ids most rows pass; an exact join has to follow."""
    bit = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    row, place = F.floor(F.col("_b") / BITMAP).cast("int"), F.col("_b") % BITMAP
    bitmaps = ids.select(bit.alias("_b")).groupBy(row.alias("_k")).agg(F.bitmap_construct_agg(place).alias("_bits"))  # FILTER_BITS / BITMAP rows at most
    met = docs.withColumn("_b", bit).withColumn("_k", row).join(F.broadcast(bitmaps), "_k")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return met.filter(F.getbit(byte, (place % 8).cast("int")) == 1).select(docs.columns)


def full_sets(texts: DataFrame, k: int, lower: bool) -> DataFrame:
    """(id, n, set_hash, shingles): sorted 64-bit hashes as bytes, and how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(strings(batch.column(1)), k, lower)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(map(set_hash, sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "n", "set_hash", "shingles"])

    return texts.select("id", "text").mapInArrow(run, "id long, n long, set_hash binary, shingles binary")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = []
            for one, two in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (one, two))
                both = len(np.intersect1d(x, y, assume_unique=True))
                alike.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))

    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _links_inside(ids: np.ndarray, comp: np.ndarray, home: np.ndarray, sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Links between different components of one block, as many as join what can be joined.

    Intersections are counted over an inverted index of the block's shingles."""
    sizes = np.array([len(s) for s in sets])
    doc = np.repeat(np.arange(len(sets)), sizes)
    names, which = np.unique(np.concatenate(sets), return_inverse=True)
    holders = doc[np.argsort(which, kind="stable")]
    upto = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(names)))])
    first = np.cumsum(sizes) - sizes
    labels, at = np.unique(comp, return_inverse=True)
    parent = np.arange(len(labels))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    largest = np.argmax(np.bincount(at))
    for y in np.flatnonzero(at != largest).tolist():
        mine = which[first[y] : first[y] + sizes[y]]
        n = upto[mine + 1] - upto[mine]
        reach = holders[np.repeat(upto[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        both = np.bincount(reach, minlength=len(sets))
        hit = np.flatnonzero((100 * both >= percent * (sizes + sizes[y] - both)) & (at != at[y]) & (home | home[y]))
        for x in hit.tolist():
            p, q = root(at[x]), root(at[y])
            if p != q:
                parent[p] = q
                yield int(ids[x]), int(ids[y])


def link_families(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between different components of a family; members has (id, comp, family)."""
    dealt = materialise(_spread(members.join(sets.select("id", "n"), "id"), "family", "comp").select("id", "n", "comp", "family", "salt", "home"), "dealt")
    held = dealt.agg(F.count("*").alias("c"), F.coalesce(F.sum("n"), F.lit(0)).alias("s")).first()
    buckets = max(parallelism(members.sparkSession), -(-held.c // LIST), -(-held.s // SET_ROWS))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        family, salt, ids, comp = (table.column(c).to_numpy() for c in ("family", "salt", "id", "comp"))
        home = table.column("home").to_numpy(zero_copy_only=False)
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        by = np.lexsort((ids, salt, family))
        at = np.flatnonzero(np.concatenate([[True], (family[by][1:] != family[by][:-1]) | (salt[by][1:] != salt[by][:-1])]))
        found = []
        for a, b in zip(at.tolist(), [*at[1:].tolist(), len(by)], strict=True):
            part = by[a:b]
            if b - a > 1:
                found += _links_inside(ids[part], comp[part], home[part], [sets[k] for k in part.tolist()], percent)
        return pa.table([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], schema=_PAIRS)

    whole = dealt.select("id", "comp", "family", "salt", "home").join(sets.select("id", "shingles"), "id")
    return whole.withColumn("bucket", F.pmod(F.xxhash64("family", "salt"), F.lit(buckets)).cast("int")).groupBy("bucket").applyInArrow(run, "a long, b long")


def components(docs: DataFrame, k: int = 5, percent: int = 80, lower: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, class_id, component_id) of every row: the size of its set, the smallest id with an
    equal set, and the smallest id that links reach."""
    drawn = materialise(sketches(docs, k, lower, id_col, text_col), "sketches")
    full = drawn.filter("n > 0 and id is not null")
    # from here on `id` is the number of a class; `first` is its smallest document
    least = full.groupBy("set_hash").agg(F.min(F.struct("id", "n", "sig")).alias("x")).select("set_hash", F.col("x.id").alias("first"), "x.n", "x.sig")
    classes = materialise(least.sortWithinPartitions("first", "set_hash").withColumn("id", F.monotonically_increasing_id()), "classes")
    posted = materialise(postings(classes.select("id", "n", "sig")), "postings")
    total = posted.count()
    blocks = F.ceil(F.col("df") / LIST).cast("int")
    first = posted.withColumns({"salt": F.pmod(F.xxhash64("id", "token"), blocks).cast("int"), "comp": F.col("id"), "home": F.lit(True)})
    matched = materialise(_merge_lists(first, total, percent, _leaders), "pairs")
    families = connected_components(matched).withColumnRenamed("component", "family")
    long = posted.filter(F.col("df") > LIST)
    if not long.isEmpty():  # members of different blocks of a list have not met
        named = long.join(families, "id", "left").withColumn("comp", F.coalesce("family", "id"))
        matched = matched.unionByName(materialise(_merge_lists(_spread(named, "token", "comp"), total, percent, _across), "pairs")).distinct()
        families = connected_components(matched).withColumnRenamed("component", "family")
    wanted = classes.select("id", "first", "set_hash").join(families.select("id"), "id").select(F.col("id").alias("class"), F.col("first").alias("id"), "set_hash")
    texts = _among(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).filter("id is not null"), wanted.select("id"))
    of_first = full_sets(texts, k, lower).join(wanted, ["id", "set_hash"]).dropDuplicates(["id", "set_hash"])
    sets = materialise(of_first.select(F.col("class").alias("id"), "n", "shingles"), "sets")
    links = materialise(confirm(matched, sets, percent), "links")
    joined = connected_components(links)
    members = families.join(joined.withColumnRenamed("component", "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    more = materialise(link_families(members, sets, percent), "links")
    placed = materialise(full.select(F.col("id").alias("doc"), "n", "set_hash").join(classes.select("set_hash", "id", "first"), "set_hash").drop("set_hash"), "placed")
    several = placed.groupBy("doc").agg(F.min("id").alias("a"), F.max("id").alias("z")).filter("a < z").select("doc", "a")
    same = placed.select("doc", F.col("id").alias("b")).join(several, "doc").filter("a < b").select("a", "b").distinct()  # one document, several texts
    further = materialise(more.unionByName(same), "links")
    if not further.isEmpty():
        joined = connected_components(links.unionByName(further))
    named = classes.select("id", "first").join(joined, "id").withColumnRenamed("component", "comp")
    of_class = _salted(named.select("id", "comp"), named.groupBy("comp").agg(F.min("first").alias("component")), "comp").select("id", "component")
    known = placed.join(of_class, "id", "left").select(F.col("doc").alias("id"), "n", F.col("first").alias("class_id"), F.coalesce("component", "first").alias("component_id"))
    rest = drawn.filter("n = 0 or id is null").select("id", "n", F.col("id").alias("class_id"), F.col("id").alias("component_id"))
    return known.unionByName(rest)


def keep_one(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """`docs` with one document of each group of near-duplicates: five-word shingles, 0.8."""
    found = components(docs, id_col=id_col)
    kept = found.filter("id = component_id").select("id").distinct()
    id_ = docs[f"`{id_col}`"]
    return docs.filter(id_.isNull()).unionByName(docs.join(kept.withColumnRenamed("id", "_kept"), id_ == F.col("_kept"), "left_semi"))


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents alike to 0.8 on two-word shingles."""
    found = components(table(spark, sf_dir, "documents"), k=2)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"), "class_id")
