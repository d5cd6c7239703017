"""Communities of an undirected graph by modularity: parallel local moving, refinement and contraction.

Nodes, edges and weights are tables throughout; nodes are numbered in the order of their names. A round of
local moving sums each node's weight to the communities next to it and lets a node go where modularity gains
most. Nodes move in CLASSES classes (by a hash of their name) in turn, so a round reads the edges of its own
class only, which are written apart; of two lone nodes that want to join each other only one moves. Rounds end
when no node of any class wants to move. Then each community is refined: from single nodes on, only single
nodes join parts of their own community that they have an edge to and that stay where they are, so every part
is connected. The parts are the nodes of the next, smaller graph. Levels go on while modularity grows; the last
that raised it counts, split into connected pieces. All gains are compared as exact integers and equal ones go
to the smaller name, so the result does not depend on how rows are dealt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillforge.operators.components import connected_components
from quillforge.sources.scratch import materialise

#: Classes of nodes that move in turn; rounds of moving, and of refining, of one level at most; levels at most.
CLASSES, ROUNDS, LEVELS = 4, 16, 8

#: Totals whose square a long holds.
LONG_TOTAL = 3_037_000_499


def _pairs(edges: DataFrame) -> DataFrame:
    """(a, b, w), a < b: a pair's weight is how many edges it has either way."""
    return edges.filter("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("w"))


def weighted(edges: DataFrame) -> DataFrame:
    """(src, dst, w) in both directions; a pair's weight is how many edges it has either way."""
    ends = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))
    return _pairs(edges).select(F.explode(ends).alias("e"), "w").select("e.src", "e.dst", "w")


def _exact(value: Column) -> Column:
    return value.cast("decimal(19,0)")


def _gain(total: int, weight: Column, own: Column, theirs: Column) -> Column:
    """What joining adds to modularity, times (total^2 / 2)."""
    whole = (lambda c: c.cast("long")) if total <= LONG_TOTAL else _exact
    return whole(F.lit(total)) * whole(weight) - whole(own) * whole(theirs)


def _numbered(strength: DataFrame) -> DataFrame:
    """(id, node, k, turn): nodes numbered in the order of their names, with the class they move in."""
    placed = materialise(strength.repartitionByRange("node").withColumn("_part", F.spark_partition_id()), "placed")
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = placed.groupBy("_part").agg(F.count("*").alias("n")).select("_part", ahead.alias("_ahead"))  # a row for each part
    at = F.row_number().over(Window.partitionBy("_part").orderBy("node")) + F.col("_ahead")
    return materialise(placed.join(before, "_part").select(at.cast("long").alias("id"), "node", "k", F.pmod(F.xxhash64("node"), F.lit(CLASSES)).cast("int").alias("turn")), "numbered")


def _both(half: DataFrame) -> DataFrame:
    """(src, dst, w, turn) in both directions from (a, b, w) and the classes of a and b; turn is that of src."""
    ends = F.array(*(F.struct(F.col(x).alias("src"), F.col(y).alias("dst"), F.col(f"turn_{x}").alias("turn")) for x, y in ("ab", "ba")))
    return half.select(F.explode(ends).alias("e"), "w").select("e.src", "e.dst", "w", "e.turn")


def _ends(half: DataFrame, of: DataFrame) -> DataFrame:
    """half with what `of` (node, x) has for its two ends, as x_a and x_b."""
    for end in "ab":
        half = half.join(of.select(F.col("node").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in of.columns if c != "node")).hint("shuffle_hash"), end)
    return half


def _state(held: DataFrame) -> DataFrame:
    """held with its community's strength and, if the node is its whole community, its class as `lone`."""
    sums = held.groupBy("comm").agg(F.sum("k").alias("tot"), F.count("*").alias("size"))
    return held.join(sums, "comm").select("node", "comm", "k", "turn", "tot", F.when(F.col("size") == 1, F.col("turn")).alias("lone"))


def _near(adjacent: DataFrame, state: DataFrame) -> DataFrame:
    """(node, comm, tot, lone, w): each node's weight to the communities next to it; dealt by node, as what
    follows is. What is known of a community comes along, so no row is dealt by a community."""
    there = state.select(F.col("node").alias("dst"), "comm", "tot", "lone").hint("shuffle_hash")
    met = adjacent.join(there, "dst").select(F.col("src").alias("node"), "comm", "tot", "lone", "w").repartition("node")
    return met.groupBy("node", "comm", "tot", "lone").agg(F.sum("w").alias("w"))


def _rounds(held: DataFrame, goals: Callable[[DataFrame, Column], DataFrame], name: str) -> DataFrame:
    """held (node, comm, k, turn) after rounds in which the nodes of a class go to their goals (node, goal)."""
    for k in range(ROUNDS):
        mine = F.col("turn") == k % CLASSES
        moved = held.join(goals(held, mine), "node", "left").select("node", F.coalesce("goal", "comm").alias("comm"), "k", "turn", F.col("goal").isNotNull().alias("moved"))
        moved = materialise(moved, name)
        held = moved.drop("moved")
        if moved.filter("moved").isEmpty() and goals(held, ~mine).isEmpty():
            break
    return held


def _move(adjacent: DataFrame, held: DataFrame, total: int) -> DataFrame:
    """held after rounds of local moving."""

    def goals(held: DataFrame, who: Column) -> DataFrame:
        state = _state(held)
        own = state.filter(who).select("node", F.col("comm").alias("own"), "k", F.col("tot").alias("own_tot"), F.col("lone").alias("own_lone"))
        near = _near(adjacent.filter(who), state).join(own.hint("shuffle_hash"), "node")
        there = F.col("tot") - F.when(F.col("comm") == F.col("own"), F.col("k")).otherwise(0)
        one_of_two = (F.col("comm") == F.col("own")) | F.col("own_lone").isNull() | F.col("lone").isNull() | (F.col("comm") < F.col("own"))
        choice = F.struct((-_gain(total, F.col("w"), F.col("k"), there)).alias("loss"), "comm")
        stay = _gain(total, F.coalesce(F.max(F.when(F.col("comm") == F.col("own"), F.col("w"))), F.lit(0)), F.max("k"), F.max("own_tot") - F.max("k"))
        best = near.filter(one_of_two).groupBy("node").agg(F.min(choice).alias("best"), stay.alias("stay"))
        return best.filter(-F.col("best.loss") > F.col("stay")).select("node", F.col("best.comm").alias("goal"))

    return _rounds(held, goals, "moved")


def _refine(inside: DataFrame, held: DataFrame, total: int) -> DataFrame:
    """(node, comm, k, turn), where comm is a connected part of a community; inside are the edges in communities."""

    def goals(held: DataFrame, who: Column) -> DataFrame:
        state = _state(held)
        own = state.filter(who & F.col("lone").isNotNull()).select("node", "k", "turn")
        near = _near(inside.filter(who), state).join(own.hint("shuffle_hash"), "node")
        stays = F.col("lone").isNull() | (F.col("lone") != F.col("turn"))
        best = near.filter(stays).withColumn("g", _gain(total, F.col("w"), F.col("k"), F.col("tot"))).filter("g > 0")
        return best.groupBy("node").agg(F.min(F.struct((-F.col("g")).alias("loss"), "comm")).alias("best")).select("node", F.col("best.comm").alias("goal"))

    return _rounds(held.withColumn("comm", F.col("node")), goals, "refined")


def _score(whole: DataFrame, placed: DataFrame) -> DataFrame:
    """One row: modularity of placed (node, comm) over weights in both directions."""
    one, two = placed.select(F.col("node").alias("src"), F.col("comm").alias("a")), placed.select(F.col("node").alias("dst"), F.col("comm").alias("b"))
    sums = whole.join(one, "src").join(two, "dst").groupBy("a").agg(F.sum("w").alias("tot"), F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0)).alias("inner"))
    of = sums.agg(F.sum("tot").alias("t"), F.sum("inner").alias("i"), F.sum(_exact(F.col("tot")) * _exact(F.col("tot"))).alias("s"))
    return of.select(F.coalesce(F.col("i") / F.col("t") - F.col("s").cast("double") / (F.col("t").cast("double") * F.col("t")), F.lit(0.0)).alias("modularity"))


def communities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, community, size): a community goes by its least node; nodes without edges are alone."""
    pairs, listed = materialise(_pairs(edges), "pairs"), nodes.select("node").distinct()
    names = _numbered(pairs.select(F.explode(F.array("a", "b")).alias("node"), "w").groupBy("node").agg(F.sum("w").alias("k")))
    total, count = names.agg(F.sum("k"), F.count("*")).first()
    if total is None:
        return listed.select("node", F.col("node").alias("community"), F.lit(1).cast("long").alias("size"))
    half = materialise(_ends(pairs, names.select("node", "id", "turn")).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "w", "turn_a", "turn_b"), "half")
    held, member = names.select(F.col("id").alias("node"), F.col("id").alias("comm"), "k", "turn"), names.select(F.col("id").alias("node"), F.col("id").alias("at"))
    best, most = None, None
    for _ in range(LEVELS):
        held = _move(materialise(_both(half), "adjacent", "turn"), held, total)
        inside = materialise(_both(_ends(half, held.select("node", "comm")).filter("comm_a = comm_b")), "inside", "turn")
        every, inner = ((t.agg(F.sum("w")).first()[0] or 0) for t in (half, inside))
        squares = held.groupBy("comm").agg(_exact(F.sum("k")).alias("tot")).agg(F.sum(F.col("tot") * F.col("tot"))).first()[0]
        score = (total - 2 * every + inner) * total - int(squares)  # modularity times total^2
        if most is not None and score <= most:
            break
        best, most = (member, inside), score
        subs = _refine(inside, held, total)
        parts = subs.groupBy("comm").agg(F.sum("k").alias("k"), F.max(F.when(F.col("node") == F.col("comm"), F.col("turn"))).alias("turn"))
        fewer = parts.count()
        if fewer == count:
            break
        count = fewer
        subs = materialise(subs.select("node", F.col("comm").alias("sub")).join(parts.select(F.col("comm").alias("sub"), "turn"), "sub").select("node", "sub", "turn"), "subs")
        member = materialise(member.join(subs.select(F.col("node").alias("at"), "sub"), "at").select("node", F.col("sub").alias("at")), "member")
        held = materialise(held.select("node", "comm").join(subs, "node").groupBy(F.col("sub").alias("comm")).agg(F.min("comm").alias("_c")).join(parts, "comm").select(F.col("comm").alias("node"), F.col("_c").alias("comm"), "k", "turn"), "held")
        one, two = (F.struct(F.col(f"sub_{x}").alias("sub"), F.col(f"turn_{x}").alias("turn")) for x in "ab")
        crossing = _ends(half.select("a", "b", "w"), subs).filter("sub_a <> sub_b").groupBy(F.least(one, two).alias("x"), F.greatest(one, two).alias("y")).agg(F.sum("w").alias("w"))
        half = materialise(crossing.select(F.col("x.sub").alias("a"), F.col("y.sub").alias("b"), "w", F.col("x.turn").alias("turn_a"), F.col("y.turn").alias("turn_b")), "half")
    member, inside = best  # parts are connected, so the pieces of communities are those of the graph of parts
    pieces = connected_components(inside.filter("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b")))
    placed = member.join(pieces.withColumnRenamed("id", "at"), "at", "left").select("node", F.coalesce("component", "at").alias("piece"))
    least = placed.groupBy("piece").agg(F.min("node").alias("id")).join(names.select("id", F.col("node").alias("component")), "id").select("piece", "component")
    joined = placed.join(least, "piece").select(F.col("node").alias("id"), "component").join(names.select("id", "node"), "id").select("node", "component")
    named = listed.join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("community"))
    return named.join(named.groupBy("community").agg(F.count("*").alias("size")), "community").select("node", "community", "size")


def ordered(found: DataFrame) -> DataFrame:
    """(node, community, size, rank): rank of the community from 1, larger ones first, equal ones by name."""
    each = found.select("community", "size").distinct()
    sizes = each.groupBy("size").agg(F.count("*").alias("n"))  # of n nodes there are at most sqrt(2 n) sizes
    before = sizes.withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy("size").orderBy("community")) + F.col("_before")
    return found.join(each.join(before, "size").select("community", rank.alias("rank")), "community").select("node", "community", "size", "rank")


def modularity(edges: DataFrame, found: DataFrame) -> DataFrame:
    """One row: modularity of a partition (node, community)."""
    return _score(weighted(edges), found.select("node", F.col("community").alias("comm")))
