"""Directed graphs as tables: nodes(node) and edges(src, dst), distinct and without self-loops.

The iterative operators loop over whole tables with joins and aggregations; each round's state is
written to the shared folder. None of them gathers nodes or edges on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillforge.sources.scratch import drop, materialise


def clean_edges(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").filter("src <> dst").distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, fan_in, fan_out) of every node."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    return nodes.select("node", F.lit(0).alias("o"), F.lit(0).alias("i"), F.lit(True).alias("n")).unionByName(ends.withColumn("n", F.lit(False))).groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"), F.max("n").alias("n")).filter("n").drop("n")


def distances(sources: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """(node, dst, dist): shortest distances from each source node to what it reaches, itself left out.

    The result has a row for each reachable pair; restrict `sources` (or `most`) on large graphs."""
    found = None
    front = sources.select("node", F.col("node").alias("dst"), F.lit(0).cast("long").alias("dist"))
    step = 0
    while most is None or step < most:
        step += 1
        ahead = front.join(edges.withColumnRenamed("dst", "_next"), F.col("dst") == F.col("src")).select("node", F.col("_next").alias("dst")).filter("node <> dst").distinct()
        if found is not None:
            ahead = ahead.join(found.select("node", "dst"), ["node", "dst"], "left_anti")
        front = materialise(ahead.withColumn("dist", F.lit(step).cast("long")), "front")
        if front.isEmpty():
            break
        found = front if found is None else found.unionByName(front)
    return front if found is None else found


#: Nodes of a bitmap, as bitmap_construct_agg makes them (4 KB).
BITMAP = 32768


def reach(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, reachable, indirect, depth): depth is the largest shortest distance.

    What a node reaches is a bitmap for each BITMAP nodes of the graph that it reaches any of. A round
    passes the bitmaps that grew on to the nodes before them; the last round in which one grows is its
    depth. Nothing has a row for each reachable pair."""
    ends = nodes.select("node").unionByName(edges.select(F.explode(F.array("src", "dst")).alias("node"))).distinct()
    placed = materialise(ends.withColumn("i", F.monotonically_increasing_id()), "places")
    own = placed.groupBy("node", F.shiftright("i", 15).alias("block")).agg(F.bitmap_construct_agg(F.col("i") % BITMAP).alias("bits"))
    known = materialise(own.withColumns({"n": F.lit(1).cast("long"), "step": F.lit(0).cast("long")}), "reached")
    step, front = 0, known
    while True:
        step += 1
        ahead = front.select(F.col("node").alias("dst"), "block", "bits").join(edges, "dst").groupBy(F.col("src").alias("node"), "block").agg(F.bitmap_or_agg("bits").alias("bits"))
        both = known.unionByName(ahead.withColumns({"n": F.lit(0).cast("long"), "step": F.lit(0).cast("long")}))
        merged = both.groupBy("node", "block").agg(F.bitmap_or_agg("bits").alias("bits"), F.max("n").alias("n"), F.max("step").alias("step"))
        grown = F.bitmap_count("bits") > F.col("n")
        now = materialise(merged.select("node", "block", "bits", F.bitmap_count("bits").alias("n"), F.when(grown, F.lit(step).cast("long")).otherwise(F.col("step")).alias("step")), "reached")
        drop(known)
        known, front = now, now.filter(F.col("step") == step)
        if front.isEmpty():
            break
    found = known.groupBy("node").agg((F.sum("n") - 1).alias("reachable"), F.max("step").alias("depth"))
    direct = edges.filter("src <> dst").select("src", "dst").distinct().groupBy(F.col("src").alias("node")).agg(F.count("*").alias("direct"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return nodes.select("node").join(found, "node", "left").join(direct, "node", "left").select("node", zero("reachable").alias("reachable"), (zero("reachable") - zero("direct")).alias("indirect"), zero("depth").alias("depth"))


def jumped(pointers: DataFrame) -> DataFrame:
    """(node, to, d, b, least, ends): where pointers lead once they are followed to their end.

    pointers has (node, to, d, b): one pointer a node, along which a value x at `to` is max(b, d + x) at
    the node. A round follows each pointer's pointer twice, so a chain of n nodes takes log4(n) rounds.
    A pointer into a ring has no end (`ends` is false; `to` is a node of the ring); `least` is the least
    node on the way, of a ring's nodes the least of the ring."""
    held = materialise(pointers.select("node", "to", "d", "b", F.col("node").alias("least")), "pointers")
    most, length = held.count(), 1
    while True:
        now = held
        for _ in range(2):
            on = now.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("d").alias("_d"), F.col("b").alias("_b"), F.col("least").alias("_least"))
            now = now.select("node", "to", "d", "b", "least").join(on, "to", "left").select("node", F.coalesce("_to", "to").alias("to"), (F.col("d") + F.coalesce("_d", F.lit(0))).alias("d"), F.greatest("b", F.col("d") + F.col("_b")).alias("b"), F.least("least", "_least").alias("least"), F.col("_to").isNull().alias("ends"))
        length *= 4
        after = materialise(now, "pointers")
        drop(held)
        held = after
        # one round after every chain must have been followed, as the last of them only shows then that it ends
        if length > 4 * most or held.filter("not ends").isEmpty():
            return held


def _spread(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): the least label that reaches each node along the edges."""
    while True:
        ahead = labels.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "label")
        now = materialise(labels.unionByName(ahead).groupBy("node").agg(F.min("label").alias("label")), "labels")
        if now.join(labels, ["node", "label"], "left_anti").isEmpty():
            return now
        drop(labels)
        labels = now


def _contracted(left: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges with each chain of nodes of one edge in and one out as one edge; (node, u, w) of the chains'
    nodes with the nodes around them; and (node, scc) of rings of such nodes."""
    chain = ends.filter("n_in = 1 and n_out = 1")
    zero = F.lit(0).cast("long")
    onward = jumped(chain.select("node", F.col("after").alias("to"), zero.alias("d"), zero.alias("b")))
    back = jumped(chain.select("node", F.col("before").alias("to"), zero.alias("d"), zero.alias("b")))
    rings = onward.filter("not ends").select("node", F.col("least").alias("scc"))
    chains = materialise(onward.filter("ends").select("node", F.col("to").alias("w")).join(back.select("node", F.col("to").alias("u")), "node").select("node", "u", "w"), "chains")
    inner = chain.select("node")
    kept = left.join(inner.withColumnRenamed("node", "src"), "src", "left_anti").join(inner.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
    return materialise(kept.unionByName(chains.select(F.col("u").alias("src"), F.col("w").alias("dst")).filter("src <> dst")).distinct(), "edges"), chains, rings


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, scc, size) with the least member as name.

    Chains of nodes with one edge in and one out become one edge, by pointers that double their reach, and
    rings of such nodes are components. Nodes without an edge in or out are components of their own. What is
    left is coloured forward: the least label that reaches a node is its colour; a colour's root, followed
    backwards inside the colour, is a component. A chain's node belongs to the component of its two ends,
    if they have the same."""
    left = materialise(clean_edges(edges), "edges")
    listed = nodes.select("node").distinct()
    lone = listed.join(left.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "node", "left_anti")
    parts, chains = [materialise(lone.withColumn("scc", F.col("node")), "scc")], []
    while True:
        out = F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o"), F.lit(None).cast(left.schema["src"].dataType).alias("before"), F.col("dst").alias("after"))
        into = F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o"), F.col("src").alias("before"), F.lit(None).cast(left.schema["dst"].dataType).alias("after"))
        met = left.select(F.explode(F.array(out, into)).alias("e")).select("e.*").groupBy("node")
        ends = materialise(met.agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"), F.min("before").alias("before"), F.min("after").alias("after")), "ends")
        kinds = ends.agg(F.count("*").alias("n"), F.count_if(F.expr("n_in = 1 and n_out = 1")).alias("chain"), F.count_if(F.expr("n_in = 0 or n_out = 0")).alias("alone")).first()
        if not kinds.n:
            break
        if kinds.chain:
            now, chain, rings = _contracted(left, ends)
            chains.append(chain)
            parts.append(rings)
            # the ends of what was contracted may have no edge left
            gone = ends.select("node").join(chain.select("node"), "node", "left_anti").join(rings.select("node"), "node", "left_anti")
            parts.append(materialise(gone.join(now.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "node", "left_anti").withColumn("scc", F.col("node")), "scc"))
        elif kinds.alone:
            alone = ends.filter("n_in = 0 or n_out = 0").select("node")
            now = materialise(left.join(alone.withColumnRenamed("node", "src"), "src", "left_anti").join(alone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"), "edges")
            kept = now.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
            parts.append(materialise(ends.select("node").join(kept, "node", "left_anti").withColumn("scc", F.col("node")), "scc"))
        else:
            colour = _spread(ends.select("node", F.col("node").alias("label")), left)
            inside = left.join(colour.withColumnRenamed("node", "src").withColumnRenamed("label", "_c1"), "src").join(colour.withColumnRenamed("node", "dst").withColumnRenamed("label", "_c2"), "dst").filter(F.col("_c1") == F.col("_c2"))
            back = _spread(colour.filter("node = label"), inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
            found = materialise(back.select("node", F.col("label").alias("scc")), "scc")
            now = materialise(left.join(found.select(F.col("node").alias("src")), "src", "left_anti").join(found.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"), "edges")
            kept = now.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
            gone = ends.select("node").join(found.select("node"), "node", "left_anti").join(kept, "node", "left_anti")
            parts += [found, materialise(gone.withColumn("scc", F.col("node")), "scc")]
        drop(left)
        left = now
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    for chain in reversed(chains):
        one, two = whole.select(F.col("node").alias("u"), F.col("scc").alias("s")), whole.select(F.col("node").alias("w"), F.col("scc").alias("t"))
        found = chain.join(one, "u").join(two, "w").select("node", F.when(F.col("s") == F.col("t"), F.col("s")).otherwise(F.col("node")).alias("scc"))
        whole = materialise(whole.unionByName(found), "scc")
    size = whole.groupBy("scc").agg(F.count("*").alias("size"), F.min("node").alias("least"))
    return whole.join(size, "scc").select("node", F.col("least").alias("scc"), "size")


def cycles(components: DataFrame) -> DataFrame:
    """(scc, size) of components of two nodes and more."""
    return components.filter("size >= 2").select("scc", "size").distinct()


def _inside(edges: DataFrame, components: DataFrame) -> DataFrame:
    one = components.select(F.col("node").alias("src"), F.col("scc").alias("s1"), "size")
    two = components.select(F.col("node").alias("dst"), F.col("scc").alias("s2"))
    return edges.join(one, "src").join(two, "dst")


def break_edges(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(scc, src, dst): the least edge inside each cycle."""
    inside = _inside(edges, components).filter("s1 = s2 and size >= 2")
    return inside.groupBy(F.col("s1").alias("scc")).agg(F.min(F.struct("src", "dst")).alias("e")).select("scc", "e.src", "e.dst")


def without_breaks(edges: DataFrame, breaks: DataFrame) -> DataFrame:
    return edges.join(breaks.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst")


def what_if(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: cycles before, and cycles and layers once the least edge of each cycle is gone."""
    found = materialise(strong_components(nodes, edges), "scc")
    left = without_breaks(edges, break_edges(edges, found))
    again = materialise(strong_components(nodes, left), "scc")
    count = lambda scc, name: cycles(scc).agg(F.count("*").alias(name))
    height = layers(left, again).agg(F.coalesce(F.max("layer") + 1, F.lit(0)).alias("layers"))
    return count(found, "cycles").join(count(again, "remaining_cycles")).join(height)  # one row each


def importers(edges: DataFrame, tests: DataFrame) -> DataFrame:
    """(node, importer): the test modules with an edge into a module; tests has (node)."""
    return edges.join(tests.select(F.col("node").alias("src")).distinct(), "src", "left_semi").select(F.col("dst").alias("node"), F.col("src").alias("importer")).distinct()


def heights(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, layer) of a graph without cycles: the longest path from each node, in edges.

    A node's layer is max(b, w + layer of dst) over its edges, b being what is known already. A round
    takes the nodes without edges off, their layers going into the b of the nodes before them, and follows
    nodes of one edge to where they lead (see `jumped`), so that chains of any length and trees of any depth
    go in one round; only where every node has several ways on does a round take one level."""
    zero = F.lit(0).cast("long")
    base = materialise(nodes.select("node", zero.alias("b")), "bases")
    left = materialise(edges.select("src", "dst", F.lit(1).cast("long").alias("w")), "edges")
    done, hung = [], []
    while True:
        ways = left.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"))
        sinks = materialise(base.join(ways, "node", "left_anti"), "layers")
        done.append(sinks.select("node", F.col("b").alias("layer")))
        if left.isEmpty():
            break
        low = left.join(sinks.select(F.col("node").alias("dst"), F.col("b").alias("_b")), "dst")
        raised = base.join(ways, "node", "left_semi").unionByName(low.select(F.col("src").alias("node"), (F.col("w") + F.col("_b")).alias("b"))).groupBy("node").agg(F.max("b").alias("b"))
        left = materialise(left.join(sinks.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst", "w"), "edges")
        base = materialise(raised, "bases")
        one = left.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"), F.min("dst").alias("to"), F.min("w").alias("d")).filter("n = 1").join(base, "node").select("node", "to", "d", "b")
        chain = jumped(one)
        if not chain.isEmpty():
            hung.append(chain)
            on = chain.select(F.col("node").alias("dst"), F.col("to").alias("_to"), F.col("d").alias("_d"), F.col("b").alias("_b"))
            led = materialise(left.join(chain.select(F.col("node").alias("src")), "src", "left_anti").join(on, "dst", "left"), "edges")
            more = led.filter("_to is not null").select(F.col("src").alias("node"), (F.col("w") + F.col("_b")).alias("b"))
            base = materialise(base.join(chain.select("node"), "node", "left_anti").unionByName(more).groupBy("node").agg(F.max("b").alias("b")), "bases")
            left = materialise(led.groupBy("src", F.coalesce("_to", "dst").alias("dst")).agg(F.max(F.col("w") + F.coalesce("_d", zero)).alias("w")), "edges")
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    for chain in reversed(hung):
        found = chain.join(whole.select(F.col("node").alias("to"), "layer"), "to").select("node", F.greatest("b", F.col("d") + F.col("layer")).alias("layer"))
        whole = materialise(whole.unionByName(found), "layers")
    return whole


def layers(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(node, scc, layer): 0 without dependencies outside the own cycle, else one over the highest of them."""
    held = materialise(components.select("node", "scc", "size"), "scc")
    quotient = _inside(edges, held).filter("s1 <> s2").select(F.col("s1").alias("src"), F.col("s2").alias("dst")).distinct()
    level = heights(held.select(F.col("scc").alias("node")).distinct(), quotient)
    return held.join(level.withColumnRenamed("node", "scc"), "scc").select("node", "scc", "layer")


def layer_violations(edges: DataFrame, layered: DataFrame) -> DataFrame:
    """Edges that lead to a higher layer; a layering made by `layers` has none."""
    one = layered.select(F.col("node").alias("src"), F.col("layer").alias("l1"))
    two = layered.select(F.col("node").alias("dst"), F.col("layer").alias("l2"))
    return edges.join(one, "src").join(two, "dst").filter("l1 < l2").select("src", "dst")


def orphans(measured: DataFrame, exempt: Column) -> DataFrame:
    """Nodes without any edge that are not exempt; measured has fan_in and fan_out."""
    return measured.filter("fan_in = 0 and fan_out = 0").filter(~exempt)


def cross_group(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(src, dst, src_group, dst_group) of edges between groups; groups has (node, grp)."""
    one = groups.select(F.col("node").alias("src"), F.col("grp").alias("src_group"))
    two = groups.select(F.col("node").alias("dst"), F.col("grp").alias("dst_group"))
    return edges.join(one, "src").join(two, "dst").filter("src_group <> dst_group")


def quotient(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(src, dst, weight): edges between groups with the number of edges that they stand for."""
    return cross_group(edges, groups).groupBy(F.col("src_group").alias("src"), F.col("dst_group").alias("dst")).agg(F.count("*").alias("weight"))


def undirected_weights(edges: DataFrame, groups: DataFrame) -> DataFrame:
    return cross_group(edges, groups).groupBy(F.least("src_group", "dst_group").alias("a"), F.greatest("src_group", "dst_group").alias("b")).agg(F.count("*").alias("weight"))


def with_prefix(nodes: DataFrame, edges: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """For the union of graphs of several languages."""
    named = lambda c: F.concat(F.lit(prefix + ":"), F.col(c)).alias(c)
    return nodes.select(named("node")), edges.select(named("src"), named("dst"))


def target_nodes(n: int, zoom: float) -> int:
    """How many nodes a coarse view has: from 1 at zoom 0 to all at zoom 1."""
    if n <= 0:
        return 0
    return 1 + min(int(zoom * (n - 1) + 0.5), n - 1)
