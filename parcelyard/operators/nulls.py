"""Null models and sequential chains. A replicate is one group of a keyed frame: chains run side by side, each on a graph of parcels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.rng import keyed
from .graph import components


def _replicated(edges: DataFrame, replicates: int) -> DataFrame:
    """A copy of a graph of some hundreds of nodes for each replicate."""
    return edges.crossJoin(edges.sparkSession.range(1, replicates + 1).withColumnRenamed("id", "perm"))


def rewired(edges: DataFrame, replicates: int, swaps: int = 20, seed: int = 1) -> DataFrame:
    """(perm, src, dst), src < dst: double-edge swaps that keep every degree; ``swaps`` tries an edge."""

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        perm = int(group["perm"].iat[0])
        r = np.random.RandomState((seed * 1_000_003 + perm) % 2**32)
        pairs = sorted({(min(a, b), max(a, b)) for a, b in zip(group["src"], group["dst"], strict=True) if a != b})
        have = set(pairs)
        for _ in range(swaps * len(pairs)):
            if len(pairs) < 2:
                break
            i, j = r.randint(len(pairs), size=2)
            (a, b), (c, d) = pairs[i], pairs[j]
            if r.rand() < 0.5:
                c, d = d, c
            one, two = (min(a, d), max(a, d)), (min(c, b), max(c, b))
            if len({a, b, c, d}) == 4 and one not in have and two not in have:
                have -= {pairs[i], pairs[j]}
                have |= {one, two}
                pairs[i], pairs[j] = one, two
        return pd.DataFrame({"perm": perm, "src": [p[0] for p in pairs], "dst": [p[1] for p in pairs]})

    return _replicated(edges.select("src", "dst").where("src < dst"), replicates).groupBy("perm").applyInPandas(walk, "perm bigint, src bigint, dst bigint")


def relabellings(adjacency: DataFrame, chains: int, swaps: int = 10, seed: int = 2) -> DataFrame:
    """(perm, nodes, images): two arrays a chain; ``swaps`` times a label, a keyed label and one of its neighbours exchange what they hold.

    A chain is one row, folded over its steps; the graph of parcels (some hundreds) goes to every task as one row. Nodes without
    neighbours aren't listed, as nothing can move them. Links count in both directions; without links there are no rows.
    """
    given = adjacency.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src <> dst")
    links = given.unionByName(given.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    near = links.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("near"))
    graph = near.agg(F.array_sort(F.collect_list(F.struct("src", "near"))).alias("g")).where(F.size("g") > 0)
    nodes = F.transform("g", lambda r: r["src"])
    at = graph.select(nodes.alias("nodes"), F.transform("g", lambda r: F.transform(r["near"], lambda m: F.array_position(nodes, m).cast("int") - 1)).alias("near"))
    rows = adjacency.sparkSession.range(1, chains + 1).withColumnRenamed("id", "perm").crossJoin(F.broadcast(at))
    key = F.col("perm") + seed * 1_000_003

    def pair(s):
        u = (keyed(key, 2 * s) % F.size("nodes")).cast("int")
        around = F.get("near", u)
        return F.struct(u.alias("u"), F.get(around, (keyed(key, 2 * s + 1) % F.size(around)).cast("int")).alias("v"))

    steps = rows.select("perm", "nodes", F.transform(F.sequence(F.lit(0), swaps * F.size("nodes") - 1), pair).alias("steps"))
    exchanged = F.aggregate("steps", F.col("nodes"), lambda held, s: F.transform(held, lambda x, k: F.when(k == s["u"], F.get(held, s["v"])).when(k == s["v"], F.get(held, s["u"])).otherwise(x)))
    return steps.select("perm", "nodes", exchanged.alias("images")) if swaps > 0 else rows.select("perm", "nodes", F.col("nodes").alias("images"))


def listed(found: DataFrame) -> DataFrame:
    """(perm, node, image) of ``relabellings``."""
    return found.select("perm", F.explode(F.arrays_zip("nodes", "images")).alias("p")).select("perm", F.col("p.nodes").alias("node"), F.col("p.images").alias("image"))


def swapped_labels(adjacency: DataFrame, replicates: int, swaps: int = 10, seed: int = 2) -> DataFrame:
    """(perm, node, image): labels exchanged between neighbours, ``swaps`` times a label."""
    return listed(relabellings(adjacency, replicates, swaps, seed))


def distinct_labels(adjacency: DataFrame, replicates: int, swaps: int = 10, seed: int = 2, tries: int = 10) -> DataFrame:
    """(perm, node, image): like ``swapped_labels``, but no mapping occurs twice. perm runs from 1 to as many as were found.

    Chains are drawn by ``replicates`` at a time until there are enough, ``tries`` times at most; the first of equal mappings stays. A small
    graph may have fewer mappings than are asked for: a fixed number of exchanges reaches permutations of one parity only.
    """
    kept = None
    for t in range(tries):
        fresh = relabellings(adjacency, replicates, swaps, seed + t).withColumn("_at", F.col("perm") + t * replicates)
        both = fresh if kept is None else kept.unionByName(fresh)
        kept = cut(both.groupBy("images").agg(F.min("_at").alias("_at"), F.min_by("perm", "_at").alias("perm"), F.any_value("nodes").alias("nodes")))
        if kept.count() >= replicates:
            break
    # One row a permutation is numbered.
    numbered = kept.withColumn("perm", F.row_number().over(Window.orderBy("_at")).cast("long")).where(F.col("perm") <= replicates)
    return listed(numbered)


def relabelled(matrix: DataFrame, images: DataFrame, by: list[str] | None = None, w: str = "w") -> DataFrame:
    """(perm, by, i, j, w), i < j: what stood at the images of i and j. ``matrix(by, i, j, w)`` holds both directions; nodes without an image keep their place.

    ``images(perm, by, node, image)``: with ``by``, each of its keys has mappings of its own.
    """
    by = by or []
    perms = images.select("perm").distinct()
    known = images.select("perm", *by, F.col("node").alias("_node"))
    nodes = matrix.select(*by, F.col("i").alias("_node")).unionByName(matrix.select(*by, F.col("j").alias("_node"))).distinct()
    still = nodes.join(perms).join(known, ["perm", *by, "_node"], "left_anti").select("perm", *by, F.col("_node").alias("image"), F.col("_node").alias("node"))
    whole = cut(images.select("perm", *by, "image", "node").unionByName(still))
    end = lambda a, b: whole.select("perm", *by, F.col("image").alias(a), F.col("node").alias(b))
    moved = matrix.select(*by, F.col("i").alias("_i"), F.col("j").alias("_j"), w).join(end("_i", "i"), [*by, "_i"]).join(end("_j", "j"), ["perm", *by, "_j"])
    return moved.where("i < j").select("perm", *by, "i", "j", w)


def spatial_test(first: DataFrame, second: DataFrame, images: DataFrame, method: str = "spearman") -> DataFrame:
    """(r, perms, p): correlation of two matrices' upper triangles, and the share of relabellings of the first whose correlation is at least r.

    Matrices are (i, j, w) in both directions. Ranks, ties at their mean, are taken within each relabelling.
    """
    a = first.select("i", "j", F.col("w").alias("wa"))
    b = second.where("i < j").select("i", "j", F.col("w").alias("wb"))
    moved = relabelled(a, images, w="wa").unionByName(a.where("i < j").select(F.lit(0).cast("long").alias("perm"), "i", "j", "wa"))
    both = moved.join(b, ["i", "j"])
    if method == "spearman":
        rank = lambda c: F.rank().over(Window.partitionBy("perm").orderBy(c)) + (F.count("*").over(Window.partitionBy("perm", c)) - 1) / 2
        both = both.select("perm", rank("wa").alias("wa"), rank("wb").alias("wb"))
    found = cut(both.groupBy("perm").agg(F.round(F.corr("wa", "wb"), 12).alias("r")))
    observed = found.where("perm = 0").select("r")
    null = found.where("perm > 0").select(F.col("r").alias("null_r"))
    return observed.join(null).groupBy("r").agg(F.count("*").alias("perms"), (F.count_if(F.col("null_r") >= F.col("r")) / F.count("*")).alias("p"))


def binned_shuffle(edges: DataFrame, distance: str, value: str, width: float, replicates: int) -> DataFrame:
    """(perm, i, j, value): weights dealt anew among the pairs of one distance bin."""
    cell = F.floor(F.col(distance) / width).alias("bin")
    order = F.row_number().over(Window.partitionBy("bin").orderBy("i", "j"))
    numbered = edges.select("i", "j", cell, F.col(value).alias("_v")).withColumn("slot", order)
    key = keyed(F.col("perm"), F.col("i") * 1009 + F.col("j"))
    rolled = numbered.select("i", "j", "bin").crossJoin(edges.sparkSession.range(1, replicates + 1).withColumnRenamed("id", "perm"))
    rolled = rolled.withColumn("slot", F.row_number().over(Window.partitionBy("perm", "bin").orderBy(key, "i", "j")))
    return rolled.join(numbered.select("bin", "slot", F.col("_v").alias(value)), ["bin", "slot"]).select("perm", "i", "j", value)


def _with_bends(rows: DataFrame, c: str, n: Column) -> DataFrame:
    """``rows`` with a value's points ``_y{c}`` and second derivatives ``_m{c}`` as arrays."""
    rows = rows.withColumn(f"_y{c}", F.transform("_l", lambda r: r["v"][c]))
    y = lambda k: F.get(f"_y{c}", k)
    bend = lambda k: y(k + 1) - 2 * y(k) + y(k - 1)
    # Forth over the points 2 to n - 3: m[k] + c[k] m[k + 1] = d[k]; m[1] and m[n - 2] are known.
    start = F.array(F.struct(F.lit(0.0).alias("c"), bend(F.lit(1)).alias("d")))

    def forth(done: Column, k: Column) -> Column:
        before = F.element_at(done, -1)
        return F.concat(done, F.array(F.struct((1 / (4 - before["c"])).alias("c"), ((6 * bend(k) - before["d"]) / (4 - before["c"])).alias("d"))))

    inner = F.when(n > 4, F.sequence(F.lit(2), n - 3)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("_f", F.aggregate(inner, start, forth))
    last_known = F.array(bend(n - 2))
    back = F.aggregate(F.reverse(F.slice("_f", F.lit(2), F.greatest(n - 4, F.lit(0)))), last_known, lambda done, f: F.concat(F.array(f["d"] - f["c"] * F.element_at(done, 1)), done))
    rows = rows.withColumn("_m", F.when(n > 3, F.concat(F.array(bend(F.lit(1))), back)).when(n == 3, F.array(bend(F.lit(1)))))
    one = F.element_at("_m", 1)
    first = 2 * one - F.coalesce(F.get("_m", F.lit(1)), one)
    last = 2 * F.element_at("_m", -1) - F.when(F.size("_m") > 1, F.get("_m", F.size("_m") - 2)).otherwise(one)
    whole = F.when(n >= 3, F.concat(F.array(first), "_m", F.array(last))).otherwise(F.array_repeat(F.lit(0.0), n))
    return rows.withColumn(f"_m{c}", whole).drop("_f", "_m")


def spline(points: DataFrame, by: str, pos: str, values: list[str], samples: int, start: int = 0) -> DataFrame:
    """(by, k, values): cubic splines through each group's points in order of ``pos``, at equal steps from point ``start`` to the last.

    Points lie one unit apart, and the third derivative is continuous at the second point and the last but one (not-a-knot), so two points
    give a line and three a parabola. Second derivatives follow from one sweep forth and one back over the group's array of some dozens of
    points. Of several points at one ``pos`` the least stays; a single point is repeated; a group with fewer than ``start`` + 1 points, or
    with nulls among the values, gives nulls.
    """
    once = points.where(F.col(pos).isNotNull()).groupBy(by, pos).agg(F.min(F.struct(*(F.col(v).cast("double").alias(v) for v in values))).alias("_v"))
    rows = once.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col("_v").alias("v")))).alias("_l"))
    n = F.size("_l")
    for c in values:
        rows = _with_bends(rows, c, n)
    at = rows.withColumn("_n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))) if samples > 0 else rows.withColumn("_n", n).withColumn("k", F.lit(0)).where("false")
    at = at.withColumn("_t", F.when(F.col("_n") > start, start + F.col("k") * (F.col("_n") - 1 - start) / max(samples - 1, 1)))
    at = at.withColumn("_k", F.greatest(F.least(F.floor("_t").cast("int"), F.col("_n") - 2), F.lit(0)))
    right, left = F.col("_k") + 1 - F.col("_t"), F.col("_t") - F.col("_k")

    def value(c: str) -> Column:
        y = lambda k: F.get(f"_y{c}", k)
        m = lambda k: F.get(f"_m{c}", k)
        k, nxt = F.col("_k"), F.col("_k") + 1
        curve = (m(k) * right * right * right + m(nxt) * left * left * left) / 6 + (y(k) - m(k) / 6) * right + (y(nxt) - m(nxt) / 6) * left
        return F.when(F.col("_n") == 1, F.when(F.col("_t").isNotNull(), y(F.lit(0)))).otherwise(curve)

    return at.select(by, "k", *(value(c).alias(c) for c in values))


def bandwidth_order(edges: DataFrame) -> DataFrame:
    """(node, position): reverse Cuthill-McKee order, all components at once.

    A component starts at its node of least degree; each level follows by the first place among a node's neighbours in the level before, then
    by degree, then by id. Components follow each other by their starts. A level is reached by a join and numbered within its component.
    """
    links = cut(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src <> dst").distinct())
    links = cut(links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    nodes = links.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree")).join(components(links), "node")
    nodes = cut(nodes)
    starts = nodes.groupBy("component").agg(F.min(F.struct("degree", "node")).alias("first"), F.count("*").alias("size"))
    placed = cut(starts.select(F.col("first.node").alias("node"), "component", F.lit(1).cast("long").alias("at")))
    front, done = placed, 1
    while True:
        near = front.select(F.col("node").alias("src"), "at").join(links, "src").groupBy(F.col("dst").alias("node")).agg(F.min("at").alias("parent"))
        fresh = near.join(placed.select("node"), "node", "left_anti").join(nodes, "node")
        before = placed.groupBy("component").agg(F.max("at").alias("last"))
        order = F.row_number().over(Window.partitionBy("component").orderBy("parent", "degree", "node"))
        front = cut(fresh.withColumn("_k", order).join(before, "component").select("node", "component", (F.col("last") + F.col("_k")).alias("at")))
        if front.isEmpty():
            break
        placed, done = placed.unionByName(front), done + 1
        if done % 16 == 0:
            placed = cut(placed)
    # One row a component.
    offsets = starts.select("component", (F.sum("size").over(Window.orderBy("first.degree", "first.node")) - F.col("size")).alias("offset"))
    total = starts.agg(F.sum("size").alias("total"))
    found = placed.join(offsets, "component").crossJoin(F.broadcast(total))  # one row is broadcast
    return found.select("node", (F.col("total") - F.col("offset") - F.col("at")).cast("int").alias("position"))


def joint_p(observed: DataFrame, null: DataFrame) -> DataFrame:
    """(p): (count(null gradient >= observed and null entropy <= observed) + 1) / (n + 1), for (grad, entropy) rows."""
    o = observed.select(F.col("grad").alias("og"), F.col("entropy").alias("oe"))
    hit = F.count_if((F.col("og") <= F.col("grad")) & (F.col("oe") >= F.col("entropy")))
    return null.crossJoin(F.broadcast(o)).groupBy("og", "oe").agg(((hit + 1) / (F.count("*") + 1)).alias("p"))
