"""Paths through graphs of parcels: gradients, costs, perturbation of several nodes, interpolation between stops. Steps are rows (path_id, pos, node)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from . import graph


def path_edges(steps: DataFrame, path: str = "path_id") -> DataFrame:
    """(path_id, pos, src, dst): each step and the next one."""
    following = F.lead("node").over(Window.partitionBy(path).orderBy("pos"))
    return steps.select(path, "pos", F.col("node").alias("src"), following.alias("dst")).where("dst is not null")


def scaled_gradient(steps: DataFrame, value: str, lo: float | None = None, hi: float | None = None, detrend: bool = False, normalise: bool = False, path: str = "path_id") -> DataFrame:
    """``steps`` with grad: differences along the path (central inside, one-sided at the ends) over its number of nodes N.

    ``detrend`` takes a line of slope (hi - lo) / N off first; ``lo`` and ``hi`` are those of the path where they aren't given.
    ``normalise`` maps what is possible, plus and minus (hi - lo) * (N + 1) / N^2, to 0 and 1.
    """
    whole = Window.partitionBy(path)
    n = F.count("*").over(whole)
    low = F.lit(lo) if lo is not None else F.min(value).over(whole)
    high = F.lit(hi) if hi is not None else F.max(value).over(whole)
    raw = graph.path_gradient(steps, value, path).withColumns({"_n": n, "_gap": high - low})
    slope = F.col("_gap") / F.col("_n") if detrend else F.lit(0.0)
    grad = (F.col("grad") - slope) / F.col("_n")
    bound = F.col("_gap") * (F.col("_n") + 1) / (F.col("_n") * F.col("_n"))
    return raw.withColumn("grad", (grad + bound) / F.nullif(2 * bound, F.lit(0.0)) if normalise else grad).drop("_n", "_gap")


def node_cost(steps: DataFrame, value: str, strength: str, energy: float, beta: float = 0.5, path: str = "path_id") -> DataFrame:
    """(path_id, cost): mean absolute gradient over the path's unit interval, over its nodes, less beta times the mean strength over the network's energy. Null values don't count."""
    graded = graph.path_gradient(steps, value, path)
    n = F.count("*")
    return graded.groupBy(path).agg((F.avg(F.abs("grad")) * (n - 1) / n - beta * F.avg(strength) / energy).alias("cost"))


def total_cost(steps: DataFrame, value: str, nodes: int, path: str = "path_id") -> DataFrame:
    """(path_id, total, nabla, entropy) of paths through a network of ``nodes`` nodes.

    nabla: sum of squared gradients over that of a path that alternates between the least and the largest value (only its two ends
    have a slope). entropy: of a histogram of the path's own range in round(2 nodes^(1/3)) bins, over its largest; total: their ratio.
    """
    bins = round(2 * nodes ** (1 / 3))
    whole = Window.partitionBy(path)
    graded = scaled_gradient(steps, value, path=path).withColumns({"_lo": F.min(value).over(whole), "_hi": F.max(value).over(whole), "_n": F.count("*").over(whole)})
    gap = F.col("_hi") - F.col("_lo")
    cell = F.when(gap > 0, F.least(F.floor((F.col(value) - F.col("_lo")) / gap * bins), F.lit(bins - 1))).otherwise(F.lit(bins // 2))
    sums = graded.groupBy(path).agg((F.sum(F.col("grad") * F.col("grad")) / F.nullif(2 * F.pow(F.max(gap) / F.max("_n"), 2), F.lit(0.0))).alias("nabla"))
    p = F.col("c") / F.sum("c").over(whole)
    spread = graded.groupBy(path, cell.alias("_b")).agg(F.count("*").alias("c")).withColumn("p", p).groupBy(path).agg((-F.sum(F.col("p") * F.ln("p")) / F.ln(F.lit(float(bins)))).alias("entropy"))
    return sums.join(spread, path).select(path, (F.col("nabla") / F.nullif(F.col("entropy"), F.lit(0.0))).alias("total"), "nabla", "entropy")


def perturbed_anywhere(steps: DataFrame, edges: DataFrame, longest: int, most: int | None = None, path: str = "path_id") -> DataFrame:
    """(path_id, nodes, changed): paths with one or several inner nodes replaced.

    A node may be replaced by any common neighbour of the nodes beside it on the path as it was. What comes out must follow edges and
    repeat no node. Paths are built step by step, so what breaks a rule is dropped where it does. ``most`` keeps the first ones of each
    path, by number of changes and then by nodes.
    """
    w = Window.partitionBy(path).orderBy("pos")
    links = edges.select("src", "dst").distinct()
    around = steps.select(path, "pos", "node", F.lag("node").over(w).alias("_prev"), F.lead("node").over(w).alias("_next"))
    options = around.join(links.select(F.col("src").alias("_prev"), F.col("dst").alias("to")), "_prev").join(links.select(F.col("src").alias("_next"), F.col("dst").alias("to")), ["_next", "to"]).where("to <> node")
    options = cut(options.select(path, "pos", "to", F.lit(1).alias("change")).distinct().unionByName(steps.select(path, "pos", F.col("node").alias("to"), F.lit(0).alias("change"))))
    links = cut(links)
    last = steps.groupBy(path).agg(F.max("pos").alias("_last"))
    front = options.where("pos = 0").join(last, path).select(path, F.array("to").alias("nodes"), F.col("change").alias("changed"), "_last")
    done = front.where("_last = 0")
    for pos in range(1, longest):
        step = front.join(options.where(F.col("pos") == pos).select(path, F.col("to").alias("dst"), "change"), path).where(~F.array_contains("nodes", F.col("dst")))
        step = step.withColumn("src", F.element_at("nodes", -1)).join(links, ["src", "dst"], "left_semi")
        front = cut(step.select(path, F.concat("nodes", F.array("dst")).alias("nodes"), (F.col("changed") + F.col("change")).alias("changed"), "_last"))
        done = done.unionByName(front.where(F.col("_last") == pos))
    found = done.where("changed > 0").select(path, "nodes", "changed")
    if most is None:
        return found
    order = Window.partitionBy(path).orderBy("changed", "nodes")
    return found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def best_exact(edges: DataFrame, start: int, values: DataFrame, nodes: int, energy: float, beta: float, goal: int | None = None) -> DataFrame:
    """(goal, path, cost): of the simple paths of exactly ``nodes`` nodes from ``start``, all with values, the one of least cost to each end; equal costs go to the lesser node list. ``values(node, v, strength)``."""
    exact = graph.with_path_ids(graph.simple_paths(edges, start, nodes - 1, goal).where(F.col("length") == nodes - 1))
    steps = exact.join(values, "node")
    whole = steps.groupBy("path_id").agg(F.count("v").alias("_n"), F.sort_array(F.collect_list(F.struct("pos", "node"))).alias("_s")).where(F.col("_n") == nodes)
    cost = node_cost(steps, "v", "strength", energy, beta).withColumn("cost", F.round("cost", 9))
    path = F.transform("_s", lambda s: s["node"].cast("int"))
    priced = whole.join(cost, "path_id").select(path.alias("path"), "cost").withColumn("goal", F.element_at("path", -1))
    return priced.groupBy("goal").agg(F.min_by("path", F.struct("cost", "path")).alias("path"), F.min("cost").alias("cost"))


def best_leg(edges: DataFrame, start: int, goal: int, values: DataFrame, nodes: int, energy: float, beta: float, most: int) -> DataFrame:
    """(path, cost): ``best_exact`` to one end; else the shortest path within ``most`` links, without cost; else no row."""
    best = best_exact(edges, start, values, nodes, energy, beta, goal).select("path", "cost", F.lit(0).alias("_rank"))
    short = graph.shortest_paths(edges, start, most).where(F.col("node") == goal).select("path", F.lit(None).cast("double").alias("cost"), F.lit(1).alias("_rank"))
    return best.unionByName(short).orderBy("_rank").limit(1).drop("_rank")


def interpolated(edges: DataFrame, stops: list[int], values: DataFrame, nodes: int, energy: float, beta: float = 0.5, most: int = 12) -> DataFrame:
    """(pos, node): one path through ``stops``: the best leg between each two, their ends joined; unconnected stops follow each other; nodes without a value are left out."""
    legs = None
    for k, (a, b) in enumerate(zip(stops[:-1], stops[1:], strict=True)):
        none = edges.sparkSession.range(1).select(F.array(F.lit(a), F.lit(b)).alias("path"), F.lit(2).alias("_rank"))
        leg = best_leg(edges, a, b, values, nodes, energy, beta, most).select("path", F.lit(1).alias("_rank")).unionByName(none).orderBy("_rank").limit(1)
        leg = leg.select(F.lit(k).alias("leg"), F.posexplode(F.col("path") if k == 0 else F.slice("path", F.lit(2), F.size("path"))).alias("at", "node"))
        legs = leg if legs is None else legs.unionByName(leg)
    sound = values.where(F.col("v").isNotNull() & ~F.isnan("v")).select("node")
    kept = legs.join(sound, "node", "left_semi")
    return kept.select((F.row_number().over(Window.orderBy("leg", "at")) - 1).alias("pos"), "node")  # one path


def first_results(rows: DataFrame, n: int, order: list[str | Column]) -> DataFrame:
    """The first ``n`` rows in a stated order."""
    return rows.orderBy(*order).limit(n)
