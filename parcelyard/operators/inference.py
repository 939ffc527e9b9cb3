"""Permutation inference with nuisance covariates, sign flips and tails; rich-club comparison whole. Everything per edge is sums, so a replicate costs one aggregation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.rng import keyed
from . import graph, nulls, statistics


def residuals(rows: DataFrame, by: list[str], y: str, on: str | None = None, out: str = "res") -> DataFrame:
    """``rows`` with what a constant, or a line in ``on``, leaves of y within ``by``."""
    w = Window.partitionBy(*by)
    centred = F.col(y) - F.avg(y).over(w)
    if on is None:
        return rows.withColumn(out, centred)
    z = F.col(on) - F.avg(on).over(w)
    fitted = rows.withColumns({"_yc": centred, "_zc": z})
    slope = F.sum(F.col("_yc") * F.col("_zc")).over(w) / F.nullif(F.sum(F.col("_zc") * F.col("_zc")).over(w), F.lit(0.0))
    return fitted.withColumn("_b", F.coalesce(slope, F.lit(0.0))).withColumn(out, F.col("_yc") - F.col("_b") * F.col("_zc")).drop("_yc", "_zc", "_b")


def freedman_lane(stack: DataFrame, design: DataFrame, item: str, x: str, z: str, y: str, by: list[str], replicates: int, block: str | None = None) -> DataFrame:
    """(perm, by, t): t of x beside a nuisance z and a constant, with the residuals of the reduced model dealt anew; perm 0 as observed.

    ``design(item, x, z, block)``: one row a recording. Fitted values of the reduced model drop out of x's slope and of the error once
    both are taken free of z, so only residuals move: t follows from sums of x, z and residuals over the recordings. Items deal within
    their block, if it is named. Edges that lack a recording have no t.
    """
    plain = residuals(residuals(design.withColumn("_one", F.lit(1)), ["_one"], x, z, "_x"), ["_one"], z, None, "_z").select(item, "_x", "_z", *([block] if block else []))
    own = residuals(stack.join(design.select(item, z), item), by, y, z, "_r").select(*by, F.col(item).alias("_from"), "_r")
    dealt = statistics.permuted(plain.withColumn("_source", F.col(item)), item, "_source", replicates, block).withColumnRenamed("_source", "_from")
    moved = own.join(dealt, "_from").join(plain.select(item, "_x", "_z"), item)
    sums = moved.groupBy("perm", *by).agg(
        F.sum(F.col("_x") * F.col("_r")).alias("xr"), F.sum(F.col("_z") * F.col("_r")).alias("zr"), F.sum("_r").alias("r"), F.sum(F.col("_r") * F.col("_r")).alias("rr"),
        F.sum(F.col("_x") * F.col("_x")).alias("xx"), F.sum(F.col("_z") * F.col("_z")).alias("zz"), F.count("*").alias("n"),
    )
    sums = sums.crossJoin(F.broadcast(design.agg(F.count("*").alias("_all")))).where("n = _all")  # one row
    free = F.col("rr") - F.col("r") * F.col("r") / F.col("n") - F.coalesce(F.col("zr") * F.col("zr") / F.nullif(F.col("zz"), F.lit(0.0)), F.lit(0.0))
    error = F.greatest(free - F.col("xr") * F.col("xr") / F.col("xx"), F.lit(0.0)) / (F.col("n") - 3)
    t = F.when(error > 0, F.col("xr") / F.col("xx") / F.sqrt(error / F.col("xx"))).otherwise(0.0)
    return sums.select("perm", *by, t.alias("t"))


def sign_flips(stack: DataFrame, item: str, y: str, by: list[str], replicates: int, on: str | None = None) -> DataFrame:
    """(perm, by, t): one-sample t with every recording's sign drawn; perm 0 as observed. ``on``: a covariate whose line is taken off first, so that residuals are tested."""
    own = residuals(stack, by, y, on, "_y") if on else stack.withColumn("_y", F.col(y))
    perms = stack.sparkSession.range(replicates + 1).withColumnRenamed("id", "perm")
    signs = stack.select(item).distinct().crossJoin(F.broadcast(perms)).withColumn("_s", F.when((F.col("perm") == 0) | (keyed(F.col("perm"), F.col(item)) % 2 == 0), 1.0).otherwise(-1.0))
    return statistics.one_sample_t(own.join(signs, item).withColumn("_v", F.col("_y") * F.col("_s")), "_v", ["perm", *by])


def over(t: Column, threshold: float, tail: str = "both") -> Column:
    """Whether t reaches the threshold in the tail: both, right or left."""
    return {"both": F.abs(t), "right": t, "left": -t}[tail] >= threshold


def significant_edges(t: DataFrame, threshold: float, replicates: int, alpha: float, tail: str = "both") -> DataFrame:
    """(i, j, component, size, p): edges of the observed components whose p = (count(null largest >= size) + 1) / (n + 1) is under alpha.

    ``t(perm, i, j, t)``; cut it first if it is dear: observed and null components both read it.
    """
    placed = placed_components(t, threshold, tail)
    sizes = placed.groupBy("perm", "component").agg(F.count("*").alias("size"))
    p = statistics.component_p(sizes, replicates).where(F.col("p") < alpha)
    return placed.where("perm = 0").join(p, "component").select(F.col("a").alias("i"), F.col("b").alias("j"), "component", "size", "p")


def placed_components(t: DataFrame, threshold: float, tail: str = "both") -> DataFrame:
    """(perm, a, b, component), a < b: links over the threshold with the component they are in, of every replicate."""
    hit = t.where(over(F.col("t"), threshold, tail)).select("perm", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).where("a <> b").distinct()
    both = hit.select("perm", F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("perm", "e.src", "e.dst")
    labels = graph.components(both, ["perm"])
    return hit.join(labels.withColumnRenamed("node", "a"), ["perm", "a"])


def intensity_p(z: DataFrame, threshold: float, replicates: int, extent: bool = False) -> DataFrame:
    """(component, size, p) of links with |z| over ``threshold`` in perm 0; size: sum of |z|, or number of links; p = count(null largest >= size) / n.

    ``z(perm, i, j, z)``.
    """
    hit = z.where(F.abs("z") > threshold).groupBy("perm", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.max(F.abs("z")).alias("z")).where("a <> b")
    both = hit.select("perm", F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("perm", "e.src", "e.dst")
    labels = graph.components(both, ["perm"])
    sizes = hit.join(labels.withColumnRenamed("node", "a"), ["perm", "a"]).groupBy("perm", "component").agg((F.count("*").cast("double") if extent else F.round(F.sum("z"), 9)).alias("size"))
    null = statistics.null_maxima(sizes, replicates)
    return sizes.where("perm = 0").join(null.select("largest"), F.col("largest") >= F.col("size"), "left").groupBy("component", "size").agg((F.count("largest") / F.lit(float(replicates))).alias("p"))


def difference_interval(subjects: DataFrame, subject: str, group: str, first: str, y: str, replicates: int, by: list[str] | None = None, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(by, lo, hi): percentile interval of the first group's mean less the other's, over keyed draws with replacement within each group."""
    by = by or []
    cell = [*by, group]
    order = Window.partitionBy(*cell).orderBy(subject)
    numbered = subjects.select(*cell, F.col(y).alias("_y"), (F.row_number().over(order) - 1).alias("_k"), F.count("*").over(Window.partitionBy(*cell)).alias("_n"))
    perms = subjects.sparkSession.range(1, replicates + 1).withColumnRenamed("id", "perm")
    draws = numbered.crossJoin(F.broadcast(perms)).select("perm", *cell, (keyed(F.col("perm"), F.col("_k")) % F.col("_n")).alias("_k"))
    means = draws.join(numbered.select(*cell, "_k", "_y"), [*cell, "_k"])
    hit = F.col(group) == first
    gap = means.groupBy("perm", *by).agg((F.avg(F.when(hit, F.col("_y"))) - F.avg(F.when(~hit, F.col("_y")))).alias("d"))
    return gap.groupBy(*by).agg(F.percentile("d", low).alias("lo"), F.percentile("d", high).alias("hi"))


def group_permutation_p(subjects: DataFrame, subject: str, group: str, first: str, y: str, by: list[str], replicates: int) -> DataFrame:
    """(by, diff, p): two-sided p of the difference of means with group labels dealt anew over the subjects, the same deal for every ``by``."""
    dealt = statistics.permuted(subjects.select(subject, group).distinct(), subject, group, replicates)
    rows = subjects.select(subject, *by, y).join(dealt, subject)
    hit = F.col(group) == first
    diff = rows.groupBy("perm", *by).agg(F.round(F.avg(F.when(hit, F.col(y))) - F.avg(F.when(~hit, F.col(y))), 9).alias("d"))
    observed = diff.where("perm = 0").select(*by, F.col("d").alias("diff"))
    return diff.where("perm > 0").join(observed, by).groupBy(*by, "diff").agg(((F.count_if(F.abs("d") >= F.abs("diff")) + 1) / F.lit(replicates + 1.0)).alias("p"))


def reference_graph(stack: DataFrame, mode: str, threshold: float | None = None, value: str = "w") -> DataFrame:
    """(i, j), i < j: links of the mean matrix that are positive, among the strongest share, or at least a value. ``mode``: positive, density, value."""
    mean = stack.where("i < j").groupBy("i", "j").agg(F.avg(value).alias("_m"))
    if mode == "positive":
        return mean.where("_m > 0").select("i", "j")
    if mode == "value":
        return mean.where(F.col("_m") >= threshold).select("i", "j")
    mean = cut(mean)  # a mean's last bits depend on the order of its sum, so that made again the least link could miss its own mean
    keep = F.greatest(F.bround(F.lit(threshold) * F.count("*")), F.lit(0)).cast("int")
    kept = mean.agg(keep.alias("k")).first()["k"]  # one number
    if not kept:
        return mean.where("false").select("i", "j")
    least = mean.orderBy(F.desc("_m")).limit(kept).agg(F.min("_m").alias("_least"))
    return mean.crossJoin(F.broadcast(least)).where("_m >= _least").select("i", "j")


@dataclass
class NetworkTest:
    """``t(i, j, t)`` as observed; ``edges(i, j, component, size, p)`` over the threshold; ``null(perm, largest)``: links of each replicate's largest component."""

    t: DataFrame
    edges: DataFrame
    null: DataFrame


def network_statistic(
    stack: DataFrame, design: DataFrame, item: str, y: str, threshold: float, replicates: int, x: str | None = None, nuisance: list[str] | None = None,
    intercept: bool = False, block: str | None = None, adjacency: DataFrame | None = None, tail: str = "both", seed: int = 2,
) -> NetworkTest:
    """Components of edges whose t reaches the threshold, with p = (count(null largest >= size) + 1) / (replicates + 1).

    ``stack(item, i, j, y)``: symmetric matrices, the upper triangle is read. ``design(item, x, nuisance, block)``: one row a recording.
    t is that of x beside the nuisances; without x, of the mean of what the nuisances leave. Replicates deal the residuals of the model
    without x among the recordings (of one block, if named), or flip signs without x; with ``adjacency(src, dst)``, every recording's
    nodes exchange labels with neighbours instead, four times a node, each recording by itself.

    Columns of the design are made orthonormal once, so that each edge needs only its products with them: nothing is solved an edge, and
    nothing comes to the driver but the number of recordings. Edges that lack a recording, or hold null or NaN, have no t. A perfect fit,
    a constant y and an x that the nuisances give have t 0. A constant x is refused.
    """
    names = [*(nuisance or []), *([x] if x else [])]
    if x is not None:
        low, high = design.agg(F.min(x), F.max(x)).first()
        if low == high:
            raise ValueError(f"{x} is constant: its effect can't be estimated")
    p = len(names) + intercept
    q = cut(statistics.orthonormal(design, item, names, intercept, [block] if block else []))
    total = q.count()
    left = range(p - 1 if x else p)
    upper = stack.where((F.col("i") < F.col("j")) & F.col(y).isNotNull() & ~F.isnan(y)).select(item, "i", "j", F.col(y).cast("double").alias("_y"))

    def reduced(rows: DataFrame, by: list[str]) -> DataFrame:
        """``rows`` of whole edges, with what the reduced model leaves."""
        w = Window.partitionBy(*by)
        rows = rows.withColumn("_n", F.count("*").over(w)).where(F.col("_n") == total)
        fitted = rows.withColumns({f"_b{k}": F.sum(F.col("_y") * F.col(f"_q{k}")).over(w) for k in left}) if left and (x or nuisance) else rows
        gone = sum((F.col(f"_b{k}") * F.col(f"_q{k}") for k in left), F.lit(0.0)) if left and (x or nuisance) else F.lit(0.0)
        return fitted.withColumn("_r", F.col("_y") - gone)

    def of_x(rows: DataFrame) -> DataFrame:
        sums = rows.groupBy("perm", "i", "j").agg(F.sum(F.col("_r") * F.col("_r")).alias("_rr"), *(F.sum(F.col("_r") * F.col(f"_q{k}")).alias(f"_a{k}") for k in range(p)))
        error = F.greatest(F.col("_rr") - sum((F.col(f"_a{k}") * F.col(f"_a{k}") for k in range(p)), F.lit(0.0)), F.lit(0.0)) / max(total - p, 1)
        return sums.select("perm", "i", "j", F.when(error > 0, F.col(f"_a{p - 1}") / F.sqrt(error)).otherwise(0.0).alias("t"))

    if adjacency is not None:
        # A chain for each replicate and recording; recordings are numbered, one row each.
        numbered = q.select(item, F.row_number().over(Window.orderBy(item)).cast("long").alias("_k"))
        chains = nulls.swapped_labels(adjacency, replicates * total, 4, seed)
        at = F.col("perm") - 1
        images = chains.select((F.floor(at / total) + 1).cast("long").alias("perm"), (at % total + 1).alias("_k"), "node", "image").join(numbered, "_k").drop("_k")
        both = upper.unionByName(upper.select(item, F.col("j").alias("i"), F.col("i").alias("j"), "_y"))
        moved = nulls.relabelled(both, images, [item], "_y")
        rows = reduced(moved.unionByName(upper.select(F.lit(0).cast("long").alias("perm"), item, "i", "j", "_y")).join(q, item), ["perm", "i", "j"])
        t = of_x(rows) if x else statistics.one_sample_t(rows, "_r", ["perm", "i", "j"])
    elif x is not None:
        own = reduced(upper.join(q, item), ["i", "j"]).select("i", "j", F.col(item).alias("_from"), "_r")
        dealt = statistics.permuted(q.withColumn("_from", F.col(item)), item, "_from", replicates, block)
        t = of_x(own.join(dealt, "_from").join(q, item))
    else:
        own = reduced(upper.join(q, item), ["i", "j"])
        t = sign_flips(own.select(item, "i", "j", "_r"), item, "_r", ["i", "j"], replicates)
    t = cut(t.withColumn("t", F.round("t", 9)))
    sizes = cut(placed_components(t, threshold, tail))
    largest = sizes.groupBy("perm", "component").agg(F.count("*").alias("size"))
    ps = statistics.component_p(largest, replicates)
    edges = sizes.where("perm = 0").join(ps, "component").select(F.col("a").alias("i"), F.col("b").alias("j"), "component", "size", "p")
    null = stack.sparkSession.range(1, replicates + 1).withColumnRenamed("id", "perm").join(largest.groupBy("perm").agg(F.max("size").alias("largest")), "perm", "left")
    return NetworkTest(t.where("perm = 0").select("i", "j", "t"), edges, null.select("perm", F.coalesce("largest", F.lit(0)).alias("largest")))


def compare_rich_club(
    stack: DataFrame, item: str, y: str, group: str, first: str, replicates: int, draws: int, least: float = 80, weight: float | None = None,
    reference: DataFrame | None = None, trim: float = 0.1,
) -> DataFrame:
    """One row for each of rich-club, feeder and peripheral links: both groups' n, mean, median and trimmed mean of the recordings' means; their
    difference with Welch's t, Cohen's d, p by t and by dealt labels, a bootstrap interval, and both q over the three classes.

    ``stack(item, group, i, j, y)``; the group not called ``first`` is the other. Links for degrees are ``reference(i, j)``, in either or
    both directions, or those of the first group's mean matrix that are positive (no ``weight``), its strongest share (below 1), or at
    least ``weight``. Hubs: degree of at least ``least``, or of the quantile 1 - ``least`` over all nodes (below 1). Recordings whose mean
    is null or NaN don't count in a class. A class that a group lacks has n 0, no values, d 0 and p 1; without any spread p by t is 1.
    """
    rows = stack.where("i < j").select(item, F.when(F.col(group) == first, "first").otherwise("other").alias("_g"), "i", "j", F.col(y).alias("w"))
    if reference is None:
        mode = "positive" if weight is None else "density" if 0 < weight < 1 else "value"
        reference = reference_graph(rows.where("_g = 'first'"), mode, weight)
    links = reference.where("i <> j").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    nodes = rows.select(F.explode(F.array("i", "j")).alias("node")).distinct().join(ends, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))
    bound = nodes.agg((F.percentile("degree", 1 - least) if 0 < least < 1 else F.lit(float(least))).alias("_least"), F.count("*").alias("_all"))
    hubs = nodes.crossJoin(F.broadcast(bound)).where("degree >= _least").select("node")  # one row is broadcast
    means = graph.rich_club_means(rows, hubs, item).join(rows.select(item, "_g").distinct(), item).where(F.col("mean").isNotNull() & ~F.isnan("mean"))
    means = cut(means.select(item, "_g", "kind", "mean"))

    def middle(side: str) -> list[Column]:
        own = F.when(F.col("_g") == side, F.col("mean"))
        listed = F.array_sort(F.collect_list(own))  # one number a recording
        n = F.size(listed)
        k = F.floor(trim * n).cast("int") if trim > 0 else F.lit(0)
        inner = F.slice(listed, k + 1, F.greatest(n - 2 * k, F.lit(1)))
        trimmed = F.aggregate(inner, F.lit(0.0), lambda s, v: s + v) / F.size(inner)
        return [F.count(own).alias(f"n_{side}"), F.avg(own).alias(f"mean_{side}"), F.median(own).alias(f"median_{side}"), F.when((2 * k >= n) | F.lit(trim >= 0.5), F.median(own)).otherwise(trimmed).alias(f"trimmed_{side}")]

    kinds = stack.sparkSession.range(1).select(F.explode(F.array(*(F.lit(k) for k in ("rich-club", "feeder", "peripheral")))).alias("kind"))
    sides = means.groupBy("kind").agg(*middle("first"), *middle("other"))
    gaps = statistics.two_groups(means, "_g", "first", "other", "mean", ["kind"])
    gaps = gaps.select("kind", "diff", "t", "d", F.when(F.col("t").isNotNull(), statistics.student_p_column("t", "df")).alias("p_t"))
    dealt = group_permutation_p(means, item, "_g", "first", "mean", ["kind"], replicates).where("diff is not null").select("kind", F.col("p").alias("p_perm"))
    spread = difference_interval(means, item, "_g", "first", "mean", draws, ["kind"])
    whole = kinds.join(sides, "kind", "left").join(gaps, "kind", "left").join(dealt, "kind", "left").join(spread, "kind", "left")
    both = (F.coalesce("n_first", F.lit(0)) > 0) & (F.coalesce("n_other", F.lit(0)) > 0)
    filled = whole.withColumns({
        "n_first": F.coalesce("n_first", F.lit(0)), "n_other": F.coalesce("n_other", F.lit(0)), "d": F.when(both, F.col("d")).otherwise(0.0),
        "p_t": F.when(F.col("p_t").isNull() | F.isnan("p_t"), 1.0).otherwise(F.col("p_t")), "p_perm": F.coalesce("p_perm", F.lit(1.0)),
    })
    return statistics.bh_fdr(statistics.bh_fdr(filled, "p_t", ["kind"]).withColumnRenamed("q", "q_t"), "p_perm", ["kind"]).withColumnRenamed("q", "q_perm")
