"""Tests and permutation inference over edge-long frames. Replicates are rows, never driver loops."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import keyed
from . import graph
from .similarity import guarded_corr


def fisher_z(r: Column) -> Column:
    return F.atanh(F.least(F.greatest(r, F.lit(-0.999999)), F.lit(0.999999)))


def slope_t(stack: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """(by, t, n): t of the slope of y on x with an intercept, n - 2 degrees of freedom; 0 where either is constant."""
    sums = stack.groupBy(*by).agg(guarded_corr(x, y).alias("_r"), F.stddev_pop(x).alias("_sx"), F.stddev_pop(y).alias("_sy"), F.count("*").alias("n"))
    ok = (F.col("_sx") > 0) & (F.col("_sy") > 0) & (F.col("n") > 2)
    r = F.col("_r")
    t = F.when(ok, r * F.sqrt((F.col("n") - 2) / F.nullif(1 - r * r, F.lit(0.0)))).otherwise(0.0)
    return sums.select(*by, t.alias("t"), "n")


def one_sample_t(stack: DataFrame, y: str, by: list[str]) -> DataFrame:
    sd = F.stddev_samp(y)
    return stack.groupBy(*by).agg(F.when(sd > 0, F.avg(y) / (sd / F.sqrt(F.count(y)))).otherwise(0.0).alias("t"))


def orthonormal(design: DataFrame, item: str, names: list[str], intercept: bool = False, keep: list[str] | None = None) -> DataFrame:
    """(item, keep, _q0, _q1, ...): a constant, if wanted, and the named columns, each freed of those before it and of unit length.

    One aggregate gives all products of columns, eliminated in expressions; a second pass takes off what rounding left. A column that those
    before it give is 0. Rows with a null among the names have null columns.
    """
    parts = [*([F.lit(1.0)] if intercept else []), *(F.col(n).cast("double") for n in names)]
    p = len(parts)
    out = design.select(item, *(keep or []), *(c.alias(f"_q{k}") for k, c in enumerate(parts)))
    for _ in range(2 if p else 0):
        s = out.agg(*(F.sum(F.col(f"_q{a}") * F.col(f"_q{b}")).alias(f"_s{a}_{b}") for a in range(p) for b in range(a, p)))
        s = s.withColumns({f"_o{k}": F.col(f"_s{k}_{k}") for k in range(p)})
        for k in range(p):
            live = F.col(f"_s{k}_{k}") > 1e-13 * F.col(f"_o{k}")
            s = s.withColumns({f"_d{k}": F.when(live, F.sqrt(f"_s{k}_{k}")), **{f"_l{j}_{k}": F.when(live, F.col(f"_s{k}_{j}") / F.col(f"_s{k}_{k}")).otherwise(0.0) for j in range(k + 1, p)}})
            if k + 1 < p:
                s = s.withColumns({f"_s{i}_{j}": F.col(f"_s{i}_{j}") - F.col(f"_l{i}_{k}") * F.col(f"_s{k}_{j}") for i in range(k + 1, p) for j in range(i, p)})
        columns = out.columns
        rows = out.crossJoin(F.broadcast(s.select(*(f"_d{k}" for k in range(p)), *(f"_l{j}_{k}" for k in range(p) for j in range(k + 1, p)))))  # one row
        for j in range(1, p):
            rows = rows.withColumn(f"_q{j}", F.col(f"_q{j}") - sum((F.col(f"_l{j}_{k}") * F.col(f"_q{k}") for k in range(j)), F.lit(0.0)))
        out = rows.withColumns({f"_q{k}": F.when(F.col(f"_d{k}").isNull(), 0.0).otherwise(F.col(f"_q{k}") / F.col(f"_d{k}")) for k in range(p)}).select(*columns)
    return out


def several_regressors_t(stack: DataFrame, by: list[str], y: str, design: DataFrame, on: str, names: list[str], wanted: str) -> DataFrame:
    """(by, t) of one of several regressors with an intercept; edges that lack a recording are left out. Columns that others give take no degree of freedom."""
    order = [*(n for n in names if n != wanted), wanted]
    q = orthonormal(design, on, order, True)
    a = range(len(order) + 1)
    size = q.agg(F.count("*").alias("_all"), sum((F.max(F.when(F.col(f"_q{k}") != 0, 1).otherwise(0)) for k in a), F.lit(0)).alias("_rank"))
    sums = stack.join(q, on).groupBy(*by).agg(F.count(y).alias("n"), F.sum(F.col(y) * F.col(y)).alias("_yy"), *(F.sum(F.col(y) * F.col(f"_q{k}")).alias(f"_a{k}") for k in a))
    whole = sums.crossJoin(F.broadcast(size)).where("n = _all")  # one row
    explained = sum((F.col(f"_a{k}") * F.col(f"_a{k}") for k in a), F.lit(0.0))
    error = F.greatest(F.col("_yy") - explained, F.lit(0.0)) / (F.col("_all") - F.col("_rank"))
    return whole.select(*by, F.when(error > 0, F.col(f"_a{a[-1]}") / F.sqrt(error)).otherwise(0.0).alias("t"))


def permuted(items: DataFrame, item: str, value: str, replicates: int, block: str | None = None) -> DataFrame:
    """(perm, item, value): replicate 0 as observed, the others with values dealt anew (within blocks, if named)."""
    parts = [block] if block else []
    order = Window.partitionBy(*parts).orderBy(item) if parts else Window.orderBy(item)
    numbered = items.select(item, *parts, F.col(value).alias("_v"), F.row_number().over(order).alias("_slot"))  # one row a recording
    perms = items.sparkSession.range(replicates + 1).withColumnRenamed("id", "perm")
    rolled = perms.crossJoin(F.broadcast(numbered.select(item, *parts)))
    key = F.when(F.col("perm") == 0, F.lit(0)).otherwise(keyed(F.col("perm"), F.col(item)))
    slots = rolled.withColumn("_slot", F.row_number().over(Window.partitionBy("perm", *parts).orderBy(key, item)))
    return slots.join(F.broadcast(numbered.select(*parts, "_slot", "_v")), [*parts, "_slot"]).select("perm", item, F.col("_v").alias(value))


def components_by_permutation(t: DataFrame, threshold: float) -> DataFrame:
    """(perm, component, size): edges of each component of the links with |t| >= threshold, all permutations at once."""
    hit = t.where(F.abs("t") >= threshold).select("perm", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).where("a <> b").distinct()
    both = hit.select("perm", F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("perm", "e.src", "e.dst")
    labels = graph.components(both, ["perm"])
    return hit.join(labels.withColumnRenamed("node", "a"), ["perm", "a"]).groupBy("perm", "component").agg(F.count("*").alias("size"))


def component_intensity(z: DataFrame) -> DataFrame:
    """(component, extent, intensity) of links (i, j, z) as given: links, and the sum of their absolute z."""
    hit = z.groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.max(F.abs("z")).alias("z"))
    both = hit.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("e.src", "e.dst")
    labels = graph.components(both)
    return hit.join(labels.withColumnRenamed("node", "a"), "a").groupBy("component").agg(F.count("*").alias("extent"), F.sum("z").alias("intensity"))


def null_maxima(sizes: DataFrame, replicates: int) -> DataFrame:
    """(perm, largest): 0 where a replicate has no component."""
    most = sizes.where("perm > 0").groupBy("perm").agg(F.max("size").alias("largest"))
    return sizes.sparkSession.range(1, replicates + 1).withColumnRenamed("id", "perm").join(most, "perm", "left").select("perm", F.coalesce("largest", F.lit(0)).alias("largest"))


def component_p(sizes: DataFrame, replicates: int) -> DataFrame:
    """(component, size, p) of the observed components: (count(null >= size) + 1) / (n + 1)."""
    null = null_maxima(sizes, replicates)
    return sizes.where("perm = 0").join(null.select("largest"), F.col("largest") >= F.col("size"), "left").groupBy("component", "size").agg(((F.count("largest") + 1) / F.lit(replicates + 1.0)).alias("p"))


def two_groups(values: DataFrame, group: str, first: str, second: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Welch t, its degrees of freedom, Cohen's d and the mean difference of two groups."""
    a, b = F.when(F.col(group) == first, F.col(y)), F.when(F.col(group) == second, F.col(y))
    s = values.groupBy(*(by or [])).agg(F.count(a).alias("na"), F.count(b).alias("nb"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"))
    ea, eb = F.col("va") / F.col("na"), F.col("vb") / F.col("nb")
    pooled = F.sqrt(((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / (F.col("na") + F.col("nb") - 2))
    gap = F.col("ma") - F.col("mb")
    return s.select(
        *(by or []),
        gap.alias("diff"),
        F.when(ea + eb > 0, gap / F.sqrt(ea + eb)).alias("t"),
        (F.pow(ea + eb, 2) / (ea * ea / (F.col("na") - 1) + eb * eb / (F.col("nb") - 1))).alias("df"),
        F.when(pooled == 0, 0.0).otherwise(gap / F.nullif(pooled, F.lit(0.0))).alias("d"),
    )


def permutation_p(subjects: DataFrame, subject: str, group: str, first: str, y: str, replicates: int) -> DataFrame:
    """Two-sided p of a difference of means over ``subjects`` (one row each, some hundreds): (count(|null| >= |observed|) + 1) / (n + 1)."""
    dealt = permuted(subjects, subject, group, replicates).join(subjects.select(subject, y), subject)
    hit = F.col(group) == first
    diff = dealt.groupBy("perm").agg(F.round(F.avg(F.when(hit, F.col(y))) - F.avg(F.when(~hit, F.col(y))), 9).alias("diff"))
    observed = diff.where("perm = 0").select(F.col("diff").alias("observed"))
    return diff.where("perm > 0").crossJoin(F.broadcast(observed)).groupBy("observed").agg(((F.count_if(F.abs("diff") >= F.abs("observed")) + 1) / F.lit(replicates + 1.0)).alias("p"))


def bootstrap_interval(subjects: DataFrame, subject: str, group: str, y: str, replicates: int, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(group, lo, hi): percentile interval of each group's mean over keyed draws with replacement."""
    order = Window.partitionBy(group).orderBy(subject)
    numbered = subjects.select(group, F.col(y).alias("_y"), (F.row_number().over(order) - 1).alias("_k"), F.count("*").over(Window.partitionBy(group)).alias("_n"))
    draws = numbered.crossJoin(subjects.sparkSession.range(1, replicates + 1).withColumnRenamed("id", "perm")).select("perm", group, (keyed(F.col("perm"), F.col("_k")) % F.col("_n")).alias("_k"))
    means = draws.join(numbered.select(group, "_k", "_y"), [group, "_k"]).groupBy("perm", group).agg(F.avg("_y").alias("m"))
    return means.groupBy(group).agg(F.percentile("m", low).alias("lo"), F.percentile("m", high).alias("hi"))


def bh_fdr(tests: DataFrame, p: str, order: list[str], by: list[str] | None = None) -> DataFrame:
    """q of Benjamini and Hochberg: p * m / rank, then the running least from the largest p. One row a test."""
    parts = by or []
    up = (Window.partitionBy(*parts) if parts else Window.partitionBy(F.lit(0))).orderBy(p, *order)
    down = (Window.partitionBy(*parts) if parts else Window.partitionBy(F.lit(0))).orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)
    m = F.count("*").over(Window.partitionBy(*parts) if parts else Window.partitionBy(F.lit(0)))
    ranked = tests.withColumn("_rank", F.row_number().over(up)).withColumn("_m", m)
    return ranked.withColumn("q", F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_rank")).over(down))).drop("_rank", "_m")


def zscore(values: DataFrame, by: list[str], value: str, out: str = "z") -> DataFrame:
    w = Window.partitionBy(*by)
    return values.withColumn(out, (F.col(value) - F.avg(value).over(w)) / F.nullif(F.stddev_pop(value).over(w), F.lit(0.0)))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    tiny, c = 1e-300, 1.0
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return h


def student_p(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    if not math.isfinite(t) or not df > 0:
        return 0.0 if math.isinf(t) else math.nan
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    if x >= 1.0:
        return 1.0
    if x <= 0.0:
        return 0.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def student_p_column(t: str | Column, df: str | Column) -> Column:
    """The tail isn't among Spark's functions; rows come in Arrow batches."""

    @F.pandas_udf("double")
    def tail(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([math.nan if x is None or y is None or x != x else student_p(x, y) for x, y in zip(a, b, strict=True)])

    return tail(t, df)
