"""Similarity matrices as edge lists (i, j, r), i <= j. Pairs come from an equi-join on the sampled keys, so only their products are shuffled."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import ROWS_A_TASK, cut, dealt
from ..functions.numbering import summed_before


def average_rank(df: DataFrame, by: list[str], value: str, out: str = "rnk") -> DataFrame:
    """Ranks from 1 within ``by``; equal values share the mean of their ranks."""
    rank = F.rank().over(Window.partitionBy(*by).orderBy(value))
    ties = F.count("*").over(Window.partitionBy(*by, value))
    return df.withColumn(out, rank + (ties - 1) / F.lit(2.0))


def ranked_by_ranges(df: DataFrame, by: list[str], value: str, out: str, rows: int) -> DataFrame:
    """``average_rank`` of groups too large for a task: equal values are counted, counts summed by ranges, and ranks joined to the rows."""
    counts = cut(df.groupBy(*by, value).agg(F.count("*").alias("_c")))
    ranks = summed_before(counts, by, value, "_c", "_k", counts.count()).withColumn("_rank", F.col("_k") + (F.col("_c") + 1) / F.lit(2.0))
    met = df.alias("a").join(ranks.alias("r"), [F.col(f"a.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*by, value]])
    return met.select("a.*", F.col("_rank").alias(out))


def paired(df: DataFrame, node: str, keys: list[str], value: str) -> DataFrame:
    """(i, j, keys, va, vb) for nodes i <= j that share keys."""
    a = df.select(F.col(node).alias("i"), *keys, F.col(value).alias("va"))
    b = df.select(F.col(node).alias("j"), *keys, F.col(value).alias("vb"))
    return a.join(b, keys).where("i <= j")


def guarded_corr(a: str = "va", b: str = "vb") -> Column:
    """Correlation; null where either side is constant (where Spark's own would fail)."""
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def pearson(df: DataFrame, node: str, keys: list[str], value: str, by: list[str] | None = None) -> DataFrame:
    """(by, i, j, r, n). ``by``: keys that stay apart, such as recordings."""
    by = by or []
    return paired(df, node, keys + by, value).groupBy(*by, "i", "j").agg(guarded_corr().alias("r"), F.count("*").alias("n"))


def spearman(df: DataFrame, node: str, keys: list[str], value: str, by: list[str] | None = None) -> DataFrame:
    by = by or []
    return pearson(average_rank(df, [*by, node], value), node, keys, "rnk", by)


def t_value(r: Column, n: Column) -> Column:
    """t of a correlation, with n - 2 degrees of freedom."""
    return r * F.sqrt((n - 2) / F.nullif(1 - r * r, F.lit(0.0)))


def gaussian_affinity(df: DataFrame, node: str, keys: list[str], value: str) -> DataFrame:
    """exp(-d2 / (2 s^2)) of profiles, s the median of the positive distances (1 if there is none)."""
    d2 = paired(df, node, keys, value).groupBy("i", "j").agg(F.sum(F.pow(F.col("va") - F.col("vb"), 2)).alias("d2"))
    s = d2.where("i < j and d2 > 0").agg(F.coalesce(F.percentile(F.sqrt("d2"), 0.5), F.lit(1.0)).alias("s"))
    return d2.crossJoin(F.broadcast(s)).select("i", "j", F.exp(-F.col("d2") / (2 * F.col("s") * F.col("s"))).alias("r"))  # one row is broadcast


def mutual_information(df: DataFrame, node: str, keys: list[str], value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Mutual information (natural) of two nodes' values, from a joint histogram of fixed range."""
    cell = lambda c: F.greatest(F.lit(0), F.least(F.floor((F.col(c) - lo) / (hi - lo) * bins), F.lit(bins - 1)))
    joint = paired(df, node, keys, value).groupBy("i", "j", cell("va").alias("a"), cell("vb").alias("b")).agg(F.count("*").alias("c"))
    w = Window.partitionBy("i", "j")
    n, ca, cb = F.sum("c").over(w), F.sum("c").over(Window.partitionBy("i", "j", "a")), F.sum("c").over(Window.partitionBy("i", "j", "b"))
    terms = joint.withColumn("mi", F.col("c") / n * F.ln(F.col("c") * n / (ca * cb)))
    return terms.groupBy("i", "j").agg(F.sum("mi").alias("r"))


def leave_one_out(df: DataFrame, node: str, drop: str, keys: list[str], value: str) -> DataFrame:
    """(dropped, i, j, r): Spearman matrices without each value of ``drop`` in turn."""
    dropped = df.select(F.col(drop).alias("dropped")).distinct()
    kept = df.join(F.broadcast(dropped), F.col(drop) != F.col("dropped"))  # a few metabolites
    return spearman(kept, node, [drop, *keys], value, by=["dropped"])


def thresholded(sim: DataFrame, least_t: float) -> DataFrame:
    """r where its |t| reaches ``least_t``, else 0."""
    return sim.withColumn("r", F.when((F.abs("r") >= 1) | (F.abs(t_value(F.col("r"), F.col("n"))) >= least_t), F.col("r")).otherwise(0.0))


def quadratic_rho(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, rho, p, n): Spearman of squared x with what a straight line leaves of y, and its two-sided p; both are null where a side is constant."""
    fit = df.groupBy(*by).agg(F.regr_slope(y, x).alias("_s"), F.regr_intercept(y, x).alias("_i"))
    rest = df.join(fit, by).withColumn("_x2", F.round(F.col(x) * F.col(x), 6)).withColumn("_res", F.round(F.col(y) - F.col("_s") * F.col(x) - F.col("_i"), 6))
    rest = cut(rest.select(*by, "_x2", "_res"))
    rows = rest.count()
    ranked = ranked_by_ranges(ranked_by_ranges(rest, by, "_x2", "_ra", rows), by, "_res", "_rb", rows)
    found = p_of(ranked.groupBy(*by).agg(guarded_corr("_ra", "_rb").alias("r"), F.count("*").alias("n")))
    return found.select(*by, F.col("r").alias("rho"), F.when(F.col("r").isNotNull(), F.col("p")).alias("p"), "n")


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(df: DataFrame, node: str, keys: list[str], value: str) -> DataFrame:
    """(i, j, r) of nodes i < j: cosine of their values over the keys both have."""
    a, b = F.col("va"), F.col("vb")
    norm = F.sqrt(F.sum(a * a)) * F.sqrt(F.sum(b * b))
    return paired(df, node, keys, value).where("i < j").groupBy("i", "j").agg((F.sum(a * b) / F.nullif(norm, F.lit(0.0))).alias("r"))


#: Sides of a tile of queries by points.
_QUERIES, _POINTS = 2048, 4096


def _near_in_blocks(batches: Iterator[pa.RecordBatch], k: int, slack: float) -> Iterator[pa.RecordBatch]:
    """Of each tile the points that may be among a query's k nearest: all whose distance is within rounding of the k-th."""
    for batch in batches:
        for t in range(batch.num_rows):
            ids, js = batch["_is"][t].values, batch["_js"][t].values
            left, right = batch["_as"][t].values, batch["_bs"][t].values
            x, y = (np.asarray(v.flatten()).reshape(len(v), -1) for v in (left, right))
            squares = (x * x).sum(1)[:, None] + (y * y).sum(1)
            d2 = np.maximum(squares - 2 * x @ y.T, 0)
            kth = np.partition(d2, min(k, len(js)) - 1, axis=1)[:, min(k, len(js)) - 1]
            # The product's error is far below 1e-9 of the squares; the rounded distances of the rest are worked out exactly afterwards.
            least = np.square(np.sqrt(kth) + slack)[:, None] + 1e-9 * squares + slack * slack
            q, p = np.nonzero(~(d2 > least))
            q, p = pa.array(q), pa.array(p)
            yield pa.RecordBatch.from_arrays([ids.take(q), left.take(q), js.take(p), right.take(p)], names=["i", "_a", "j", "_b"])


def nearest_edges(queries: DataFrame, points: DataFrame, node: str, vector: str, k: int, digits: int = 9) -> DataFrame:
    """(i, j, rank, w): each query's k nearest points (itself first), weight exp(-distance). ``queries`` is a stated set.

    Pairs grow with queries times points; tiles of some thousand by some thousand are multiplied apart, and distances worked out for the few
    that may be near. Vectors that are null take no part; the others are equally long.
    """
    a = queries.select(F.col(node).alias("i"), F.col(vector).alias("_a"))
    b = points.select(F.col(node).alias("j"), F.col(vector).alias("_b"))
    a, b = a.where("_a is not null"), b.where("_b is not null")
    kind = {n: t for n, t in (*a.dtypes, *b.dtypes)}
    left, right = max(1, -(-a.count() // _QUERIES)), max(1, -(-b.count() // _POINTS))
    blocks = a.groupBy((F.hash("i") % left).alias("_block")).agg(F.collect_list("i").alias("_is"), F.collect_list("_a").alias("_as"))
    parts = b.groupBy((F.hash("j") % right).alias("_part")).agg(F.collect_list("j").alias("_js"), F.collect_list("_b").alias("_bs"))
    close = partial(_near_in_blocks, k=k, slack=2 * 10.0**-digits)
    tiles = dealt(blocks.crossJoin(parts), 4 * left * right * ROWS_A_TASK, "_block", "_part")  # about a tile a task, as the remainders have either sign
    some = tiles.mapInArrow(close, f"i {kind['i']}, _a array<double>, j {kind['j']}, _b array<double>")
    gap = F.zip_with("_a", "_b", lambda x, y: x - y)
    d = F.round(F.sqrt(dot(gap, gap)), digits)
    best = some.withColumn("d", d).withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))).where(F.col("rank") <= k)
    return best.select("i", "j", "rank", F.exp(-F.col("d")).alias("w"))


def p_of(sim: DataFrame) -> DataFrame:
    """(.., r, n) with p: two-sided, of t = r sqrt((n - 2) / (1 - r^2)) with n - 2 degrees of freedom; 0 for |r| = 1."""
    from .statistics import student_p_column

    t = F.when(F.abs("r") >= 1, F.lit(float("inf"))).otherwise(t_value(F.col("r"), F.col("n")))
    return sim.withColumn("p", student_p_column(t, (F.col("n") - 2).cast("double")))


def with_p(df: DataFrame, node: str, keys: list[str], value: str, mode: str = "spearman", ignored: list | None = None) -> DataFrame:
    """(i, j, r, n, p, valid): similarity matrix with p in one plan.

    A pair isn't valid if one of its nodes is ignored, has a null or NaN mean, or sums to 0, or if a side is constant; then r and p are 0.
    """
    v = F.col(value)
    sound = df.groupBy(node).agg((F.count_if(v.isNull() | F.isnan(v)) == 0).alias("_whole"), F.sum(F.nanvl(v, F.lit(0.0))).alias("_sum"))
    sound = sound.select(node, (F.col("_whole") & (F.col("_sum") != 0) & (~F.col(node).isin(ignored) if ignored else F.lit(True))).alias("_ok"))
    clean = df.withColumn(value, F.when(F.isnan(v), None).otherwise(v)).where(F.col(value).isNotNull())
    sim = (spearman if mode == "spearman" else pearson)(clean, node, keys, value)
    both = sim.join(sound.select(F.col(node).alias("i"), F.col("_ok").alias("_a")), "i").join(sound.select(F.col(node).alias("j"), F.col("_ok").alias("_b")), "j")
    valid = F.col("_a") & F.col("_b") & F.col("r").isNotNull()
    found = p_of(both.withColumn("valid", valid).withColumn("r", F.when(valid, F.col("r")).otherwise(0.0)))
    return found.select("i", "j", "r", "n", F.when(F.col("valid"), F.col("p")).otherwise(0.0).alias("p"), "valid")


def kept_by_p(sim: DataFrame, alpha: float, draws: int) -> DataFrame:
    """r where p is at most alpha / draws, else 0."""
    return sim.withColumn("r", F.when(F.col("p") > alpha / draws, 0.0).otherwise(F.col("r")))
