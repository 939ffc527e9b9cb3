"""Parcel-level aggregation of voxel values. Keys are columns; nothing depends on row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.numbering import summed_before


def no_nan(c: str | Column) -> Column:
    """NaN as null, where a mean is to skip it."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def parcel_mean(values: DataFrame, keys: list[str], value: str, header: DataFrame | None = None, out: str = "mean") -> DataFrame:
    """Mean of each key's values without NaN. With a ``header`` of wanted keys, those without any row get 0."""
    found = values.groupBy(*keys).agg(F.avg(no_nan(value)).alias(out), F.count("*").alias("_n"))
    if header is None:
        return found.drop("_n")
    return header.join(found, [k for k in keys if k in header.columns], "left").withColumn(out, F.when(F.col("_n").isNull(), 0.0).otherwise(F.col(out))).drop("_n")


def rescaled(values: DataFrame, by: list[str], value: str, how: str) -> DataFrame:
    """``mean``: divided by the group's mean (1 if 0); ``zscore``: population z, untouched if mean or deviation is 0; ``raw``: as is."""
    w = Window.partitionBy(*by)
    mean, sd, v = F.avg(value).over(w), F.stddev_pop(value).over(w), F.col(value)
    if how == "raw":
        return values
    if how == "mean":
        return values.withColumn(value, v / F.when(mean == 0, 1.0).otherwise(mean))
    if how == "zscore":
        return values.withColumn(value, F.when((mean == 0) | (sd == 0), v).otherwise((v - mean) / sd))
    raise ValueError(f"unknown rescaling {how!r}")


def coverage(voxels: DataFrame, label: str, inside: str) -> DataFrame:
    """(label, n, share): voxels of each label, and the share of them inside a mask."""
    return voxels.groupBy(label).agg(F.count("*").alias("n"), F.avg(F.col(inside).cast("double")).alias("share"))


def voxel_counts(voxels: DataFrame, label: str, first: str, second: str) -> DataFrame:
    """Voxels of each label inside two masks, and the ratio (null if the second holds none)."""
    a, b = F.count_if(F.col(first)), F.count_if(F.col(second))
    return voxels.groupBy(label).agg(a.alias("n_first"), b.alias("n_second"), F.try_divide(a.cast("double"), b.cast("double")).alias("ratio"))


def quality_mask(voxels: DataFrame, keys: list[str], good: Column, alpha: float) -> DataFrame:
    """Share of recordings in which a voxel is good, and whether it exceeds ``alpha``."""
    share = F.avg(good.cast("double"))
    return voxels.groupBy(*keys).agg(share.alias("share")).withColumn("flag", (F.col("share") > alpha).cast("int"))


def centroids(voxels: DataFrame, label: str, background: int | None = 0, affine: list[list[float]] | None = None) -> DataFrame:
    """Mean coordinates of each label, through an index-to-world affine if there is one."""
    rows = voxels if background is None else voxels.where(F.col(label) != background)
    c = rows.groupBy(label).agg(*(F.avg(a).alias(a) for a in "xyz"))
    if affine is None:
        return c
    return c.select(label, *((sum((F.col(a) * float(affine[r][k]) for k, a in enumerate("xyz")), F.lit(float(affine[r][3])))).alias("xyz"[r]) for r in range(3)))


def distances(points: DataFrame, label: str, dims: str = "xyz") -> DataFrame:
    """(i, j, d) of labels i < j: as many rows as pairs of labels, which atlases keep to some hundreds."""
    a = points.select(F.col(label).alias("i"), *(F.col(d).alias(f"_{d}a") for d in dims))
    b = points.select(F.col(label).alias("j"), *(F.col(d).alias(f"_{d}b") for d in dims))
    squares = sum((F.pow(F.col(f"_{d}a") - F.col(f"_{d}b"), 2) for d in dims), F.lit(0.0))
    return a.join(b, F.col("i") < F.col("j")).select("i", "j", F.sqrt(squares).alias("d"))


def trimmed_mean(values: DataFrame, by: list[str], value: str, share: float) -> DataFrame:
    """Mean without floor(share * n) values at each end; the median where nothing is left. Null values come first and count for n.

    Equal values are counted first, and running counts are summed by ranges, so no task holds a group's rows.
    """
    counts = cut(values.groupBy(*by, value).agg(F.count("*").alias("_c")))
    placed = summed_before(counts, by, value, "_c", "_k", counts.count())
    total = counts.groupBy(*by).agg(F.sum("_c").alias("_n"), F.coalesce(F.sum(F.when(F.col(value).isNull(), F.col("_c"))), F.lit(0)).alias("_nulls"))
    rows = placed.alias("a").join(total.alias("t"), [F.col(f"a.{c}").eqNullSafe(F.col(f"t.{c}")) for c in by]).select("a.*", "_n", "_nulls")
    ends = F.floor(F.lit(share) * F.col("_n"))
    inside = F.greatest(F.least(F.col("_k") + F.col("_c"), F.col("_n") - ends) - F.greatest(F.col("_k"), ends), F.lit(0))
    known = F.when(F.col(value).isNotNull(), inside)
    core = F.sum(F.when(inside > 0, F.col(value) * inside)) / F.nullif(F.sum(known), F.lit(0))
    bare = (2 * ends >= F.col("_n")) | (F.col("_nulls") >= F.col("_n") - ends)
    return rows.groupBy(*by).agg(F.coalesce(core, F.percentile(F.when(bare, F.col(value)), 0.5, F.col("_c"))).alias("trimmed"))


def percentile_of_positives(values: DataFrame, by: list[str], value: str, percent: float) -> DataFrame:
    return values.groupBy(*by).agg(F.percentile(F.when(F.col(value) > 0, F.col(value)), percent / 100).alias("threshold"))


def binned_profile(values: DataFrame, bins: DataFrame, at: str, value: str, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Median and two percentiles of the values whose ``at`` lies strictly within (lo, hi) of each of ``bins(bin, lo, hi)``."""
    inside = values.join(F.broadcast(bins), (F.col(at) > F.col("lo")) & (F.col(at) < F.col("hi")))  # bins are a handful of literals
    return inside.groupBy("bin").agg(F.percentile(value, 0.5).alias("med"), F.percentile(value, low).alias("p_lo"), F.percentile(value, high).alias("p_hi"))


def histogram_entropy(values: DataFrame, by: list[str], value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Shannon entropy (natural, as a share of ln(bins)) of a histogram of fixed range; the last bin holds its right edge."""
    b = F.least(F.floor((F.col(value) - lo) / (hi - lo) * bins), F.lit(bins - 1))
    counts = values.where(F.col(value).between(lo, hi)).groupBy(*by, b.alias("_bin")).count()
    p = F.col("count") / F.sum("count").over(Window.partitionBy(*by))
    return counts.withColumn("_p", p).groupBy(*by).agg((-F.sum(F.col("_p") * F.ln("_p")) / F.ln(F.lit(float(bins)))).alias("entropy"))


def nonzero_mean(values: DataFrame, by: list[str], value: str) -> DataFrame:
    return values.groupBy(*by).agg(F.coalesce(F.avg(F.when(F.col(value) != 0, F.col(value))), F.lit(0.0)).alias("mean"))
