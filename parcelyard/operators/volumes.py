"""Voxel lattices as (x, y, z, value) rows. Neighbourhoods are equi-joins on shifted coordinates, split by slab when Spark shuffles."""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import normal

XYZ = ["x", "y", "z"]


def perturbed(volume: DataFrame, value: str, crlb: str, keys: list[str], item: str, draws: int, scale: float = 1.0) -> DataFrame:
    """(.., pert, value): keyed Gaussian noise of value * crlb / 100 * scale, clipped to [0, mean + 3 sd] of each of ``keys``."""
    w = Window.partitionBy(*keys)
    v = F.coalesce(F.when(~F.isnan(value), F.col(value)), F.lit(0.0))
    sd = F.greatest(v * F.coalesce(F.when(~F.isnan(crlb), F.col(crlb)), F.lit(0.0)) / 100 * scale, F.lit(0.0))
    bounded = volume.withColumn("_v", v).withColumn("_sd", sd).withColumn("_top", F.avg(v).over(w) + 3 * F.stddev_pop(v).over(w))
    drawn = bounded.crossJoin(volume.sparkSession.range(draws).withColumnRenamed("id", "pert"))
    noisy = F.col("_v") + F.col("_sd") * normal(F.col("pert"), F.col(item))
    return drawn.withColumn(value, F.greatest(F.lit(0.0), F.least(noisy, F.col("_top")))).drop("_v", "_sd", "_top")


def neighbours(points: DataFrame, offsets: list[tuple[int, int, int]]) -> DataFrame:
    """(x, y, z of the centre, and the columns of a neighbour as they are), one row a neighbour that exists."""
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a, b, c in offsets))
    others = [c for c in points.columns if c not in XYZ]
    return points.select(*XYZ, *others, F.explode(steps).alias("_s")).select((F.col("x") + F.col("_s.a")).alias("x"), (F.col("y") + F.col("_s.b")).alias("y"), (F.col("z") + F.col("_s.c")).alias("z"), *others)


FACES = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
AROUND = [o for o in product((-1, 0, 1), repeat=3) if o != (0, 0, 0)]


def holes(mask: DataFrame, flag: str) -> DataFrame:
    """(x, y, z) of unset points all six of whose neighbours are set."""
    ones = neighbours(mask.where(F.col(flag)).select(*XYZ), FACES).groupBy(*XYZ).agg(F.count("*").alias("_n")).where("_n = 6")
    return mask.where(~F.col(flag)).select(*XYZ).join(ones, XYZ, "left_semi")


def median_inpainted(volume: DataFrame, where: DataFrame, value: str) -> DataFrame:
    """``volume`` with the median of the 26 points around in place of the values at ``where``. Beyond its borders the volume is mirrored at its outermost points."""
    ends = volume.agg(*(f(a).alias(f"_{n}{a}") for a in XYZ for n, f in (("lo", F.min), ("hi", F.max))))
    wanted = neighbours(where.select(*XYZ).distinct().withColumns({f"_c{a}": F.col(a) for a in XYZ}), AROUND).crossJoin(F.broadcast(ends))  # one row is broadcast
    inside = {a: F.when(F.col(a) < F.col(f"_lo{a}"), 2 * F.col(f"_lo{a}") - F.col(a)).when(F.col(a) > F.col(f"_hi{a}"), 2 * F.col(f"_hi{a}") - F.col(a)).otherwise(F.col(a)) for a in XYZ}
    med = wanted.withColumns(inside).join(volume.select(*XYZ, value), XYZ).groupBy(*(f"_c{a}" for a in XYZ)).agg(F.percentile(value, 0.5).alias("_med"))
    med = med.withColumnsRenamed({f"_c{a}": a for a in XYZ})
    return volume.join(med, XYZ, "left").withColumn(value, F.coalesce("_med", value)).drop("_med")


def smoothed(volume: DataFrame, value: str, fwhm: float) -> DataFrame:
    """Separable Gaussian smoothing to four deviations, an axis at a time; weights are renormalised where neighbours are missing."""
    sigma = fwhm / (2 * math.sqrt(2 * math.log(2)))
    reach = int(4 * sigma + 0.5)
    out = volume.select(*XYZ, value)
    for axis in XYZ:
        taps = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(math.exp(-(k * k) / (2 * sigma * sigma))).alias("g")) for k in range(-reach, reach + 1)))
        spread = out.withColumn("_t", F.explode(taps)).withColumn(axis, F.col(axis) + F.col("_t.k"))
        summed = spread.groupBy(*XYZ).agg((F.sum(F.col(value) * F.col("_t.g")) / F.sum("_t.g")).alias(value))
        out = summed.join(volume.select(*XYZ), XYZ, "left_semi")
    return out


def ranges_merged(labels: DataFrame, label: str, rules: DataFrame) -> DataFrame:
    """Ids in (lo, hi] become lo, by ``rules(lo, hi)``: a dozen rows, so they are broadcast."""
    r = F.broadcast(rules.select("lo", "hi"))
    return labels.join(r, (F.col(label) > F.col("lo")) & (F.col(label) <= F.col("hi")), "left").withColumn(label, F.coalesce("lo", label)).drop("lo", "hi")


def reindexed(labels: DataFrame, label: str, start: int = 1, out: str = "new_label") -> DataFrame:
    """Labels numbered anew in their order from ``start``; 0 stays. The numbering is over distinct labels only."""
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(label)) + (start - 1)
    names = labels.select(label).distinct().where(F.col(label) != 0).withColumn(out, number)
    return labels.join(names, label, "left").withColumn(out, F.coalesce(out, F.lit(0)))


def projected(labels: DataFrame, label: str, values: DataFrame, node: str, value: str) -> DataFrame:
    """Each point gets its label's value; background and unmapped labels get 0."""
    v = values.select(F.col(node).alias(label), F.col(value).alias("_v"))
    return labels.join(v, label, "left").withColumn(value, F.when(F.col(label) == 0, 0.0).otherwise(F.coalesce("_v", F.lit(0.0)))).drop("_v")


def grey_or_white(volumes: DataFrame, grey: str, white: str, out: str) -> DataFrame:
    return volumes.withColumn(out, F.when(F.col(grey) != 0, F.col(grey)).otherwise(F.col(white)))


def summed(volumes: list[DataFrame], value: str) -> DataFrame:
    """Sum of several volumes over the points that all of them have."""
    every = volumes[0]
    for v in volumes[1:]:
        every = every.unionByName(v)
    return every.groupBy(*XYZ).agg(F.sum(value).alias(value), F.count("*").alias("_n")).where(F.col("_n") == len(volumes)).drop("_n")


def extended_by_csf(volume: DataFrame, brain: str, csf: str, raw: str, threshold: float) -> DataFrame:
    """Anatomical image and mask that also hold outside-brain points whose CSF share exceeds ``threshold``."""
    extra = (F.col(csf) > threshold) & (F.col(brain) == 0)
    return volume.withColumn("extended", F.when(extra, F.col(raw)).otherwise(F.col(brain))).withColumn("extended_mask", ((F.col(brain) != 0) | extra).cast("int"))


def affine(points: DataFrame, matrix: list[list[float]]) -> DataFrame:
    """Index to world coordinates, as wx, wy, wz."""
    return points.withColumns({f"w{XYZ[r]}": sum((F.col(a) * float(matrix[r][k]) for k, a in enumerate(XYZ)), F.lit(float(matrix[r][3]))) for r in range(3)})


def corrected_volume(volume: DataFrame, raw: str, corrected: str, tissue: str) -> DataFrame:
    """0 where the corrected value is negative or over twice the raw one; times the tissue's share."""
    bad = (F.col(corrected) > 2 * F.col(raw)) | (F.col(corrected) < 0)
    return volume.withColumn("value", F.when(bad, 0.0).otherwise(F.col(corrected)) * F.col(tissue))


def deformation(volume: DataFrame, dx: str, dy: str, dz: str, by: list[str]) -> DataFrame:
    d = lambda c: F.col(c) * F.col(c)
    return volume.groupBy(*by).agg(F.avg(F.sqrt(d(dx) + d(dy) + d(dz))).alias("magnitude"))


def reoriented(points: DataFrame, axes: str, extent: dict[str, int]) -> DataFrame:
    """Axes permuted and flipped: ``axes`` such as "-x+z-y" says what becomes of x, y and z; ``extent``: points an axis."""
    parts = [axes[k : k + 2] for k in (0, 2, 4)]
    new = {f"n{XYZ[k]}": (F.col(p[1]) if p[0] == "+" else F.lit(extent[p[1]] - 1) - F.col(p[1])) for k, p in enumerate(parts)}
    return points.withColumns(new)


def filtered(volume: DataFrame, value: str, mask: str, percentile: float, fwhm: float) -> DataFrame:
    """The whole voxel filter: spikes and holes are inpainted, then the volume is smoothed and masked."""
    inside = volume.where(F.col(mask))
    top = inside.agg(F.percentile(F.when(F.col(value) > 0, F.col(value)), percentile / 100).alias("_top"))
    spikes = volume.crossJoin(F.broadcast(top)).where(F.col(value) > F.col("_top")).select(*XYZ)
    calm = median_inpainted(volume.select(*XYZ, value, mask), spikes, value)
    missing = calm.where(F.col(mask) & (F.col(value) == 0)).select(*XYZ)
    whole = median_inpainted(calm, missing, value)
    return smoothed(whole, value, fwhm).join(inside.select(*XYZ), XYZ, "left_semi")


def bounded(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(c, F.lit(hi)))
