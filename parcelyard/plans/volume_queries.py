"""Voxel operators over the driver's tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogue import query
from ..functions.rng import keyed_sql
from ..operators import volumes
from .parcel_queries import rounded
from .views import VOX, voxels

SPIKE = VOX + ", top as (select quantile_cont(value, 0.98) filter (value > 0) as t from vox), spike as (select x, y, z from vox, top where value > t)"
NEAR = "a.x between b.x - 1 and b.x + 1 and a.y between b.y - 1 and b.y + 1 and a.z between b.z - 1 and b.z + 1 and not (a.x = b.x and a.y = b.y and a.z = b.z)"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxels(spark, sf_dir).select("x", "y", "z", "value")


@query(SPIKE, sql="select x, y, z from spike")
def spike_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = cells(spark, sf_dir)
    top = v.agg(F.percentile(F.when(F.col("value") > 0, F.col("value")), 0.98).alias("t"))
    return v.crossJoin(F.broadcast(top)).where("value > t").select("x", "y", "z")


@query(
    VOX,
    "m as (select x, y, z, value > 2 as m from vox)",
    sql="select a.x, a.y, a.z from m a join m b on b.m and abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1 and b.x between a.x - 1 and a.x + 1 and b.y between a.y - 1 and a.y + 1 and b.z between a.z - 1 and a.z + 1 where not a.m group by all having count(*) = 6",
)
def hole_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volumes.holes(cells(spark, sf_dir).withColumn("m", F.col("value") > 2), "m")


@query(
    SPIKE,
    "en as (select max(x) as hx, max(y) as hy, max(z) as hz from vox), o as (select dx, dy, dz from range(-1, 2) a(dx), range(-1, 2) b(dy), range(-1, 2) c(dz) where dx <> 0 or dy <> 0 or dz <> 0), at_ as (select x, y, z, case when abs(x + dx) > hx then 2 * hx - (x + dx) else abs(x + dx) end as px, case when abs(y + dy) > hy then 2 * hy - (y + dy) else abs(y + dy) end as py, case when abs(z + dz) > hz then 2 * hz - (z + dz) else abs(z + dz) end as pz from spike, o, en)",
    "med as (select t.x, t.y, t.z, quantile_cont(a.value, 0.5) as m from at_ t join vox a on a.x = px and a.y = py and a.z = pz group by all)",
    sql="select x, y, z, round(coalesce(m, value), 6) as value from vox left join med using (x, y, z)")
def median_inpaint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(volumes.median_inpainted(cells(spark, sf_dir), spike_mask(spark, sf_dir), "value"), "value")


def _axis(source: str, axis: str, fwhm: float) -> str:
    s = fwhm / (2 * math.sqrt(2 * math.log(2)))
    on = " and ".join(f"a.{c} = b.{c}" for c in "xyz" if c != axis)
    g = f"exp(-((a.{axis} - b.{axis}) ** 2) / {2 * s * s!r}::double)"
    return f"(select b.x, b.y, b.z, sum(a.value * {g}) / sum({g}) as value from {source} a join {source} b on {on} and a.{axis} between b.{axis} - {int(4 * s + 0.5)} and b.{axis} + {int(4 * s + 0.5)} group by all)"


@query(VOX, f"s1 as {_axis('vox', 'x', 2.5)}", f"s2 as {_axis('s1', 'y', 2.5)}", f"s3 as {_axis('s2', 'z', 2.5)}", sql="select x, y, z, round(value, 5) as value from s3")
def gaussian_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(volumes.smoothed(cells(spark, sf_dir), "value", 2.5), "value", digits=5)


@query(VOX, sql="select event_id, coalesce(r.lo, block) as block from vox left join (values (1, 3), (6, 8)) r(lo, hi) on block > lo and block <= hi")
def merge_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([(1, 3), (6, 8)], "lo long, hi long")
    return volumes.ranges_merged(voxels(spark, sf_dir), "block", rules).select("event_id", "block")


@query(VOX, "l as (select event_id, case when label = 3 then 0 else label * 100 end as label from vox)", "n as (select label, 10 + row_number() over (order by label) - 1 as new_label from (select distinct label from l where label <> 0))", sql="select event_id, label, coalesce(new_label, 0)::int as new_label from l left join n using (label)")
def reindex_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = voxels(spark, sf_dir).select("event_id", F.when(F.col("label") == 3, 0).otherwise(F.col("label") * 100).alias("label"))
    return volumes.reindexed(v, "label", 10)


@query(VOX, sql="select event_id, case when label = 0 then 0 else coalesce(v, 0) end::double as value from vox left join (values (1, 0.5), (2, 1.5), (5, 2.5)) m(label, v) using (label)")
def project_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = spark.createDataFrame([(1, 0.5), (2, 1.5), (5, 2.5)], "node long, value double")
    return volumes.projected(voxels(spark, sf_dir).drop("value"), "label", values, "node", "value").select("event_id", "value")


@query(VOX, sql="select event_id, case when g <> 0 then g else w end as merged from (select event_id, case when label < 3 then label else 0 end as g, block + 3000 as w from vox)")
def grey_white_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = voxels(spark, sf_dir).select("event_id", F.when(F.col("label") < 3, F.col("label")).otherwise(0).alias("g"), (F.col("block") + 3000).alias("w"))
    return volumes.grey_or_white(v, "g", "w", "merged").select("event_id", "merged")


@query(VOX, sql="select x, y, z, round(2 * value, 6) as value from vox where mask")
def composite_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum of a volume and its masked self, over the points that both have."""
    v = voxels(spark, sf_dir)
    return rounded(volumes.summed([v.select("x", "y", "z", "value"), v.where("mask").select("x", "y", "z", "value")], "value"), "value")


@query(VOX, sql="select event_id, case when csf > 0.6 and not mask then value else case when mask then value else 0 end end as extended, (mask or csf > 0.6)::int as extended_mask from (select *, (event_id % 7) / 7.0::double as csf from vox) where true")
def csf_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = voxels(spark, sf_dir).withColumn("csf", (F.col("event_id") % 7) / F.lit(7.0)).withColumn("brain", F.when(F.col("mask"), F.col("value")).otherwise(0.0))
    return volumes.extended_by_csf(v, "brain", "csf", "value", 0.6).select("event_id", "extended", "extended_mask")


@query(VOX, sql="select event_id, -2.0::double * x + 90 as wx, 2.0::double * y - 126 as wy, 2.0::double * z - 72 as wz from vox")
def world_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volumes.affine(voxels(spark, sf_dir), [[-2, 0, 0, 90], [0, 2, 0, -126], [0, 0, 2, -72]]).select("event_id", "wx", "wy", "wz")


@query(VOX, sql="select event_id, round(case when c > 2 * value or c < 0 then 0 else c end * t, 6) as value from (select *, value * (event_id % 5) - 1 as c, (event_id % 3) / 3.0::double as t from vox)")
def partial_volume_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = voxels(spark, sf_dir).withColumn("raw", F.col("value")).withColumn("c", F.col("value") * (F.col("event_id") % 5) - 1).withColumn("t", (F.col("event_id") % 3) / F.lit(3.0))
    return rounded(volumes.corrected_volume(v, "raw", "c", "t"), "value").select("event_id", "value")


@query(VOX, sql="select block, round(avg(sqrt(value * value + x * x + 4)), 6) as magnitude from vox group by all")
def deformation_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(volumes.deformation(voxels(spark, sf_dir).withColumn("two", F.lit(2.0)), "value", "x", "two", ["block"]), "magnitude")


@query(VOX, sql="select event_id, 9 - x as nx, z as ny, 9 - y as nz from vox")
def orientation_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volumes.reoriented(voxels(spark, sf_dir), "-x+z-y", {"x": 10, "y": 10, "z": 100}).select("event_id", "nx", "ny", "nz")


_NORMAL = " + ".join(f"{keyed_sql('pert', f'(event_id * 12 + {k})')} / 2147483647.0::double" for k in range(12)) + " - 6"


@query(
    VOX,
    "b as (select event_id, event_id % 3 as met, value, avg(value) over (partition by event_id % 3) + 3 * stddev_pop(value) over (partition by event_id % 3) as top from vox)",
    sql=f"select event_id, pert, round(greatest(0, least(value + value * 20 / 100 * ({_NORMAL}), top)), 6) as value from b, range(2) p(pert)",
)
def perturbation_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = voxels(spark, sf_dir).select("event_id", (F.col("event_id") % 3).alias("met"), "value", F.lit(20.0).alias("crlb"))
    return rounded(volumes.perturbed(v, "value", "crlb", ["met"], "event_id", 2), "value").select("event_id", "pert", "value")


@query()
def voxel_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spike and hole inpainting, smoothing and masking in one pass."""
    return volumes.filtered(voxels(spark, sf_dir).select("x", "y", "z", "value", "mask"), "value", "mask", 98, 2.5)
