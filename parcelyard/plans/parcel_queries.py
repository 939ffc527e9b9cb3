"""Parcel aggregation over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogue import query
from ..operators import parcels
from .views import OBS, RAW, VOX, observations, raw_observations, table, voxels


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(RAW, sql="select parcel, metabolite, round(avg(value), 6) as mean from raw group by all")
def parcel_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(parcels.parcel_mean(raw_observations(spark, sf_dir), ["parcel", "metabolite"], "value"), "mean")


@query(OBS, sql="select p.parcel, m.metabolite, round(case when count(o.value) = 0 then 0 else avg(o.value) end, 6) as mean from range(15) p(parcel) cross join (select distinct metabolite from obs) m left join obs o on o.parcel = p.parcel and o.metabolite = m.metabolite group by 1, 2")
def parcel_mean_with_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header parcels 0 to 14, of which the last three hold no voxel."""
    obs = observations(spark, sf_dir)
    header = spark.range(15).withColumnRenamed("id", "parcel").crossJoin(F.broadcast(obs.select("metabolite").distinct()))
    return rounded(parcels.parcel_mean(obs, ["parcel", "metabolite"], "value", header), "mean").select("parcel", "metabolite", "mean")


@query(OBS, sql="select parcel, metabolite, pert, round(case when avg(value) over w = 0 or stddev_pop(value) over w = 0 then value else (value - avg(value) over w) / stddev_pop(value) over w end, 6) as value from obs window w as (partition by metabolite)")
def parcel_rescale_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(parcels.rescaled(observations(spark, sf_dir), ["metabolite"], "value", "zscore"), "value")


@query(OBS, sql="select parcel, metabolite, pert, round(value / (case when avg(value) over w = 0 then 1 else avg(value) over w end), 6) as value from obs window w as (partition by metabolite)")
def parcel_rescale_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(parcels.rescaled(observations(spark, sf_dir), ["metabolite"], "value", "mean"), "value")


@query(VOX, sql="select label, count(*) as n, round(avg(mask::int::double), 6) as share from vox group by all")
def parcel_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(parcels.coverage(voxels(spark, sf_dir), "label", "mask"), "share")


@query(VOX, sql="select block, count(*) filter (mask) as n_first, count(*) filter (value > 8) as n_second, round(count(*) filter (mask)::double / nullif(count(*) filter (value > 8), 0), 6) as ratio from vox group by all")
def voxel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = voxels(spark, sf_dir).withColumn("second", F.col("value") > 8)
    return rounded(parcels.voxel_counts(v, "block", "mask", "second"), "ratio")


@query(sql="select user_id % 50 as voxel, event_type as metabolite, round(avg((value > 3 and event_id % 7 > 0)::int::double), 6) as share, (avg((value > 3 and event_id % 7 > 0)::int::double) > 0.6)::int as flag from events group by all")
def quality_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("voxel", F.col("user_id") % 50).withColumn("metabolite", F.col("event_type"))
    return rounded(parcels.quality_mask(e, ["voxel", "metabolite"], (F.col("value") > 3) & (F.col("event_id") % 7 > 0), 0.6), "share")


@query(VOX, sql="select label, round(avg(x), 6) as x, round(avg(y), 6) as y, round(avg(z), 6) as z from vox where label <> 0 group by all")
def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(parcels.centroids(voxels(spark, sf_dir), "label"), "x", "y", "z")


@query(VOX, sql="select label, round(-2 * avg(x) + 90, 6) as x, round(2 * avg(y) - 126, 6) as y, round(2 * avg(z) - 72, 6) as z from vox where label <> 0 group by all")
def world_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    affine = [[-2, 0, 0, 90], [0, 2, 0, -126], [0, 0, 2, -72]]
    return rounded(parcels.centroids(voxels(spark, sf_dir), "label", affine=affine), "x", "y", "z")


@query(VOX + ", c as (select block, avg(x) x, avg(y) y, avg(z) z from vox group by all)", sql="select a.block as i, b.block as j, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 6) as d from c a join c b on a.block < b.block")
def distance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(parcels.distances(parcels.centroids(voxels(spark, sf_dir), "block"), "block"), "d")


@query(
    sql="""select l_returnflag, round(coalesce(avg(l_quantity) filter (k > floor(0.1 * n) and k <= n - floor(0.1 * n)), median(l_quantity)), 6) as trimmed from
(select *, row_number() over (partition by l_returnflag order by l_quantity) as k, count(*) over (partition by l_returnflag) as n from lineitem) group by 1"""
)
def trimmed_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(parcels.trimmed_mean(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity"), ["l_returnflag"], "l_quantity", 0.1), "trimmed")


@query(RAW, sql="select metabolite, round(quantile_cont(value, 0.98) filter (value > 0), 6) as threshold from raw group by all")
def spike_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(parcels.percentile_of_positives(raw_observations(spark, sf_dir), ["metabolite"], "value", 98), "threshold")


@query(RAW, sql="select b.bin, round(quantile_cont(value, 0.5), 6) as med, round(quantile_cont(value, 0.1), 6) as p_lo, round(quantile_cont(value, 0.9), 6) as p_hi from raw join (values (0, -1, 4), (1, 4, 8), (2, 8, 12)) b(bin, lo, hi) on parcel > lo and parcel < hi group by 1")
def bin_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = spark.createDataFrame([(0, -1, 4), (1, 4, 8), (2, 8, 12)], "bin int, lo int, hi int")
    return rounded(parcels.binned_profile(raw_observations(spark, sf_dir), bins, "parcel", "value"), "med", "p_lo", "p_hi")


@query(
    OBS
    + """, h as (select metabolite, least(floor((value - 0) / 100.0::double * 16), 15) as b, count(*) as c from obs where value between 0 and 100 group by all),
p as (select metabolite, c / sum(c) over (partition by metabolite)::double as p from h)""",
    sql="select metabolite, round(-sum(p * ln(p)) / ln(16), 6) as entropy from p group by all",
)
def entropy_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(parcels.histogram_entropy(observations(spark, sf_dir), ["metabolite"], "value", 0.0, 100.0, 16), "entropy")


@query(VOX, sql="select label, round(coalesce(avg(v) filter (v <> 0), 0), 6) as mean from (select label, case when mask then value else 0 end as v from vox) group by 1")
def nonzero_label_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = voxels(spark, sf_dir).withColumn("v", F.when(F.col("mask"), F.col("value")).otherwise(0.0))
    return rounded(parcels.nonzero_mean(v, ["label"], "v"), "mean")
