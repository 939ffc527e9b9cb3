"""Stacks of matrices over the driver's tables: trade between nations, a year a recording."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogue import query
from ..operators import matrices, parcels
from .parcel_queries import rounded
from .views import MEANW, TRADE, VOX, mean_matrix, trade, voxels

CENTRED = MEANW + ", m as (select i, j, round(w - (select avg(w) from pop), 4) as w from pop)"
HOLED = TRADE + ", holed as (select * from trade where (yr * 31 + i) % 9 <> 0 or yr = 1995)"


def centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mean_matrix(spark, sf_dir)
    return m.crossJoin(F.broadcast(m.agg(F.avg("w").alias("_m")))).select("i", "j", F.round(F.col("w") - F.col("_m"), 4).alias("w"))


def holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trade(spark, sf_dir).where("(yr * 31 + i) % 9 <> 0 or yr = 1995")


@query(
    HOLED,
    "n as (select yr, count(distinct i) as n from holed group by all)",
    "base as (select distinct i as l from holed where yr = (select yr from n order by n desc, yr limit 1))",
    sql="select y.yr, a.l as i, b.l as j, round(coalesce(w, 0), 5) as w from (select distinct yr from holed) y cross join base a cross join base b left join holed h on h.yr = y.yr and h.i = a.l and h.j = b.l",
)
def pop_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(matrices.aligned(holed(spark, sf_dir), "yr"), "w", digits=5)


@query(MEANW, sql="select i, j, round(w, 5) as w from pop")
def pop_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(matrices.group_mean(trade(spark, sf_dir)), "w", digits=5)


@query(
    MEANW,
    "z as (select i, j, case when i % 6 = 0 then 0 else w end as w from pop)",
    "f as (select i from z group by i having sum(abs(w)) > 0)",
    sql="select i, j, round(w, 5) as w from z where i in (from f) and j in (from f)",
)
def drop_empty_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mean_matrix(spark, sf_dir).withColumn("w", F.when(F.col("i") % 6 == 0, 0.0).otherwise(F.col("w")))
    return rounded(matrices.without_empty_nodes(m), "w", digits=5).select("i", "j", "w")


@query(
    HOLED,
    "n as (select yr, count(*) filter (w <> 0) as n from holed group by all)",
    sql="select yr, i, j, round(w, 5) as w from holed where yr in (select yr from n where n >= (select avg(n) - stddev_pop(n) from n))",
)
def sparse_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(matrices.without_sparse(holed(spark, sf_dir), "yr"), "w", digits=5).select("yr", "i", "j", "w")


@query(
    VOX,
    MEANW,
    "low as (select label from vox group by label having avg(mask::int::double) < (select median(s) from (select avg(mask::int::double) as s from vox group by label)) or count(*) <= 5)",
    sql="select i, j, round(w, 5) as w from pop where i not in (from low) and j not in (from low)",
)
def low_coverage_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    cover = parcels.coverage(voxels(spark, sf_dir), "label", "mask")
    low = cover.crossJoin(F.broadcast(cover.agg(F.median("share").alias("_m")))).where("share < _m or n <= 5")
    return rounded(matrices.without_labels(mean_matrix(spark, sf_dir), low, "label"), "w", digits=5).select("i", "j", "w")


def _binarise(mode: str, sql: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return matrices.binarised(centred(spark, sf_dir), mode, 20000.0).select("i", "j", "b")

    run.__name__ = f"binarize_{mode}"
    query(CENTRED, sql=f"select i, j, ({sql})::double as b from m")(run)


_binarise("abs", "case when abs(w) > 20000 then 1 else 0 end")
_binarise("posneg", "case when abs(w) >= 20000 then sign(w) else 0 end")
_binarise("pos", "case when w >= 20000 then 1 else 0 end")
_binarise("neg", "case when w <= -20000 then 1 else 0 end")


@query(CENTRED, sql="select w as threshold from (select w, row_number() over (order by w desc) as n from m) where n = ceil(0.1 * 25 * 25)")
def density_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrices.density_threshold(centred(spark, sf_dir), 0.1, 25)


@query(CENTRED, sql="select i, j, w from (select *, rank() over (order by abs(w) desc) as n from m) where n <= 30")
def top_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrices.strongest(centred(spark, sf_dir), 30)


@query(CENTRED, sql="select i, j, greatest(w, 0) as pos, greatest(-w, 0) as neg, round(w / case when n = 0 then 1 else n end, 6) as w from (select *, sqrt(sum(w * w) over (partition by i)) as n from m)")
def sign_split_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = matrices.sign_channels(centred(spark, sf_dir), "w")
    return rounded(matrices.row_normalised(split, ["i"], "w"), "w")


@query(
    VOX,
    CENTRED,
    "c as (select block, avg(x) x, avg(y) y, avg(z) z from vox group by all)",
    sql="select a.block as i, b.block as j, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 6) as d, m.w, case when m.w > 0 then 'Positive' else 'Negative' end as side from c a join c b on a.block < b.block join m on m.i = a.block and m.j = b.block",
)
def dist_vs_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rounded(parcels.distances(parcels.centroids(voxels(spark, sf_dir), "block"), "block"), "d")
    return d.join(centred(spark, sf_dir), ["i", "j"]).withColumn("side", F.when(F.col("w") > 0, "Positive").otherwise("Negative"))


@query(MEANW, "u as (select i, j, round(w, 5) as w from pop where i <= j)", sql="select i, j, w from u union all select j, i, w from u where i <> j")
def mirrored_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrices.mirrored(rounded(mean_matrix(spark, sf_dir), "w", digits=5).where("i <= j"))
