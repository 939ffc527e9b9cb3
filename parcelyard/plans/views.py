"""The driver's tables, seen as parcels, volumes, matrices and recordings; each view with the SQL that defines it for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OBS = "obs as (select user_id % 12 as parcel, event_type as metabolite, event_id % 10 as pert, avg(value) as value from events group by all)"
RAW = "raw as (select user_id % 12 as parcel, event_type as metabolite, value from events)"
VOX = "vox as (select event_id, event_id % 10 as x, (event_id // 10) % 10 as y, event_id // 100 as z, user_id % 8 as label, 1 + (event_id % 10) // 2 + 5 * (((event_id // 10) % 10) // 5) as block, value, value > 5 as mask from events)"
TRADE = """trade as (select year(o_orderdate)::int as yr, s_nationkey as i, c_nationkey as j, sum(l_extendedprice) as w
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey group by all)"""
MEANW = TRADE + ", pop as (select i, j, avg(w) as w from trade group by all)"
#: Symmetric edges whose weight is among the strongest 40.
EDGES = (
    MEANW
    + """, sym as (select least(i, j) as a, greatest(i, j) as b, round(sum(w), 4) as w from pop where i <> j group by all),
  strong as (select a, b, w from (select *, row_number() over (order by w desc, a, b) as n from sym) where n <= 40),
  edges as (select a as src, b as dst, w from strong union all select b, a, w from strong)"""
)
NODEVAL = "nodeval as (select n_nationkey as node, (n_nationkey * 37 % 25) / 5.0::double as v from nation)"
PROF = "prof as (select vec_id, label, embedding::double[] as e from embeddings)"


def raw_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(parcel, metabolite, value), one row an event."""
    return table(spark, sf_dir, "events").select((F.col("user_id") % 12).alias("parcel"), F.col("event_type").alias("metabolite"), "value")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(parcel, metabolite, pert, value): events by user modulo 12, type and id modulo 10, averaged."""
    e = table(spark, sf_dir, "events")
    return e.groupBy((F.col("user_id") % 12).alias("parcel"), F.col("event_type").alias("metabolite"), (F.col("event_id") % 10).alias("pert")).agg(F.avg("value").alias("value"))


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, x, y, z, label, block, value, mask): one event a lattice point; labels scattered or in blocks."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", "event_id % 10 as x", "(event_id div 10) % 10 as y", "event_id div 100 as z", "user_id % 8 as label", "1 + (event_id % 10) div 2 + 5 * (((event_id div 10) % 10) div 5) as block", "value", "value > 5 as mask"
    )


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(yr, i, j, w): a stack of nation-by-nation matrices, one a year; written once, as queries name it several times and some in rounds."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("yr"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("j"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("i"))
    # Orders meet their customers before the many lines do.
    placed = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "yr", "j")
    joined = li.join(placed, F.col("l_orderkey") == F.col("o_orderkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return cut(joined.groupBy("yr", "i", "j").agg(F.sum("l_extendedprice").alias("w")))


def mean_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trade(spark, sf_dir).groupBy("i", "j").agg(F.avg("w").alias("w"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, w) in both directions: the 40 strongest symmetric links of the mean matrix."""
    m = mean_matrix(spark, sf_dir).where("i <> j")
    sym = m.groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.round(F.sum("w"), 4).alias("w"))
    strong = sym.orderBy(F.desc("w"), "a", "b").limit(40)
    return strong.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e"), "w").select("e.src", "e.dst", "w")


def node_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, v): a made-up value a nation."""
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), ((F.col("n_nationkey") * 37 % 25) / F.lit(5.0)).alias("v"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
