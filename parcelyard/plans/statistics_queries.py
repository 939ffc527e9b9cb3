"""Tests and permutation inference over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogue import query
from ..functions.lineage import cut
from ..functions.rng import keyed_sql
from ..operators import nulls, similarity, statistics
from .parcel_queries import rounded
from .views import OBS, TRADE, observations, table, trade

N_PERM = 20
FULL = TRADE + ", years as (select distinct yr from trade), pairs as (select i, j from trade group by all having count(*) = (select count(*) from years)), full_ as (select t.* from trade t join pairs using (i, j))"
DEALT = (
    FULL
    + f""", slots as (select yr, row_number() over (order by yr) as slot from years),
  rolled as (select perm, yr, row_number() over (partition by perm order by case when perm = 0 then 0 else {keyed_sql("perm", "yr")} end, yr) as slot from range({N_PERM + 1}) p(perm), years),
  dealt as (select perm, rolled.yr, slots.yr as x from rolled join slots using (slot)),
  tt as (select perm, i, j, case when stddev_pop(w) > 0 then corr(x, w) * sqrt((count(*) - 2) / nullif(1 - corr(x, w) ** 2, 0)) else 0 end as t from full_ join dealt using (yr) group by all),
  hit as (select distinct perm, least(i, j) as a, greatest(i, j) as b from tt where abs(round(t, 6)) >= 3 and i <> j),
  lnk as (select perm, a as src, b as dst from hit union all select perm, b, a from hit),
  reach as (select perm, src as node, src as to_ from lnk union select reach.perm, node, dst from reach join lnk on lnk.perm = reach.perm and src = to_),
  lab as (select perm, node, min(to_) as component from reach group by all),
  sizes as (select hit.perm, component, count(*) as size from hit join lab on lab.perm = hit.perm and node = a group by all)"""
)


def full_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that every year has."""
    t = trade(spark, sf_dir)
    years = t.agg(F.countDistinct("yr").alias("_years"))
    pairs = t.groupBy("i", "j").agg(F.count("*").alias("_n")).crossJoin(F.broadcast(years)).where("_n = _years").select("i", "j")
    return t.join(pairs, ["i", "j"])


def permuted_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = full_trade(spark, sf_dir)
    years = t.select("yr").distinct().withColumn("x", F.col("yr"))
    dealt = statistics.permuted(years, "yr", "x", N_PERM)
    return statistics.slope_t(t.join(F.broadcast(dealt), "yr"), "x", "w", ["perm", "i", "j"]).withColumn("t", F.round("t", 6))


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written once: observed and null components are both read off it."""
    return cut(statistics.components_by_permutation(cut(permuted_t(spark, sf_dir)), 3.0))


@query(OBS, "c as (select a.parcel as i, b.parcel as j, corr(a.value, b.value) as r from obs a join obs b using (metabolite, pert) where a.parcel <= b.parcel group by 1, 2)", sql="select i, j, round(atanh(least(greatest(r, -0.999999), 0.999999)), 6) as z from c")
def edge_fisher_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    sim = similarity.pearson(observations(spark, sf_dir), "parcel", ["metabolite", "pert"], "value")
    return rounded(sim.select("i", "j", statistics.fisher_z(F.col("r")).alias("z")), "z")


@query(FULL, sql="select i, j, round(case when stddev_pop(w) > 0 then corr(yr, w) * sqrt((count(*) - 2) / nullif(1 - corr(yr, w) ** 2, 0)) else 0 end, 5) as t from full_ group by all")
def edge_glm_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.slope_t(full_trade(spark, sf_dir), "yr", "w", ["i", "j"]), "t", digits=5).select("i", "j", "t")


@query(
    FULL,
    "d as (select *, (yr - 1995)::double as x1, case when yr % 2 = 0 then 1.0 else 0 end::double as x2 from full_)",
    "r as (select i, j, w, x1, x2, w - (regr_slope(w, x2) over g * x2 + regr_intercept(w, x2) over g) as e, x1 - (regr_slope(x1, x2) over g * x2 + regr_intercept(x1, x2) over g) as f from d window g as (partition by i, j))",
    sql="select i, j, round(case when regr_syy(e, f) > 0 then corr(e, f) * sqrt((count(*) - 3) / nullif(1 - corr(e, f) ** 2, 0)) else 0 end, 4) as t from r group by all",
)
def edge_glm_nuisance_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The year's slope with the year's parity as a nuisance regressor."""
    t = full_trade(spark, sf_dir)
    design = t.select("yr").distinct().select("yr", (F.col("yr") - 1995).alias("x1"), F.when(F.col("yr") % 2 == 0, 1.0).otherwise(0.0).alias("x2"))
    return rounded(statistics.several_regressors_t(t, ["i", "j"], "w", design, "yr", ["x1", "x2"], "x1"), "t", digits=4)


@query(FULL, sql="select i, j, round(case when stddev_samp(w) > 0 then avg(w) / (stddev_samp(w) / sqrt(count(*))) else 0 end, 5) as t from full_ group by all")
def edge_onesample_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.one_sample_t(full_trade(spark, sf_dir), "w", ["i", "j"]), "t", digits=5)


@query("recursive " + DEALT, sql="select component, size from sizes where perm = 0")
def nbs_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sizes(spark, sf_dir).where("perm = 0").select("component", "size")


@query("recursive " + DEALT, sql=f"select p.perm, coalesce(max(size), 0) as largest from range(1, {N_PERM + 1}) p(perm) left join sizes on sizes.perm = p.perm group by all")
def nbs_null_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.null_maxima(sizes(spark, sf_dir), N_PERM)


@query(
    "recursive " + DEALT,
    f"null_ as (select p.perm, coalesce(max(size), 0) as largest from range(1, {N_PERM + 1}) p(perm) left join sizes on sizes.perm = p.perm group by all)",
    sql=f"select component, size, ((select count(*) from null_ where largest >= size) + 1) / {N_PERM + 1}.0::double as p from sizes where perm = 0",
)
def nbs_pvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.component_p(sizes(spark, sf_dir), N_PERM)


TWO = "s as (select l_linestatus, count(*) filter (l_returnflag = 'A') na, count(*) filter (l_returnflag = 'N') nb, avg(l_extendedprice) filter (l_returnflag = 'A') ma, avg(l_extendedprice) filter (l_returnflag = 'N') mb, var_samp(l_extendedprice) filter (l_returnflag = 'A') va, var_samp(l_extendedprice) filter (l_returnflag = 'N') vb from lineitem group by all)"


@query(TWO, sql="select l_linestatus, round((ma - mb) / sqrt(va / na + vb / nb), 5) as t, round((va / na + vb / nb) ** 2 / ((va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1)), 3) as df from s")
def welch_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = statistics.two_groups(table(spark, sf_dir, "lineitem"), "l_returnflag", "A", "N", "l_extendedprice", ["l_linestatus"])
    return rounded(rounded(found, "t", digits=5), "df", digits=3).select("l_linestatus", "t", "df")


@query(TWO, sql="select l_linestatus, round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6) as d from s")
def cohens_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = statistics.two_groups(table(spark, sf_dir, "lineitem"), "l_returnflag", "A", "N", "l_extendedprice", ["l_linestatus"])
    return rounded(found, "d").select("l_linestatus", "d")


@query()
def welch_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sided p of the Welch test; no engine here has the t distribution, so there is no SQL for it."""
    found = statistics.two_groups(table(spark, sf_dir, "lineitem"), "l_returnflag", "A", "N", "l_extendedprice", ["l_linestatus"])
    return found.where("t is not null").select("l_linestatus", statistics.student_p_column("t", "df").alias("p"))


SUBJECTS = "sub as (select s_suppkey as id, s_nationkey % 2 as grp, s_acctbal as y from supplier)"


@query(
    SUBJECTS,
    "slots as (select grp, row_number() over (order by id) as slot from sub)",
    f"rolled as (select perm, id, y, row_number() over (partition by perm order by case when perm = 0 then 0 else {keyed_sql('perm', 'id')} end, id) as slot from range(100) p(perm), sub)",
    "diff as (select perm, round(avg(y) filter (grp = 1) - avg(y) filter (grp <> 1), 9) as diff from rolled join slots using (slot) group by all)",
    sql="select o.diff as observed, ((select count(*) from diff where perm > 0 and abs(diff.diff) >= abs(o.diff)) + 1) / 100.0::double as p from diff o where perm = 0",
)
def perm_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    sub = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 2).alias("grp"), F.col("s_acctbal").alias("y"))
    return statistics.permutation_p(sub, "id", "grp", 1, "y", 99)


@query(
    SUBJECTS,
    "num as (select grp, y, row_number() over (partition by grp order by id) - 1 as k, count(*) over (partition by grp) as n from sub)",
    f"draw as (select perm, grp, {keyed_sql('perm', 'k')} % n as k from num, range(1, 101) p(perm))",
    "m as (select perm, draw.grp, avg(y) as m from draw join num on num.grp = draw.grp and num.k = draw.k group by all)",
    sql="select grp, round(quantile_cont(m, 0.025), 5) as lo, round(quantile_cont(m, 0.975), 5) as hi from m group by all",
)
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    sub = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 2).alias("grp"), F.col("s_acctbal").alias("y"))
    return rounded(statistics.bootstrap_interval(sub, "id", "grp", "y", 100), "lo", "hi", digits=5)


TESTS = "tests as (select n_nationkey as id, ((n_nationkey * 7919) % 101 + 1) / 102.0::double as p from nation)"


@query(
    TESTS,
    "r as (select *, row_number() over (order by p, id) as k, count(*) over () as m from tests)",
    sql="select id, p, round(least(1, min(p * m / k) over (order by k desc rows unbounded preceding)), 8) as q from r",
)
def bh_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), (((F.col("n_nationkey") * 7919) % 101 + 1) / F.lit(102.0)).alias("p"))
    return rounded(statistics.bh_fdr(tests, "p", ["id"]), "q", digits=8)


@query(OBS, sql="select parcel, metabolite, pert, round((value - avg(value) over w) / nullif(stddev_pop(value) over w, 0), 6) as z from obs window w as (partition by parcel)")
def profile_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.zscore(observations(spark, sf_dir), ["parcel"], "value"), "z").select("parcel", "metabolite", "pert", "z")


PAIRS = "pairs_ as (select i, j, abs(i - j) * 1.5::double as d, round(avg(w), 4) as w from trade where i < j group by all)"


@query(
    TRADE,
    PAIRS,
    "num as (select i, j, floor(d / 6) as bin, w, row_number() over (partition by floor(d / 6) order by i, j) as slot from pairs_)",
    f"rolled as (select perm, i, j, bin, row_number() over (partition by perm, bin order by {keyed_sql('perm', '(i * 1009 + j)')}, i, j) as slot from num, range(1, 4) p(perm))",
    sql="select perm, rolled.i, rolled.j, num.w from rolled join num on num.bin = rolled.bin and num.slot = rolled.slot",
)
def distance_binned_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = trade(spark, sf_dir).where("i < j").groupBy("i", "j").agg(F.round(F.avg("w"), 4).alias("w")).withColumn("d", F.abs(F.col("i") - F.col("j")) * 1.5)
    return nulls.binned_shuffle(m, "d", "w", 6.0, 3)


@query(
    "recursive " + FULL,
    "z as (select i, j, round(atanh(least(greatest(case when stddev_pop(w) > 0 then corr(yr, w) else 0 end, -0.999999), 0.999999)), 6) as z from full_ group by all)",
    "hit as (select least(i, j) as a, greatest(i, j) as b, max(abs(z)) as z from z where abs(z) > 0.9 and i <> j group by all)",
    "lnk as (select a as src, b as dst from hit union all select b, a from hit)",
    "reach as (select src as node, src as to_ from lnk union select node, dst from reach join lnk on src = to_)",
    "lab as (select node, min(to_) as component from reach group by all)",
    sql="select component, count(*) as extent, round(sum(z), 4) as intensity from hit join lab on node = a group by all",
)
def nbs_z_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the links whose correlation with the year is strong: extent, and intensity (sum of z)."""
    r = full_trade(spark, sf_dir).groupBy("i", "j").agg(F.coalesce(similarity.guarded_corr("yr", "w"), F.lit(0.0)).alias("r"))
    z = r.select("i", "j", F.round(statistics.fisher_z(F.col("r")), 6).alias("z")).where("abs(z) > 0.9 and i <> j")
    return rounded(statistics.component_intensity(z), "intensity", digits=4)


@query("s as (select n_nationkey as k, (n_nationkey * 7919 % 101) / 10.0::double as grad, (n_nationkey * 104729 % 97) / 97.0::double as entropy from nation)", sql="select o.grad as og, o.entropy as oe, (count(*) filter (o.grad <= s.grad and o.entropy >= s.entropy) + 1) / (count(*) + 1)::double as p from s, (from s where k = 5) o where s.k <> 5 group by all")
def path_joint_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    s = table(spark, sf_dir, "nation").select(n.alias("k"), (n * 7919 % 101 / F.lit(10.0)).alias("grad"), (n * 104729 % 97 / F.lit(97.0)).alias("entropy"))
    return nulls.joint_p(s.where("k = 5"), s.where("k <> 5"))
