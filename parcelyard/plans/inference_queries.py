"""Permutation inference with a nuisance covariate, sign flips, tails and p of correlations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogue import query
from ..functions.lineage import cut
from ..functions.rng import keyed_sql
from ..operators import graph, inference, nulls, similarity, statistics
from .parcel_queries import rounded
from .similarity_queries import KEYS, RANKED, SIM
from .statistics_queries import FULL, N_PERM, full_trade
from .views import EDGES, OBS, TRADE, edges, observations, trade
from .graph_queries import HUB

DESIGN = "des as (select yr, yr::double as x, (yr * 37 % 5)::double as z, yr % 2 as block from years)"


def design(spark: SparkSession, sf_dir: str) -> DataFrame:
    yr = F.col("yr")
    return full_trade(spark, sf_dir).select("yr").distinct().select("yr", yr.cast("double").alias("x"), (yr * 37 % 5).cast("double").alias("z"), (yr % 2).alias("block"))


def _lane(block: bool) -> str:
    part = "perm, block" if block else "perm"
    slot_part = "partition by block order by yr" if block else "order by yr"
    on = "using (block, slot)" if block else "using (slot)"
    return (
        FULL
        + ", "
        + DESIGN
        + f""", plain as (select yr, block, x - (select regr_slope(x, z) from des) * (z - (select avg(z) from des)) - (select avg(x) from des) as rx, z - (select avg(z) from des) as rz from des),
  fitd as (select i, j, regr_slope(w, z) as b, avg(w) as mw, avg(z) as mz from full_ join des using (yr) group by all),
  resid as (select i, j, f.yr, f.w - mw - coalesce(b, 0) * (z - mz) as r from full_ f join des using (yr) join fitd using (i, j)),
  slots as (select yr as from_, block, row_number() over ({slot_part}) as slot from plain),
  rolled as (select perm, yr, block, row_number() over (partition by {part} order by case when perm = 0 then 0 else {keyed_sql("perm", "yr")} end, yr) as slot from range({N_PERM + 1}) p(perm), plain),
  dealt as (select perm, rolled.yr, from_ from rolled join slots {on}),
  sums as (select perm, i, j, sum(rx * r) as xr, sum(rz * r) as zr, sum(r) as sr, sum(r * r) as rr, sum(rx * rx) as xx, sum(rz * rz) as zz, count(*) as n from resid join dealt on from_ = resid.yr join plain on plain.yr = dealt.yr group by all),
  err as (select *, greatest(rr - sr * sr / n - coalesce(zr * zr / nullif(zz, 0), 0) - xr * xr / xx, 0) / (n - 3) as e from sums),
  lane as (select perm, i, j, case when e > 0 then xr / xx / sqrt(e / xx) else 0 end as t from err)"""
    )


def lane(spark: SparkSession, sf_dir: str, block: str | None = None) -> DataFrame:
    return inference.freedman_lane(full_trade(spark, sf_dir), design(spark, sf_dir), "yr", "x", "z", "w", ["i", "j"], N_PERM, block)


def squashed(found: DataFrame) -> DataFrame:
    """t as t / sqrt(1 + t^2): a perfect fit's huge t is 1 on every engine, and no row is left out."""
    return found.select("perm", "i", "j", F.round(F.col("t") / F.sqrt(1 + F.col("t") * F.col("t")), 4).alias("s"))


@query(_lane(False), sql="select perm, i, j, round(t / sqrt(1 + t * t), 4) as s from lane")
def nbs_freedman_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return squashed(lane(spark, sf_dir))


@query(_lane(True), sql="select perm, i, j, round(t / sqrt(1 + t * t), 4) as s from lane")
def nbs_exchange_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return squashed(lane(spark, sf_dir, "block"))


COMPONENTS = """hit as (select distinct perm, least(i, j) as a, greatest(i, j) as b from tt where {hit} and i <> j),
  lnk as (select perm, a as src, b as dst from hit union all select perm, b, a from hit),
  reach as (select perm, src as node, src as to_ from lnk union select reach.perm, node, dst from reach join lnk on lnk.perm = reach.perm and src = to_),
  lab as (select perm, node, min(to_) as component from reach group by all), placed as (select hit.*, component from hit join lab on lab.perm = hit.perm and node = a),
  sizes as (select perm, component, count(*) as size from placed group by all),
  null_ as (select perm, coalesce(max(size), 0) as largest from range(1, {n}) p(perm) left join sizes using (perm) group by all),
  ps as (select component, size, ((select count(*) from null_ where largest >= size) + 1) / ({n}::double) as p from sizes where perm = 0)"""


@query("recursive " + _lane(False), "tt as (select perm, i, j, round(t, 6) as t from lane)", COMPONENTS.format(hit="t >= 2", n=N_PERM + 1), sql="select a as i, b as j, component, size, round(p, 6) as p from placed join ps using (component) where perm = 0 and p < 0.9")
def nbs_significant_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of components in the right tail."""
    t = cut(lane(spark, sf_dir).withColumn("t", F.round("t", 6)))
    return rounded(inference.significant_edges(t, 2.0, N_PERM, 0.9, "right"), "p")


FLIPS = (
    FULL
    + f""", signs as (select perm, yr, case when perm = 0 or {keyed_sql("perm", "yr")} % 2 = 0 then 1.0::double else -1.0::double end as s from range({N_PERM + 1}) p(perm), years),
  flipped as (select perm, i, j, (w - 1000000) * s as v from full_ join signs using (yr)),
  fl as (select perm, i, j, case when stddev_samp(v) > 0 then avg(v) / (stddev_samp(v) / sqrt(count(v))) else 0 end as t from flipped group by all)"""
)


@query(FLIPS, sql="select perm, i, j, round(t / sqrt(1 + t * t), 4) as s from fl")
def nbs_sign_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    stack = full_trade(spark, sf_dir).withColumn("y", F.col("w") - 1000000)
    return squashed(inference.sign_flips(stack, "yr", "y", ["i", "j"], N_PERM))


@query(FULL, DESIGN, "f as (select i, j, regr_slope(w, z) as b, avg(w) as mw, avg(z) as mz from full_ join des using (yr) group by all)", sql="select i, j, yr, round(w - mw - coalesce(b, 0) * (z - mz), 4) as res from full_ join des using (yr) join f using (i, j)")
def nuisance_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = full_trade(spark, sf_dir).join(design(spark, sf_dir).select("yr", "z"), "yr")
    return rounded(inference.residuals(rows, ["i", "j"], "w", "z"), "res", digits=4).select("i", "j", "yr", "res")


ZED = (
    FULL
    + f""", slots as (select yr, row_number() over (order by yr) as slot from years),
  rolled as (select perm, yr, row_number() over (partition by perm order by case when perm = 0 then 0 else {keyed_sql("perm", "yr")} end, yr) as slot from range({N_PERM + 1}) p(perm), years),
  dealt as (select perm, rolled.yr, slots.yr as x from rolled join slots using (slot)),
  zz as (select perm, i, j, atanh(least(greatest(corr(x, w), -0.999999), 0.999999)) as z from full_ join dealt using (yr) group by all),
  tt as (select perm, i, j, round(z, 6) as t from zz where z is not null and not isnan(z)),
  hit as (select perm, least(i, j) as a, greatest(i, j) as b, max(abs(t)) as z from tt where abs(t) > 1.2 and i <> j group by all),
  lnk as (select perm, a as src, b as dst from hit union all select perm, b, a from hit),
  reach as (select perm, src as node, src as to_ from lnk union select reach.perm, node, dst from reach join lnk on lnk.perm = reach.perm and src = to_),
  lab as (select perm, node, min(to_) as component from reach group by all),
  sizes as (select hit.perm, component, round(sum(z), 9) as size from hit join lab on lab.perm = hit.perm and node = a group by all),
  null_ as (select perm, coalesce(max(size), 0) as largest from range(1, {N_PERM + 1}) p(perm) left join sizes using (perm) group by all)"""
)


@query("recursive " + ZED, sql=f"select component, round(size, 4) as size, (select count(*) from null_ where largest >= size) / {N_PERM}::double as p from sizes where perm = 0")
def nbs_z_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = full_trade(spark, sf_dir)
    dealt = statistics.permuted(t.select("yr").distinct().withColumn("x", F.col("yr")), "yr", "x", N_PERM)
    z = t.join(dealt, "yr").groupBy("perm", "i", "j").agg(similarity.guarded_corr("x", "w").alias("r")).where("r is not null")
    z = cut(z.select("perm", "i", "j", F.round(statistics.fisher_z(F.col("r")), 6).alias("z")))
    return rounded(inference.intensity_p(z, 1.2, N_PERM), "size", digits=4)


CLASSES = HUB + ", m as (select yr, case (i in (select node from hub))::int + (j in (select node from hub))::int when 2 then 'rich-club' when 1 then 'feeder' else 'peripheral' end as kind, avg(w) as mean from trade where i < j group by all), c as (select *, case when yr < 1998 then 'early' else 'late' end as era from m)"


def class_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    hubs = graph.hubs_by_quantile(edges(spark, sf_dir), 0.25)
    return graph.rich_club_means(trade(spark, sf_dir), hubs, "yr").withColumn("era", F.when(F.col("yr") < 1998, "early").otherwise("late"))


@query(
    CLASSES,
    f"subs as (select distinct yr, era from c), slots as (select era, row_number() over (order by yr) as slot from subs), rolled as (select perm, yr, row_number() over (partition by perm order by case when perm = 0 then 0 else {keyed_sql('perm', 'yr')} end, yr) as slot from range({N_PERM + 1}) p(perm), subs), dealt as (select perm, yr, slots.era as e from rolled join slots using (slot)), d as (select perm, kind, round(avg(mean) filter (e = 'early') - avg(mean) filter (e <> 'early'), 9) as d from c join dealt using (yr) group by all)",
    sql=f"select kind, round(o.d, 2) as diff, ((select count(*) from d n where n.kind = o.kind and n.perm > 0 and abs(n.d) >= abs(o.d)) + 1) / {N_PERM + 1}::double as p from d o where perm = 0",
)
def rich_club_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inference.group_permutation_p(class_means(spark, sf_dir), "yr", "era", "early", "mean", ["kind"], N_PERM), "diff", digits=2)


@query(
    CLASSES,
    f"nb as (select kind, era, mean, row_number() over (partition by kind, era order by yr) - 1 as k, count(*) over (partition by kind, era) as n from c), dr as (select perm, kind, era, {keyed_sql('perm', 'k')} % n as k from nb, range(1, 41) p(perm)), gp as (select perm, kind, avg(mean) filter (era = 'early') - avg(mean) filter (era <> 'early') as d from dr join nb using (kind, era, k) group by all)",
    sql="select kind, round(quantile_cont(d, 0.025), 2) as lo, round(quantile_cont(d, 0.975), 2) as hi from gp group by all",
)
def rich_club_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the difference of means, early less late."""
    return rounded(inference.difference_interval(class_means(spark, sf_dir), "yr", "era", "early", "mean", 40, ["kind"]), "lo", "hi", digits=2)


@query(CLASSES, "ra as (select kind, era, mean, row_number() over (partition by kind, era order by mean) as r, count(*) over (partition by kind, era) as n from c)", sql="select kind, era, max(n) as n, round(avg(mean), 2) as mean, round(median(mean), 2) as median, round(avg(mean) filter (r > floor(0.1 * n) and r <= n - floor(0.1 * n)), 2) as trimmed from ra group by all")
def rich_club_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    cell = Window.partitionBy("kind", "era")
    ranked = class_means(spark, sf_dir).withColumns({"r": F.row_number().over(cell.orderBy("mean")), "n": F.count("*").over(cell)})
    k = F.floor(0.1 * F.col("n"))
    found = ranked.groupBy("kind", "era").agg(F.max("n").alias("n"), F.avg("mean").alias("mean"), F.percentile("mean", 0.5).alias("median"), F.avg(F.when((F.col("r") > k) & (F.col("r") <= F.col("n") - k), F.col("mean"))).alias("trimmed"))
    return rounded(found, "mean", "median", "trimmed", digits=2)


def _reference(mode: str, threshold: float | None, sql: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return inference.reference_graph(trade(spark, sf_dir), mode, threshold)

    run.__name__ = f"reference_graph_{mode}"
    return query(TRADE, "mw as (select i, j, avg(w) as m from trade where i < j group by all)", sql=sql)(run)


reference_graph_positive = _reference("positive", None, "select i, j from mw where m > 0")
reference_graph_density = _reference("density", 0.1, "select i, j from mw where m >= (select min(m) from (select m, row_number() over (order by m desc) as n from mw) where n <= (select round_even(0.1 * count(*), 0) from mw))")
reference_graph_value = _reference("value", 1000000.0, "select i, j from mw where m >= 1000000")


# Similarity with p. The tail is no SQL function: its thresholds by number of pairs are literal.


def least_t(alpha: float, df: int) -> float:
    """The t whose two-sided tail is ``alpha``."""
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if statistics.student_p(mid, df) > alpha else (lo, mid)
    return hi


def critical(alpha: float, most: int = 60) -> str:
    return "crit(n, t) as (values " + ", ".join(f"({n}, {least_t(alpha, n - 2)!r}::double)" for n in range(3, most)) + ")"


IGNORED = 7
MEANS = f"ok as (select parcel, parcel <> {IGNORED} and sum(value) <> 0 and not isnan(avg(value)) as ok from obs group by parcel)"


@query(OBS, RANKED, SIM, MEANS, sql="select i, j, a.ok and b.ok as valid, case when a.ok and b.ok then round(r, 6) else 0 end as r from sim join ok a on a.parcel = i join ok b on b.parcel = j")
def similarity_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(similarity.with_p(observations(spark, sf_dir), "parcel", KEYS, "value", ignored=[IGNORED]), "r").select("i", "j", "valid", "r")


@query()
def similarity_with_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.with_p(observations(spark, sf_dir), "parcel", KEYS, "value", ignored=[IGNORED])


@query(OBS, RANKED, SIM, critical(0.5 / 10), sql="select i, j, round(case when abs(r) >= 1 or abs(r * sqrt((n - 2) / nullif(1 - r * r, 0))) >= t then r else 0 end, 6) as r from sim join crit using (n) where i < j")
def similarity_p_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """r where p reaches alpha over the number of draws, else 0."""
    sim = similarity.with_p(observations(spark, sf_dir), "parcel", KEYS, "value").where("i < j")
    return rounded(similarity.kept_by_p(sim, 0.5, 10), "r").select("i", "j", "r")


@query(
    OBS,
    "kept as (select d.metabolite as dropped, o.* from obs o join (select distinct metabolite from obs) d on o.metabolite <> d.metabolite)",
    "ranked as (select *, rank() over (partition by dropped, parcel order by value) + (count(*) over (partition by dropped, parcel, value) - 1) / 2.0::double as rnk from kept)",
    "lo as (select a.dropped, a.parcel as i, b.parcel as j, corr(a.rnk, b.rnk) as r, count(*) as n from ranked a join ranked b using (dropped, metabolite, pert) where a.parcel < b.parcel group by all)",
    critical(0.5 / 10),
    sql="select dropped, i, j, round(case when abs(r * sqrt((n - 2) / nullif(1 - r * r, 0))) >= t then r else 0 end, 6) as r from lo join crit using (n)",
)
def leave_one_out_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    sim = similarity.leave_one_out(observations(spark, sf_dir), "parcel", "metabolite", ["pert"], "value").where("i < j")
    return rounded(similarity.kept_by_p(similarity.p_of(sim), 0.5, 10), "r").select("dropped", "i", "j", "r")


#: A design of a constant, two nuisances and the year, made orthonormal column by column.
ORTHONORMAL = """des as (select yr, yr % 2 as block, (yr * 37 % 5)::double as z1, (yr * yr % 3)::double as z2, yr::double as x from years),
  g0 as (select *, 1 / sqrt(count(*) over ()) as q0 from des),
  g1 as (select *, r1 / sqrt(sum(r1 * r1) over ()) as q1 from (select *, z1 - q0 * sum(z1 * q0) over () as r1 from g0)),
  g2 as (select *, r2 / sqrt(sum(r2 * r2) over ()) as q2 from (select *, z2 - q0 * sum(z2 * q0) over () - q1 * sum(z2 * q1) over () as r2 from g1)),
  g3 as (select *, r3 / sqrt(sum(r3 * r3) over ()) as q3 from (select *, x - q0 * sum(x * q0) over () - q1 * sum(x * q1) over () - q2 * sum(x * q2) over () as r3 from g2))"""
#: Ends in ``tt`` (perm, i, j, t), from ``left_`` (perm, i, j, yr, r).
NET_T = """tt as (select perm, i, j, round(case when e > 0 then a3 / sqrt(e) else 0 end, 9) as t from (
    select perm, i, j, a3, greatest(rr - a0 * a0 - a1 * a1 - a2 * a2 - a3 * a3, 0) / greatest((select count(*) from years) - 4, 1) as e from (
      select perm, i, j, sum(r * r) as rr, sum(r * q0) as a0, sum(r * q1) as a1, sum(r * q2) as a2, sum(r * q3) as a3 from left_ join g3 using (yr) group by all)))"""
NET_OUT = "select t.i, t.j, round(t / sqrt(1 + t * t), 6) as s, component, size, round(p, 6) as p from tt t left join placed q on q.perm = 0 and q.a = t.i and q.b = t.j left join ps using (component) where t.perm = 0"
RESIDUAL = "{y} - q0 * sum({y} * q0) over e - q1 * sum({y} * q1) over e - q2 * sum({y} * q2) over e"


def wide_design(stack: DataFrame) -> DataFrame:
    yr = F.col("yr")
    return stack.select("yr").distinct().select("yr", (yr % 2).alias("block"), (yr * 37 % 5).cast("double").alias("z1"), (yr * yr % 3).cast("double").alias("z2"), yr.cast("double").alias("x"))


def tested(found: inference.NetworkTest) -> DataFrame:
    both = found.t.join(found.edges, ["i", "j"], "left")
    return both.select("i", "j", F.round(F.col("t") / F.sqrt(1 + F.col("t") * F.col("t")), 6).alias("s"), "component", "size", F.round("p", 6).alias("p"))


@query(
    "recursive " + FULL,
    ORTHONORMAL,
    f"""own as (select i, j, yr, {RESIDUAL.format(y="w")} as r from full_ join g3 using (yr) where i < j window e as (partition by i, j)),
  slots as (select yr as from_, block, row_number() over (partition by block order by yr) as slot from des),
  rolled as (select perm, yr, block, row_number() over (partition by perm, block order by case when perm = 0 then 0 else {keyed_sql("perm", "yr")} end, yr) as slot from range({N_PERM + 1}) p(perm), des),
  left_ as (select perm, i, j, rolled.yr, r from own join slots on from_ = own.yr join rolled using (block, slot))""",
    NET_T,
    COMPONENTS.format(hit="abs(t) >= 1.5", n=N_PERM + 1),
    sql=NET_OUT,
)
def network_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole test in one call: two nuisances and a constant, dealt within blocks."""
    stack = full_trade(spark, sf_dir)
    return tested(inference.network_statistic(stack, wide_design(stack), "yr", "w", 1.5, N_PERM, "x", ["z1", "z2"], True, "block"))


def walk_sql(chains: str, swaps: int, seed: int = 2) -> str:
    """Common tables that end in ``ended`` (perm, img): labels of the linked nodes after keyed exchanges between neighbours; ``spots`` holds the nodes."""
    key = f"(perm + {seed * 1_000_003})"
    return f"""near as (select src, list(dst order by dst) as near from (select distinct src, dst from edges where src <> dst) group by src),
  nd as (select list(src order by src) as nodes from near),
  spots as materialized (select list(list_transform(near, lambda m: list_position(nodes, m)) order by src) as near, any_value(nodes) as nodes from near, nd),
  walk as (select perm, 0 as s, nodes as img from range(1, {chains} + 1) p(perm), spots union all
    select perm, s + 1, list_transform(img, lambda x, k: case when k = u then img[v] when k = v then img[u] else x end) from (
      select perm, s, img, u, ar[{keyed_sql(key, "(2 * s + 1)")} % len(ar) + 1] as v from (select perm, s, img, u, near[u] as ar from (
        select perm, s, img, near, {keyed_sql(key, "(2 * s)")} % len(nodes) + 1 as u from walk, spots where s < {swaps} * len(nodes))))),
  ended as materialized (select perm, img from walk, spots where s = {swaps} * len(nodes))"""


@query(
    "recursive " + EDGES,
    FULL[len(TRADE) + 2 :],
    ORTHONORMAL,
    walk_sql(f"({N_PERM} * (select count(*) from years))", 4),
    """rec as (select yr, row_number() over (order by yr) as k from years), up as (select yr, i, j, w from full_ where i < j),
  both_ as (from up union all select yr, j, i, w from up),
  map as (select (perm - 1) // (select count(*) from years) + 1 as perm, yr, node, image from (select perm, unnest(nodes) as node, unnest(img) as image from ended, spots) join rec on rec.k = (perm - 1) % (select count(*) from years) + 1),
  whole as (from map union all select perm, yr, node, node from (select distinct yr, i as node from both_ where i not in (select unnest(nodes) from spots)), (select distinct perm from map)),
  moved as (select x.perm, b.yr, x.node as i, y.node as j, w from both_ b join whole x on x.yr = b.yr and x.image = b.i join whole y on y.yr = b.yr and y.perm = x.perm and y.image = b.j where x.node < y.node union all select 0, yr, i, j, w from up)""",
    f"left_ as (select perm, i, j, yr, {RESIDUAL.format(y='w')} as r from (select *, count(*) over (partition by perm, i, j) as n from moved) join g3 using (yr) where n = (select count(*) from years) window e as (partition by perm, i, j))",
    NET_T,
    COMPONENTS.format(hit="abs(t) >= 1.5", n=N_PERM + 1),
    sql=NET_OUT,
)
def network_statistic_relabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every year's nodes exchange labels with neighbours."""
    stack = full_trade(spark, sf_dir)
    found = inference.network_statistic(stack, wide_design(stack), "yr", "w", 1.5, N_PERM, "x", ["z1", "z2"], True, adjacency=edges(spark, sf_dir))
    return tested(found)


@query(
    "recursive " + EDGES,
    walk_sql("20", 10),
    """late as (select i, j, avg(w) as w from trade where yr >= 1998 group by all),
  seen as (select row_number() over (order by min(perm)) as perm, img from ended group by img),
  map as (select perm, unnest(nodes) as node, unnest(img) as image from seen, spots),
  nn as (select i as node from pop union select j from pop),
  whole as (from map union all select perm, node, node from nn, (select perm from seen) where node not in (select unnest(nodes) from spots)),
  moved as (select x.perm, x.node as i, y.node as j, w as wa from pop join whole x on x.image = i join whole y on y.perm = x.perm and y.image = j where x.node < y.node union all select 0, i, j, w from pop where i < j),
  met as (select perm, wa, late.w as wb from moved join late using (i, j)),
  ranked as (select perm, rank() over (partition by perm order by wa) + (count(*) over (partition by perm, wa) - 1) / 2.0::double as ra, rank() over (partition by perm order by wb) + (count(*) over (partition by perm, wb) - 1) / 2.0::double as rb from met),
  rs as (select perm, round(corr(ra, rb), 12) as r from ranked group by perm)""",
    sql="select round(o.r, 6) as r, count(*) as perms, count(*) filter (n.r >= o.r)::double / count(*) as p from rs o, rs n where o.perm = 0 and n.perm > 0 group by o.r",
)
def spatial_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct relabellings between neighbours only."""
    stack = trade(spark, sf_dir)
    m, late = (rows.groupBy("i", "j").agg(F.avg("w").alias("w")) for rows in (stack, stack.where("yr >= 1998")))
    return rounded(nulls.spatial_test(m, late, nulls.distinct_labels(edges(spark, sf_dir), 20)), "r")


@query(
    EDGES,
    f"""nn as (select i as node from trade where i < j union select j from trade where i < j),
  dg as (select node, count(src) as degree from nn left join edges on src = node group by node),
  hubs as (select node from dg where degree >= (select quantile_cont(degree, 0.75) from dg)),
  c as materialized (select yr, case when yr < 1998 then 'first' else 'other' end as g, case (i in (from hubs))::int + (j in (from hubs))::int when 2 then 'rich-club' when 1 then 'feeder' else 'peripheral' end as kind, avg(w) as mean from trade where i < j group by all),
  kinds as (select unnest(['rich-club', 'feeder', 'peripheral']) as kind),
  m as (select kind, g, count(*) as n, avg(mean) as mean, median(mean) as med, var_samp(mean) as v, list_sort(list(mean)) as l, floor(0.34 * count(*))::int as k from c group by all),
  mt as (select *, case when 2 * k >= n then med else list_avg(l[k + 1 : n - k]) end as tri from m),
  ab as (select a.kind, a.n as n1, b.n as n2, a.mean as m1, b.mean as m2, a.med as d1, b.med as d2, a.tri as t1, b.tri as t2, a.v as v1, b.v as v2 from mt a join mt b on a.kind = b.kind and a.g = 'first' and b.g = 'other'),
  subs as (select distinct yr, g from c), slots as (select g, row_number() over (order by yr) as slot from subs),
  rolled as (select perm, yr, row_number() over (partition by perm order by case when perm = 0 then 0 else {keyed_sql("perm", "yr")} end, yr) as slot from range({N_PERM + 1}) p(perm), subs),
  dealt as (select perm, yr, slots.g as e from rolled join slots using (slot)),
  ds as materialized (select perm, kind, round(avg(mean) filter (e = 'first') - avg(mean) filter (e <> 'first'), 9) as d from c join dealt using (yr) group by all),
  ps as (select kind, ((select count(*) from ds n where n.kind = o.kind and n.perm > 0 and abs(n.d) >= abs(o.d)) + 1) / {N_PERM + 1}::double as p from ds o where perm = 0),
  pq as (select kind, coalesce(p, 1.0) as p, row_number() over (order by coalesce(p, 1.0), kind) as r from kinds left join ps using (kind)),
  qs as (select kind, p, least(1.0, min(p * 3 / r) over (order by r desc)) as q from pq),
  nb as (select kind, g, mean, row_number() over (partition by kind, g order by yr) - 1 as k, count(*) over (partition by kind, g) as n from c),
  dr as (select perm, kind, g, {keyed_sql("perm", "k")} % n as k from nb, range(1, 41) p(perm)),
  gp as (select perm, kind, avg(mean) filter (g = 'first') - avg(mean) filter (g <> 'first') as d from dr join nb using (kind, g, k) group by all),
  ci as (select kind, quantile_cont(d, 0.025) as lo, quantile_cont(d, 0.975) as hi from gp group by all)""",
    sql="""select kind, coalesce(n1, 0) as n_first, coalesce(n2, 0) as n_other, round(m1, 2) as mean_first, round(m2, 2) as mean_other, round(d1, 2) as median_first, round(d2, 2) as median_other,
  round(t1, 2) as trimmed_first, round(t2, 2) as trimmed_other, round(m1 - m2, 2) as diff, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 4) as t,
  round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 4) as d, round(p, 6) as p_perm, round(q, 6) as q_perm, round(lo, 2) as lo, round(hi, 2) as hi
  from kinds left join ab using (kind) left join qs using (kind) left join ci using (kind)""",
)
def rich_club_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole comparison of two eras in one call; p by Welch's t is tested by hand."""
    stack = trade(spark, sf_dir).withColumn("era", F.when(F.col("yr") < 1998, "early").otherwise("late"))
    found = inference.compare_rich_club(stack, "yr", "w", "era", "early", N_PERM, 40, 0.25, reference=edges(spark, sf_dir).select(F.col("src").alias("i"), F.col("dst").alias("j")), trim=0.34)
    values = ["mean_first", "mean_other", "median_first", "median_other", "trimmed_first", "trimmed_other", "diff", "lo", "hi"]
    return rounded(rounded(rounded(found, *values, digits=2), "t", "d", digits=4), "p_perm", "q_perm").drop("p_t", "q_t")
