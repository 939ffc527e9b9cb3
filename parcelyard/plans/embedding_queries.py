"""Embeddings, clusterings and series over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalogue import query
from ..operators import embedding, nulls, spectral
from .graph_queries import edges
from .parcel_queries import rounded
from .views import PROF, TRADE, profiles, table, trade

CORNERS = [(-0.3, -0.3), (0.4, -0.2), (0.0, 0.4)]
RUNS = "runs as (select vec_id % 60 as node, r as run, (sum(vec_id * 7 + label * r * 3)::bigint + r) % 4 as label from prof, range(5) t(r) group by vec_id % 60, r)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles(spark, sf_dir).select("vec_id", F.element_at("e", 1).alias("x"), F.element_at("e", 2).alias("y"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five made-up clusterings of sixty nodes, which stand for parcels; all profiles go into them."""
    p = profiles(spark, sf_dir).crossJoin(spark.range(5).withColumnRenamed("id", "run"))
    total = F.sum(F.col("vec_id") * 7 + F.col("label") * F.col("run") * 3)
    return p.groupBy((F.col("vec_id") % 60).alias("node"), "run").agg(((total + F.col("run")) % 4).alias("label"))


def _weights() -> str:
    (ax, ay), (bx, by), (cx, cy) = CORNERS
    area = (by - cy) * (ax - cx) + (cx - bx) * (ay - cy)
    w0 = f"(({by - cy}::double) * (x - {cx}::double) + ({cx - bx}::double) * (y - {cy}::double)) / {area}::double"
    w1 = f"(({cy - ay}::double) * (x - {cx}::double) + ({ax - cx}::double) * (y - {cy}::double)) / {area}::double"
    return f"w as (select vec_id, greatest(0, least(1, w0)) a, greatest(0, least(1, w1)) b, greatest(0, least(1, 1 - w0 - w1)) c from (select vec_id, {w0} as w0, {w1} as w1 from (select vec_id, e[1] as x, e[2] as y from prof)))"


@query(PROF, _weights(), sql="select vec_id, round(coalesce(a / nullif(a + b + c, 0), 0), 6) as w0, round(coalesce(b / nullif(a + b + c, 0), 0), 6) as w1, round(coalesce(c / nullif(a + b + c, 0), 0), 6) as w2 from w")
def triangle_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(embedding.barycentric(points(spark, sf_dir), CORNERS), "w0", "w1", "w2").select("vec_id", "w0", "w1", "w2")


@query(
    PROF,
    "pt as (select vec_id as n, e[1] as x, e[2] as y from prof)",
    sql="select a.n as a, b.n as b, c.n as c, round(abs((b.x - a.x) * (c.y - a.y) - (c.x - a.x) * (b.y - a.y)) / 2, 9) as area from pt a join pt b on a.n < b.n join pt c on b.n < c.n order by area desc, a, b, c limit 1",
)
def triangle_max_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.largest_triangle(points(spark, sf_dir), "vec_id")


@query(PROF, RUNS, sql="select a.node as i, b.node as j, count(*) / 5.0::double as share from runs a join runs b using (run, label) where a.node < b.node group by all")
def coassociation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.coassociation(runs(spark, sf_dir), "run", "node", "label")


@query(PROF, RUNS, sql="select node, label from (select node, label, row_number() over (partition by node order by count(*) desc, min(run), label) as n from runs group by node, label) where n = 1")
def majority_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.majority_label(runs(spark, sf_dir), "run", "node", "label")


@query(
    PROF,
    RUNS,
    "o as (select a.label, b.label as base, row_number() over (partition by a.label order by count(*) desc, b.label) as n from runs a join runs b on a.node = b.node and a.run = 1 and b.run = 0 group by a.label, b.label)",
    sql="select node, coalesce(base, runs.label) as label from runs left join (from o where n = 1) m on m.label = runs.label where run = 1",
)
def relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir)
    return embedding.relabelled(r.where("run = 1").select("node", "label"), r.where("run = 0").select("node", "label"), "node", "label")


SERIES = "series as (select user_id % 20 as s, event_id as pos, value from events)"


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("s"), F.col("event_id").alias("pos"), "value")


@query(
    SERIES,
    "n as (select *, row_number() over w as k, count(*) over (partition by s) as n, first_value(value) over w as f, last_value(value) over (partition by s order by pos rows between unbounded preceding and unbounded following) as l from series window w as (partition by s order by pos))",
    sql="select s, pos, round((sum(value) over (partition by s order by pos rows between 2 preceding and 2 following) + greatest(0, 2 - k + 1) * f + greatest(0, k + 2 - n) * l) / 5, 6) as smooth from n",
)
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(embedding.moving_average(series(spark, sf_dir), ["s"], "pos", "value", 5), "smooth").select("s", "pos", "smooth")


@query(
    SERIES,
    "n as (select *, (row_number() over (partition by s order by pos) - 1)::double / greatest(count(*) over (partition by s) - 1, 1) * 99 as at_ from series)",
    "m as (select *, lead(value) over (partition by s order by pos) as nv, lead(at_) over (partition by s order by pos) as na from n)",
    sql="select s, k::int as k, round(case when na is null then value else value + (nv - value) * (k - at_) / (na - at_) end, 6) as v from range(100) t(k) join m on k >= at_ and (na is null or k < na)",
)
def interp_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(embedding.interpolated(series(spark, sf_dir), ["s"], "pos", "value", 100), "v")


@query(
    SERIES,
    "g as (select s, pos, (value > 60)::int as gap, sum((value > 60)::int) over (partition by s order by pos) as island from series)",
    sql="select s, island::bigint as island, min(pos) as first, max(pos) as last, count(*) as n from g where gap = 0 group by all having count(*) >= 2",
)
def polyline_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = series(spark, sf_dir).withColumn("value", F.when(F.col("value") > 60, F.lit(float("nan"))).otherwise(F.col("value")))
    return embedding.islands(broken, ["s"], "pos", "value")


@query(sql="select n_nationkey as node, round(2 * pi() * n_nationkey / 25, 6) as angle, round(cos(2 * pi() * n_nationkey / 25), 6) as cx, round(sin(2 * pi() * n_nationkey / 25), 6) as cy from nation")
def circle_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"))
    return rounded(embedding.circle_layout(nodes, "node"), "angle", "cx", "cy")


@query(sql="select n_nationkey as node, round((1 + 2 * t) * cos(4 * pi() * t), 6) as sx, round((1 + 2 * t) * sin(4 * pi() * t), 6) as sy from (select n_nationkey, n_nationkey / 24.0::double as t from nation)")
def spiral_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"))
    return rounded(embedding.spiral(nodes, "node", 2, 1.0, 3.0), "sx", "sy")


#: Nations by their share of each year's trade; every two of them are compared.
SHARES = TRADE + """, nat as (select yr, i, sum(w) as s from trade group by all), shares as materialized (select yr, i, s / sum(s) over (partition by yr) as v from nat),
  gaps as materialized (select x.i, y.i as j, round(sqrt(sum((x.v - y.v) ** 2)), 9) as d from shares x join shares y on x.yr = y.yr and x.i <> y.i group by all),
  kn as materialized (select i, j, d from (select *, row_number() over (partition by i order by d, j) as n from gaps) where n <= 6)"""
#: Bisection of a row's bandwidth, written as steps of a recursion; an upper end not yet met is -1.
BANDWIDTH = """rows_ as (select i, list(d order by j) as ds, min(d) as rho, ln(count(*)) / ln(2) as want from kn group by i),
  steps as (select i, ds, rho, want, 0.0::double as lo, -1.0::double as hi, 1.0::double as mid, 0 as n from rows_
    union all select i, ds, rho, want, case when p > want then lo else mid end, case when p > want then mid else hi end,
      case when p > want then (lo + mid) / 2 when hi < 0 then mid * 2 else (mid + hi) / 2 end, n + 1
    from (select *, list_sum(list_transform(ds, lambda d: exp(-greatest(d - rho, 0) / mid))) as p from steps where n < 64)),
  sig as materialized (select i, rho, mid as sigma from steps where n = 64)"""


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, j, d): each nation's six nearest by yearly shares of trade."""
    sums = trade(spark, sf_dir).groupBy("yr", "i").agg(F.sum("w").alias("s"))
    shares = sums.select("yr", "i", (F.col("s") / F.sum("s").over(Window.partitionBy("yr"))).alias("v"))
    pairs = shares.join(shares.select("yr", F.col("i").alias("j"), F.col("v").alias("u")), "yr").where("i <> j")
    gaps = pairs.groupBy("i", "j").agg(F.round(F.sqrt(F.sum((F.col("v") - F.col("u")) * (F.col("v") - F.col("u")))), 9).alias("d"))
    return gaps.withColumn("n", F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))).where("n <= 6").drop("n")


@query("recursive " + SHARES, BANDWIDTH, sql="select i, round(rho, 6) as rho, round(sigma, 7) as sigma from sig")
def neighbour_bandwidth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.bandwidths(neighbours(spark, sf_dir)).select("i", F.round("rho", 6).alias("rho"), F.round("sigma", 7).alias("sigma"))


@query(
    "recursive " + SHARES,
    BANDWIDTH,
    "one as (select i, j, exp(-greatest(d - rho, 0) / sigma) as m from kn join sig using (i))",
    "two as (select i, j, max(m) as a, max(r) as b from (select i, j, m, 0.0::double as r from one union all select j, i, 0.0, m from one) group by i, j)",
    sql="select i, j, round(a + b - a * b, 5) as w from two",
)
def neighbour_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(embedding.memberships(neighbours(spark, sf_dir)), "w", digits=5)


@query()
def diffusion_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spectral.diffusion_positions(edges(spark, sf_dir), tolerance=1e-6), "p1", "p2", digits=4)


@query()
def pca_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, _ = embedding.principal_components(profiles(spark, sf_dir), "vec_id", "e", 5)
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(model.explainedVariance)], "component int, share double")


@query()
def kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.k_means(profiles(spark, sf_dir), "vec_id", "e", 5)


@query()
def gmm_bic(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = points(spark, sf_dir).select(F.array("x", "y").alias("e"))
    return embedding.mixture_scores(few, "e", [2, 3, 4])


@query()
def diffusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.diffusion_component(edges(spark, sf_dir))


@query()
def aligned_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three stretches of the vectors as three subjects' gradients in three dimensions, turned to their common mean."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    three = e.select("vec_id", F.posexplode(F.array(*(F.slice("e", 3 * k + 1, 3) for k in range(3))))).select(F.col("pos").alias("subject"), "vec_id", F.col("col").alias("g"))
    found, _ = embedding.aligned(three, "subject", "vec_id", "g", 3)
    return found.select("subject", "vec_id", *(F.round(F.get("g", F.lit(k)), 6).alias(f"g{k}") for k in range(3)))


@query(
    "recursive " + TRADE,
    """pts as (select i as node, yr as pos, sum(w) / 1e6 as v from trade group by all),
  l as (select node, list(v order by pos) as y, count(*)::int as n from pts group by node),
  b as materialized (select *, list_transform(range(2, n), lambda k: y[k + 1] - 2 * y[k] + y[k - 1]) as d from l where n >= 4),
  fw as (select node, 1 as k, 0.0::double as c, d[1] as dd from b union all select node, k + 1, 1 / (4 - c), (6 * d[k + 1] - dd) / (4 - c) from fw join b using (node) where k + 1 <= n - 3),
  bw as (select node, n - 2 as k, d[n - 2] as m from b union all select bw.node, bw.k - 1, fw.dd - fw.c * m from bw join fw on fw.node = bw.node and fw.k = bw.k - 1),
  inn as (select node, list(m order by k) as m from bw group by node),
  mm as (select node, list_concat(list_concat([2 * m[1] - m[2]], m), [2 * m[-1] - m[-2]]) as m, y, n from inn join b using (node)),
  pos_ as (select node, range as k, m, y, range * (n - 1) / 24.0::double as t, least(floor(range * (n - 1) / 24.0::double)::int, n - 2) as lo from mm, range(25)),
  cu as (select node, k, m[lo + 1] as ma, m[lo + 2] as mb, y[lo + 1] as ya, y[lo + 2] as yb, lo + 1 - t as ri, t - lo as le from pos_)""",
    sql="select node, k, round((ma * ri ** 3 + mb * le ** 3) / 6 + (ya - ma / 6) * ri + (yb - mb / 6) * le, 6) as v from cu",
)
def trade_spline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's yearly trade as a smooth curve of 25 points."""
    points = trade(spark, sf_dir).groupBy(F.col("i").alias("node"), F.col("yr").alias("pos")).agg((F.sum("w") / 1e6).alias("v"))
    return rounded(nulls.spline(points, "node", "pos", ["v"], 25), "v")
