"""Graphs and paths over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogue import query
from ..operators import graph, nulls, statistics
from .parcel_queries import rounded
from .views import EDGES, NODEVAL, VOX, edges, node_values, table, trade, voxels

DEG = EDGES + ", deg as (select src as node, count(*) as degree from edges group by all)"
HUB = DEG + ", hub as (select node, degree from deg where degree >= (select quantile_cont(degree, 0.75) from deg))"
START = "(select min(src) from edges)"
PATHS = (
    "recursive "
    + EDGES
    + f""", paths as (select {START}::varchar || ',' || dst as path, dst as last, 1 as n from edges where src = {START}
  union all select path || ',' || dst, dst, n + 1 from paths join edges on src = last where n < 4 and instr(',' || path || ',', ',' || dst || ',') = 0)"""
)
STEPS = PATHS + ", " + NODEVAL + ", steps as (select path as path_id, unnest(range(len(string_split(path, ',')))) as pos, unnest(string_split(path, ','))::int as node from paths), valued as (select path_id, pos, steps.node, v from steps join nodeval using (node))"
GRAD = STEPS + """, g as (select *, case when lag(v) over w is null and lead(v) over w is null then 0 when lag(v) over w is null then lead(v) over w - v when lead(v) over w is null then v - lag(v) over w
  else (lead(v) over w - lag(v) over w) / 2 end as grad from valued window w as (partition by path_id order by pos))"""
SCORES = (
    GRAD
    + """, s as (select path_id, count(*) as nodes, sum(grad * grad) as grad2 from g group by all),
  h as (select path_id, least(floor(v / 5.0::double * 6), 5) as b, count(*) as c from valued group by all),
  e as (select path_id, -sum(p * ln(p)) / ln(6) as entropy from (select path_id, c / sum(c) over (partition by path_id)::double as p from h) group by all)"""
)


def first_node(found: DataFrame) -> int:
    """A driver-sized fact: the least node of a graph of parcels."""
    return found.agg(F.min("src")).first()[0]


def paths(spark: SparkSession, sf_dir: str, e: DataFrame | None = None) -> DataFrame:
    e = edges(spark, sf_dir) if e is None else e
    return graph.simple_paths(e, first_node(e), 4)


def valued_steps(spark: SparkSession, sf_dir: str, e: DataFrame | None = None) -> DataFrame:
    return graph.with_path_ids(paths(spark, sf_dir, e)).join(node_values(spark, sf_dir), "node")


@query(DEG, sql="from deg")
def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degree(edges(spark, sf_dir))


@query(HUB, sql="from hub")
def hubs_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.hubs_by_quantile(edges(spark, sf_dir), 0.25)


@query(
    DEG,
    "ks as (select distinct degree - 1 as k from deg)",
    "n as (select k, (select count(*) from deg where degree > k) as nodes, (select count(*) from edges e join deg a on a.node = src join deg b on b.node = dst where src < dst and least(a.degree, b.degree) > k) as links from ks)",
    sql="select k, nodes::bigint as nodes, links::bigint as links, round(2 * links / (nodes * (nodes - 1))::double, 6) as phi from n where nodes >= 2",
)
def rich_club_coef(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graph.rich_club(edges(spark, sf_dir)), "phi")


@query(
    HUB,
    sql="select yr, case (i in (select node from hub))::int + (j in (select node from hub))::int when 2 then 'rich-club' when 1 then 'feeder' else 'peripheral' end as kind, round(avg(w), 3) as mean from trade where i < j group by all",
)
def rich_club_class_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    hubs = graph.hubs_by_quantile(edges(spark, sf_dir), 0.25)
    return rounded(graph.rich_club_means(trade(spark, sf_dir), hubs, "yr"), "mean", digits=3)


FACES = (
    VOX
    + """, v as (select distinct x, y, z, block as l from vox), f as (select a.l as src, b.l as dst, count(*) as n from v a join v b on (b.x = a.x + 1 and b.y = a.y and b.z = a.z) or (b.x = a.x and b.y = a.y + 1 and b.z = a.z) or (b.x = a.x and b.y = a.y and b.z = a.z + 1) where a.l <> b.l group by all),
  adj as (select src, dst, sum(n)::bigint as n from (select src, dst, n from f union all select dst, src, n from f) group by all)"""
)


@query(FACES, sql="from adj")
def label_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.label_adjacency(voxels(spark, sf_dir), "block")


@query(
    "recursive " + FACES,
    "hop as (select src, dst, 1 as hops from adj union select hop.src, adj.dst, hops + 1 from hop join adj on hop.dst = adj.src where hops < 3)",
    sql="select src, dst, min(hops)::int as hops from hop where src <> dst group by all",
)
def k_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.k_hop(graph.label_adjacency(voxels(spark, sf_dir), "block"), 3)


@query(
    "recursive " + EDGES,
    "reach as (select src as node, src as to_ from edges union select reach.node, edges.dst from reach join edges on edges.src = reach.to_)",
    sql="select node, min(to_) as component from reach group by all",
)
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(edges(spark, sf_dir))


@query(
    "recursive " + EDGES,
    "reach as (select src as node, src as to_ from edges union select reach.node, edges.dst from reach join edges on edges.src = reach.to_)",
    sql="select a.node as a, b.node as b, exists (from reach where reach.node = a.node and to_ = b.node) as reachable from (select distinct node from reach) a, (select distinct node from reach) b where a.node < b.node",
)
def has_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = graph.components(edges(spark, sf_dir))
    a, b = c.select(F.col("node").alias("a"), F.col("component").alias("ca")), c.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", (F.col("ca") == F.col("cb")).alias("reachable"))


@query(PATHS, sql="select path, n as length from paths")
def simple_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths(spark, sf_dir).select(F.array_join(F.col("nodes").cast("array<string>"), ",").alias("path"), "length")


@query(
    PATHS,
    "best as (select last as node, min(n) as n from paths group by all)",
    f"listed as (select node, best.n, path, string_split(path, ',')::int[] as p from best join paths on last = node and paths.n = best.n)",
    sql=f"select node, n as length, arg_min(path, p) as path from listed group by all union all select {START}, 0, {START}::varchar",
)
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    found = graph.shortest_paths(e, first_node(e), 4)
    return found.select("node", "length", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


@query(GRAD, sql="select path_id, pos, node, round(grad, 6) as grad from g")
def path_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graph.path_gradient(valued_steps(spark, sf_dir), "v"), "grad").select("path_id", F.col("pos").cast("long").alias("pos"), "node", "grad")


@query(SCORES, sql="select path_id, nodes, round(grad2, 6) as grad2, round(entropy, 6) as entropy, round(grad2 / nullif(entropy, 0), 5) as cost from s join e using (path_id)")
def path_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = graph.path_scores(valued_steps(spark, sf_dir), "v", 0.0, 5.0, 6)
    return rounded(rounded(scored, "grad2", "entropy"), "cost", digits=5).withColumn("cost", F.round("cost", 5))


@query(SCORES, "c as (select path_id, nodes, round(grad2 / nullif(entropy, 0), 5) as cost from s join e using (path_id))", sql="select nodes, arg_min(path_id, (cost, path_id)) as path_id, min(cost) as cost from c where cost is not null group by all")
def best_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = graph.path_scores(valued_steps(spark, sf_dir), "v", 0.0, 5.0, 6).withColumn("cost", F.round("cost", 5)).where("cost is not null")
    return scored.groupBy("nodes").agg(F.min_by("path_id", F.struct("cost", "path_id")).alias("path_id"), F.min("cost").alias("cost"))


@query(STEPS, sql="select path_id, count(*) as nodes from valued group by all having bool_and(v > 0.5)")
def path_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = graph.with_path_ids(paths(spark, sf_dir))
    kept = graph.whitelisted(steps, node_values(spark, sf_dir).where("v > 0.5"))
    return kept.groupBy("path_id").agg(F.count("*").alias("nodes"))


@query(
    STEPS,
    "inner_ as (select path_id, pos, node as old, lag(node) over w as p, lead(node) over w as n from steps window w as (partition by path_id order by pos))",
    sql="select distinct path_id, pos, old, a.dst as new from inner_ i join edges a on a.src = p join edges b on b.src = n and b.dst = a.dst where p is not null and n is not null and not exists (from steps t where t.path_id = i.path_id and t.node = a.dst)",
)
def perturb_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return graph.perturbed(graph.with_path_ids(paths(spark, sf_dir, e)), e).withColumn("pos", F.col("pos").cast("long"))


@query(NODEVAL, sql="select round(count(*) * sum(v * v) - sum(v) ** 2, 4) as energy from nodeval")
def free_energy_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graph.energy_all(node_values(spark, sf_dir), "v"), "energy", digits=4)


@query(
    "v as (select embedding[1]::double as v from embeddings), r as (select round_even(2 * count(*) ** (1 / 3::double), 0)::int as b, min(v) as lo, max(v) as hi from v), c as (select least(floor((v - lo) / (hi - lo) * b), b - 1) as k, count(*)::double as n from v, r group by all)",
    "p as (select n / sum(n) over () as p from c)",
    sql="select round((select count(*) * sum(v * v) - sum(v) ** 2 from v), 3) as energy, round(-sum(p * log10(p)), 6) as entropy from p",
)
def free_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy of all pairs and entropy of the vectors' first coordinates."""
    values = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding")[0].cast("double").alias("v"))
    return rounded(rounded(graph.free_energy(values, "v"), "energy", digits=3), "entropy")


@query(EDGES, NODEVAL, sql="select round(sum((a.v - b.v) ** 2), 4) as energy from edges join nodeval a on a.node = src join nodeval b on b.node = dst where src < dst")
def free_energy_adj(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graph.energy_adjacent(node_values(spark, sf_dir), edges(spark, sf_dir), "v"), "energy", digits=4)


@query()
def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.label_propagation(edges(spark, sf_dir))


@query(STEPS, "o as (select path_id, pos, node, v, first_value(v) over w as f, last_value(v) over w as l, max(v) over () as top from valued window w as (partition by path_id order by pos rows between unbounded preceding and unbounded following))", sql="select path_id, pos, node, round(case when f > l then top - v else v end, 6) as v from o")
def path_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graph.oriented(valued_steps(spark, sf_dir), "v"), "v").select("path_id", F.col("pos").cast("long").alias("pos"), "node", "v")


@query(EDGES, NODEVAL, sql="select src, dst, w from edges where src in (select node from nodeval where v > 1) and dst in (select node from nodeval where v > 1)")
def restricted_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.restricted(edges(spark, sf_dir), node_values(spark, sf_dir).where("v > 1"))


@query(
    HUB,
    "m as (select yr, case (i in (select node from hub))::int + (j in (select node from hub))::int when 2 then 'rich-club' when 1 then 'feeder' else 'peripheral' end as kind, avg(w) as mean from trade where i < j group by all)",
    "s as (select kind, count(*) filter (yr < 1998) na, count(*) filter (yr >= 1998) nb, avg(mean) filter (yr < 1998) ma, avg(mean) filter (yr >= 1998) mb, var_samp(mean) filter (yr < 1998) va, var_samp(mean) filter (yr >= 1998) vb from m group by all)",
    sql="select kind, round(ma - mb, 2) as diff, round((ma - mb) / sqrt(va / na + vb / nb), 4) as t, round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 4) as d from s",
)
def rich_club_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Early against late years, by class of links."""
    hubs = graph.hubs_by_quantile(edges(spark, sf_dir), 0.25)
    means = graph.rich_club_means(trade(spark, sf_dir), hubs, "yr").withColumn("era", F.when(F.col("yr") < 1998, "early").otherwise("late"))
    found = statistics.two_groups(means, "era", "early", "late", "mean", ["kind"])
    return rounded(rounded(found, "diff", digits=2), "t", "d", digits=4).select("kind", "diff", "t", "d")


@query()
def rich_club_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """phi of each k against rewired graphs: median of the null, and p = (count(null >= phi) + 1) / (n + 1)."""
    e, n = edges(spark, sf_dir), 20
    phi = graph.rich_club(e)
    null = nulls.rewired(e, n).join(graph.degree(e).withColumnRenamed("node", "src"), "src").withColumnRenamed("degree", "a").join(graph.degree(e).withColumnRenamed("node", "dst"), "dst").withColumnRenamed("degree", "b")
    per_k = null.join(F.broadcast(phi.select("k", "nodes")), F.least("a", "b") > F.col("k")).groupBy("perm", "k", "nodes").agg(F.count("*").alias("e"))
    per_k = per_k.withColumn("null_phi", 2 * F.col("e") / (F.col("nodes") * (F.col("nodes") - 1)))
    stats = per_k.join(F.broadcast(phi.select("k", "phi")), "k").groupBy("k", "phi").agg(F.median("null_phi").alias("null_median"), ((F.count_if(F.col("null_phi") >= F.col("phi")) + 1) / F.lit(n + 1.0)).alias("p"))
    return stats


@query()
def bandwidth_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nulls.bandwidth_order(edges(spark, sf_dir))
