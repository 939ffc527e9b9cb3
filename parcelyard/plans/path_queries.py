"""Path costs, perturbations and interpolation over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogue import query
from ..operators import graph, paths
from .graph_queries import GRAD, PATHS, START, STEPS, first_node, valued_steps
from .graph_queries import paths as found_paths
from .parcel_queries import rounded
from .views import EDGES, NODEVAL, edges, node_values

STRENGTH = "strength as (select src as node, sum(w) as strength from edges group by all), energy as (select sum(w) as e from edges)"
SIZED = GRAD + ", sized as (select *, count(*) over (partition by path_id) as n, min(v) over (partition by path_id) as lo, max(v) over (partition by path_id) as hi from g)"


def strengths(e: DataFrame) -> DataFrame:
    return e.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("strength"))


def energy(e: DataFrame) -> float:
    return e.agg(F.sum("w")).first()[0]  # one number


@query(STEPS, sql="select path_id, pos, node as src, nxt as dst from (select *, lead(node) over (partition by path_id order by pos) as nxt from steps) where nxt is not null")
def path_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.path_edges(graph.with_path_ids(found_paths(spark, sf_dir))).withColumn("pos", F.col("pos").cast("long"))


@query(SIZED, sql="select path_id, pos, round((grad - (hi - lo) / n) / n, 6) as grad from sized")
def path_gradient_detrended(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = paths.scaled_gradient(valued_steps(spark, sf_dir), "v", detrend=True)
    return rounded(graded, "grad").select("path_id", F.col("pos").cast("long").alias("pos"), "grad")


@query(SIZED, sql="select path_id, pos, round(((grad - 5.0::double / n) / n + 5.0::double * (n + 1) / (n * n)) / (2 * 5.0::double * (n + 1) / (n * n)), 6) as grad from sized")
def path_gradient_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = paths.scaled_gradient(valued_steps(spark, sf_dir), "v", 0.0, 5.0, detrend=True, normalise=True)
    return rounded(graded, "grad").select("path_id", F.col("pos").cast("long").alias("pos"), "grad")


@query(GRAD, STRENGTH, sql="select path_id, round(avg(abs(grad)) * (count(*) - 1) / count(*) - 0.5 * avg(strength) / any_value(e), 6) as cost from g join strength using (node), energy group by all")
def path_node_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    steps = valued_steps(spark, sf_dir, e).join(strengths(e), "node")
    return rounded(paths.node_cost(steps, "v", "strength", energy(e)), "cost")


@query(
    SIZED,
    "nab as (select path_id, sum((grad / n) ** 2) / nullif(2 * (max(hi - lo) / max(n)) ** 2, 0) as nabla from sized group by all)",
    "hist as (select path_id, case when hi > lo then least(floor((v - lo) / (hi - lo) * 6), 5) else 3 end as b, count(*) as c from sized group by all)",
    "ent as (select path_id, -sum(p * ln(p)) / ln(6) as entropy from (select path_id, c / sum(c) over (partition by path_id)::double as p from hist) group by all)",
    sql="select path_id, round(nabla / nullif(entropy, 0), 5) as total, round(nabla, 6) as nabla, round(entropy, 6) as entropy from nab join ent using (path_id)",
)
def path_total_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = paths.total_cost(valued_steps(spark, sf_dir), "v", 25)  # 25 nations: six bins
    return rounded(rounded(found, "nabla", "entropy"), "total", digits=5)


PERTURBED = STEPS + """, around as (select path_id, pos, node, lag(node) over w as p, lead(node) over w as n from steps window w as (partition by path_id order by pos)),
  options as (select distinct path_id, pos, a.dst as to_, 1 as change from around join edges a on a.src = p join edges b on b.src = n and b.dst = a.dst where a.dst <> node union all select path_id, pos, node, 0 from steps),
  lasts as (select path_id, max(pos) as last_pos from steps group by all),
  built as (select path_id, 0::bigint as pos, [to_] as nodes, change as changed from options where pos = 0
    union all select built.path_id, options.pos, list_append(nodes, to_), changed + change from built join options on options.path_id = built.path_id and options.pos = built.pos + 1 join edges on src = nodes[-1] and dst = to_ where not list_contains(nodes, to_)),
  whole as (select path_id, nodes, changed from built join lasts using (path_id) where pos = last_pos and changed > 0)"""


@query(PERTURBED, sql="select path_id, array_to_string(nodes, ',') as nodes, changed from whole")
def perturb_several(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    found = paths.perturbed_anywhere(graph.with_path_ids(found_paths(spark, sf_dir, e)), e, 5)
    return found.select("path_id", F.array_join(F.col("nodes").cast("array<string>"), ",").alias("nodes"), "changed")


@query(PERTURBED, sql="select path_id, array_to_string(nodes, ',') as nodes, changed from (select *, row_number() over (partition by path_id order by changed, nodes) as k from whole) where k <= 2")
def perturb_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    found = paths.perturbed_anywhere(graph.with_path_ids(found_paths(spark, sf_dir, e)), e, 5, most=2)
    return found.select("path_id", F.array_join(F.col("nodes").cast("array<string>"), ",").alias("nodes"), "changed")


@query(
    GRAD,
    STRENGTH,
    "cost as (select path_id, count(*) as n, round(avg(abs(grad)) * (count(*) - 1) / count(*) - 0.5 * avg(strength) / any_value(e), 9) as cost, list(node order by pos) as nodes from g join strength using (node), energy group by all)",
    sql=f"select nodes[-1] as goal, arg_min(array_to_string(nodes, ','), (cost, nodes)) as path from cost where n = 4 group by all",
)
def best_exact_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the paths of four nodes from the first node to each other one, the one of least cost."""
    e = edges(spark, sf_dir)
    start, total = first_node(e), energy(e)
    values = node_values(spark, sf_dir).join(strengths(e), "node")
    found = paths.best_exact(e, start, values, 4, total, 0.5)
    return found.select("goal", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


@query(STEPS, "c as (select path_id, count(*) filter (v < 0.5) as gaps from valued group by all)", sql="select path_id, pos, node from valued join c using (path_id) where gaps <= 1")
def paths_with_few_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = valued_steps(spark, sf_dir).withColumn("v", F.when(F.col("v") >= 0.5, F.col("v")))
    return graph.few_gaps(steps, "v").select("path_id", F.col("pos").cast("long").alias("pos"), "node")


@query(
    EDGES,
    NODEVAL,
    f"cand as (select {START} as node union select dst from edges where src = {START})",
    sql="select node, round(v, 6) as v from nodeval join cand using (node) order by abs(v - 2.0) desc, node limit 1",
)
def adjusted_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return rounded(graph.adjusted_end(first_node(e), node_values(spark, sf_dir), e, 2.0), "v").select("node", "v")


@query(PATHS, f"best as (select last as node, min(n) as n from paths group by all), far as (select max(node) as goal from best)", sql="select 0 as leg, n as length, arg_min(path, string_split(path, ',')::int[]) as path from paths join far on last = goal where n = (select n from best where node = goal) group by all")
def path_through_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    start = first_node(e)
    goal = found_paths(spark, sf_dir, e).agg(F.max(F.element_at("nodes", -1))).first()[0]
    return graph.through(e, [start, goal], 4).select("leg", "length", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))
