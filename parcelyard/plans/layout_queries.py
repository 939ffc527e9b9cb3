"""Positions, colours, unions and labels over the driver's tables."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogue import query
from ..operators import graph, layout
from .parcel_queries import rounded
from .views import EDGES, NODEVAL, OBS, VOX, edges, node_values, observations, table, voxels

PLACES = "places as (select n_nationkey as node, cos(n_nationkey)::double as x, sin(2 * n_nationkey)::double as y, (n_nationkey % 7)::double as z from nation)"


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(k.alias("node"), F.cos(k).alias("x"), F.sin(2 * k).alias("y"), (k % 7).cast("double").alias("z"))


@query(EDGES, PLACES, sql="select src, dst, round(a.x, 6) as x0, round(a.y, 6) as y0, round(b.x, 6) as x1, round(b.z, 6) as z1 from edges join places a on a.node = src join places b on b.node = dst")
def direct_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layout.polylines(edges(spark, sf_dir), places(spark, sf_dir))
    line = F.col("line")
    return rounded(found.select("src", "dst", line[0]["x"].alias("x0"), line[0]["y"].alias("y0"), line[1]["x"].alias("x1"), line[1]["z"].alias("z1")), "x0", "y0", "x1", "z1")


@query(EDGES, PLACES, sql="select src, dst, round((a.x + b.x) / 2 - 0.18 * (b.y - a.y), 6) as cx, round((a.y + b.y) / 2 + 0.18 * (b.x - a.x), 6) as cy from edges join places a on a.node = src join places b on b.node = dst")
def control_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(layout.control_points(edges(spark, sf_dir), places(spark, sf_dir)), "cx", "cy")


@query(
    EDGES,
    "half as (select src, dst from edges where src < dst), ends as (select src, dst, 0 as side, src as node from half union all select src, dst, 1, dst from half), c as (select *, count(*) over (partition by node) as n, count(*) over (partition by node order by src, dst, side rows between unbounded preceding and current row) as seen from ends)",
    sql="select src, dst, max(n) filter (side = 0) as n_src, max(n) filter (side = 1) as n_dst, max(seen) filter (side = 0) as seen_src, max(seen) filter (side = 1) as seen_dst from c group by all",
)
def connection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.connection_counts(edges(spark, sf_dir).where("src < dst"), ["src", "dst"])


@query(EDGES, "an as (select node, ((node * 2.399963::double) % (2 * pi()) + 2 * pi()) % (2 * pi()) as a from (select distinct src as node from edges)), pk as (select node from an order by round(abs(a - 1.0), 12), node limit 1)", sql="select src, dst, w from edges where src = (from pk) or dst = (from pk)")
def picked_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    angles = e.select(F.col("src").alias("node")).distinct().withColumn("angle", F.col("node") * F.lit(2.399963))
    return layout.picked_links(e, angles, 1.0)


@query("lb as (select p_partkey - 1 as pos, p_type as name from part)", sql="select r.p as prefix, greatest(0, min(pos) - 0.5)::double as lo, (max(pos) + 0.5)::double as hi from lb join (values ('TIN'), ('STEEL'), ('SMALL'), ('none')) r(p) on contains(name, r.p) group by all")
def label_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "part").select((F.col("p_partkey") - 1).alias("pos"), F.col("p_type").alias("name"))
    prefixes = spark.range(1).select(F.explode(F.array(*map(F.lit, ("TIN", "STEEL", "SMALL", "none")))).alias("prefix"))
    return layout.label_ranges(labels, prefixes, "pos", "name", "prefix")


@query(EDGES, "mm as (select min(abs(w)) as lo, max(abs(w)) as hi from edges)", sql="select src, dst, round(case when hi = lo then 1.75 else 0.5 + (abs(w) - lo) / (hi - lo) * 2.5 end, 6) as width from edges, mm")
def link_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(layout.scaled_widths(edges(spark, sf_dir), "w", 0.5, 3.0), "width").select("src", "dst", "width")


@query(NODEVAL, "d as (select distinct v from nodeval), g as (select v - lag(v) over (order by v) as g from d)", sql="select round(min(g), 6) as gap from g")
def least_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(layout.least_gap(node_values(spark, sf_dir).select(F.col("v").alias("angle")).distinct()), "gap")


@query(
    PLACES,
    "br as (select n_nationkey - 3 as pos, n_nationkey as node from nation where n_nationkey >= 3), pl as (select * from places where node between 6 and 9), me as (select min(pos) as f from br join pl using (node)), fr as (select br.*, row_number() over (order by pos) - 1 as k, count(*) over () as n from br, me where pos >= f), an as (select x as ax, y as ay from fr join pl using (node) where k = 0), al as (select count(*) as a from br)",
    sql="select node, round(ax + 0.48 * k / (n - 1) * cos(atan2(ay, ax) + 2 * pi() * greatest(0.5, least(2.0, a / 8.0)) * k / (n - 1)), 6) as x, round(ay + 0.48 * k / (n - 1) * sin(atan2(ay, ax) + 2 * pi() * greatest(0.5, least(2.0, a / 8.0)) * k / (n - 1)), 6) as y from fr, an, al",
)
def branch_spiral(spark: SparkSession, sf_dir: str) -> DataFrame:
    branch = table(spark, sf_dir, "nation").where("n_nationkey >= 3").select((F.col("n_nationkey") - 3).alias("pos"), F.col("n_nationkey").alias("node"))
    return rounded(layout.branch_spiral(branch, places(spark, sf_dir).where("node between 6 and 9").select("node", "x", "y")), "x", "y")


@query("w as (select vec_id as node, abs(embedding[1])::double as w0, abs(embedding[2])::double as w1, abs(embedding[3])::double as w2 from embeddings), m as (select *, case when greatest(least(w0, 1), least(w1, 1), least(w2, 1)) <= 1e-9 then 1 else greatest(least(w0, 1), least(w1, 1), least(w2, 1)) end as top from w)", sql="select node, round(least(1, least(1, w0) / top), 6) as r, round(least(1, least(1, w1) / top), 6) as b, round(least(1, least(1, w2) / top), 6) as g, round(case when w0 + w1 + w2 > 0 then w1 * 0.5 + w2 end, 6) as scalar from m")
def triangle_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    w = e.select(F.col("vec_id").alias("node"), *(F.abs(F.col("embedding")[k].cast("double")).alias(f"w{k}") for k in range(3)))
    return rounded(layout.triangle_colours(w), "r", "g", "b", "scalar").select("node", "r", "g", "b", "scalar")


@query(EDGES, "late as (select (src + 1) % 25 as src, (dst + 1) % 25 as dst from edges)", sql="select src, dst from edges union select src, dst from late")
def united_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return layout.united(e, e.select(((F.col("src") + 1) % 25).cast("int").alias("src"), ((F.col("dst") + 1) % 25).cast("int").alias("dst")))


@query(EDGES, sql="select src, dst, w, 1 as sign from edges where src < dst union all select src, dst, w, -1 from edges where src > dst")
def signed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return layout.signed_links(e.where("src < dst"), e.where("src > dst"))


@query(
    "tr as (select l_orderkey as id, min(l_partkey % 50) as a, min(l_suppkey % 50) as b, min(l_linenumber) as c from lineitem group by all), sn as (select * from tr where id % 100 = 0), pr as (select distinct a as p, b as q from sn union select a, c from sn union select b, c from sn)",
    sql="select id, (a, b) in (select (p, q) from pr) or (a, c) in (select (p, q) from pr) or (b, c) in (select (p, q) from pr) as duplicate from tr where id % 100 <> 0",
)
def shares_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min(F.col("l_partkey") % 50).alias("a"), F.min(F.col("l_suppkey") % 50).alias("b"), F.min(F.col("l_linenumber").cast("long")).alias("c"))
    return layout.shares_pair(li.where("id % 100 <> 0"), li.where("id % 100 = 0")).select("id", "duplicate")


@query(
    "nd as (select distinct (case o_orderkey % 3 when 0 then 277 + o_orderkey % 5 when 1 then 2000 + o_orderkey % 23 else 100 + o_orderkey % 20 end)::int as node from orders), ls as (select src, dst from (values (118, 109)) v(src, dst) union all select l, s from unnest([2002, 2004, 2007, 2010, 2013, 2016, 2019, 2022, 2006, 2009, 2012, 2015, 2018, 2021]) x(l), unnest([277, 278, 279]) y(s)), bt as (select src, dst from ls union all select dst, src from ls)",
    sql="select 1 as src, 2 as dst union select src, dst from bt where src in (from nd) and dst in (from nd)",
)
def extra_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    nodes = table(spark, sf_dir, "orders").select(F.when(k % 3 == 0, 277 + k % 5).when(k % 3 == 1, 2000 + k % 23).otherwise(100 + k % 20).cast("int").alias("node"))
    return layout.with_extra_links(spark.range(1).select(F.lit(1).alias("src"), F.lit(2).alias("dst")), nodes, "rh")


RAWPAIRS = "rp as (select (l_suppkey % 40 - 2)::bigint as src, (l_partkey % 40 - 2)::bigint as dst, case when l_linenumber = 1 then null when l_linenumber = 2 then -1.0::double when l_linenumber = 3 then 'nan'::double else l_quantity end as w from lineitem)"


def raw_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    w = F.when(n == 1, None).when(n == 2, -1.0).when(n == 3, float("nan")).otherwise(F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 40 - 2).alias("src"), (F.col("l_partkey") % 40 - 2).alias("dst"), w.alias("w"))


@query(RAWPAIRS, "so as (select src, dst, case when w is null or isnan(w) or w <= 0 then 1 else w end as w from rp where src between 0 and 29 and dst between 0 and 29 and src <> dst)", sql="select src, dst, count(*) as n, round(sum(w), 2) as w from so group by all")
def sound_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graph.sound_edges(raw_pairs(spark, sf_dir), 30).groupBy("src", "dst").agg(F.count("*").alias("n"), F.sum("w").alias("w")), "w", digits=2)


@query(RAWPAIRS, "so as (select src, dst from rp where src between 0 and 49 and dst between 0 and 49 and src <> dst), en as (select src as node from so union all select dst from so)", sql="select r.range as node, count(en.node) as degree from range(50) r left join en on en.node = r.range group by all")
def graph_of_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.graph_of_pairs(raw_pairs(spark, sf_dir), 50)


@query(EDGES, sql="select src, dst, round(case when w - 200000 > 0 then ln(1 + w - 200000) else 0 end, 6) as w from edges")
def log_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(layout.prepared_edges(edges(spark, sf_dir).withColumn("w", F.col("w") - 200000), log=True), "w")


@query(EDGES, "nm as (select n_nationkey as node, n_name as name from nation where not contains(n_name, 'A_1')), ix as (select node, row_number() over (order by node) - 1 as idx from nm)", sql="select a.idx as src, b.idx as dst, w from edges join ix a on a.node = src join ix b on b.node = dst")
def hemisphere_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_name").alias("name"))
    kept, moved = graph.hemisphere(nodes, edges(spark, sf_dir), "name", "A_1")
    return moved.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "w")


ATLAS = "atlas as (select r_regionkey::bigint as label, string_split(lower(r_name), ' ') as tokens from region)"


@query(VOX, ATLAS, "gone as (select label from atlas where list_has_any(tokens, ['asia', 'region_2', 'region#2']))", sql="select x, y, z, case when label in (from gone) then 0 else label end as label from vox")
def filtered_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    atlas = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("label"), F.split(F.lower("r_name"), " ").alias("tokens"))
    return layout.without_named(voxels(spark, sf_dir).select("x", "y", "z", "label"), atlas, "label", "tokens", ["asia", "region_2", "region#2"])[0]


@query(VOX, ATLAS, sql="select x, y, z, case when label in (select label from atlas) then label else 0 end as label from vox")
def listed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    atlas = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("label"))
    return layout.only_listed(voxels(spark, sf_dir).select("x", "y", "z", "label"), atlas, "label")


@query(VOX, sql="select round(avg(x), 6) as x, round(avg(y), 6) as y, round(avg(z), 6) as z from vox where label % 3 <> 0")
def nonzero_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(layout.centre_of(voxels(spark, sf_dir).withColumn("v", F.col("label") % 3), "v"), "x", "y", "z")


@query(VOX, sql="select x, y, z, (value - 5 > 0)::int as mask from vox")
def water_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.positive_mask(voxels(spark, sf_dir).withColumn("v", F.col("value") - 5), "v").select("x", "y", "z", "mask")


@query(OBS, "rec as (select pert as recording, parcel, metabolite, value from obs where (parcel + pert) % 4 <> 0), lab as (select range as parcel from range(2, 14)), grid as (select distinct recording, metabolite, lab.parcel from rec, lab)", sql="select recording, metabolite, parcel, round(coalesce(value, 0), 6) as value from grid left join rec using (recording, metabolite, parcel)")
def aligned_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = observations(spark, sf_dir).where("(parcel + pert) % 4 <> 0").withColumnRenamed("pert", "recording")
    labels = spark.range(2, 14).withColumnRenamed("id", "parcel")
    return rounded(layout.aligned_profiles(rec, labels, "recording", "parcel", ["metabolite"], "value"), "value").select("recording", "metabolite", "parcel", "value")


@query(VOX, sql="select x, y, count(*) as n, round(arg_min(value, z), 6) as first_, round(arg_max(value, z), 6) as last_ from vox group by all")
def profile_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layout.profile_arrays(voxels(spark, sf_dir), "x", "y", "z", "value", 10)
    ends = found.select("x", "y", F.size("values").cast("long").alias("n"), F.element_at("values", 1).alias("first_"), F.element_at("values", -1).alias("last_"))
    return rounded(ends, "first_", "last_")


@query(
    "a as (select vec_id as node, embedding[1]::double as x, embedding[2]::double as y from embeddings), b as (select vec_id as node, embedding[2]::double + 0.1 * embedding[3]::double as x, embedding[1]::double as y from embeddings)",
    "c as (select node, a.x - avg(a.x) over () as ax, a.y - avg(a.y) over () as ay, b.x - avg(b.x) over () as bx, b.y - avg(b.y) over () as by_ from a join b using (node))",
    "s as (select sum(ax * bx) as xx, sum(ay * by_) as yy, sum(ax * by_) as xy, sum(ay * bx) as yx, sqrt(sum(ax * ax) + sum(ay * ay)) as na from c)",
    "r as (select *, sqrt((xx + yy) ** 2 + (xy - yx) ** 2) as tr, sqrt((xx - yy) ** 2 + (xy + yx) ** 2) as mi from s)",
    "q as (select na, case when tr >= mi then 1.0 else -1.0 end as f, case when tr >= mi then (xx + yy) / tr else (xx - yy) / mi end as co, case when tr >= mi then (xy - yx) / tr else (xy + yx) / mi end as si from r)",
    sql="select node, round(co * ax / na - f * si * ay / na, 6) as x, round(si * ax / na + f * co * ay / na, 6) as y from c, q",
)
def turned_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    at = lambda k: F.col("embedding")[k].cast("double")
    a = e.select(F.col("vec_id").alias("node"), at(0).alias("x"), at(1).alias("y"))
    b = e.select(F.col("vec_id").alias("node"), (at(1) + 0.1 * at(2)).alias("x"), at(0).alias("y"))
    return rounded(layout.turned_to(a, b, "node"), "x", "y")


@query()
def exponential_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the exponent that links the first embedding axis to a known one, and the correlation."""
    cells = table(spark, sf_dir, "embeddings").select(F.col("embedding")[0].cast("double").alias("s"))
    g, r = layout.exponential_fit(cells.withColumn("m", F.exp(0.7 * F.col("s"))), "m", "s")
    return spark.range(1).select(F.lit(round(g, 6)).alias("g"), F.lit(round(r, 6)).alias("r"))
