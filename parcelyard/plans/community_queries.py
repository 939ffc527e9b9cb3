"""Communities, consensus and one-to-one names over the driver's tables. The SQL writes the same rounds out one after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalogue import query
from ..functions.lineage import cut, dealt, written
from ..operators import communities, nulls
from ..operators import graph as graphs
from .parcel_queries import rounded
from .views import TRADE, table, trade

#: Suppliers that occur in one order, weighted by in how many pairs of lines: the whole graph, one more node for each supplier.
COSUPPLY = "cosupply as materialized (select a.l_suppkey as src, b.l_suppkey as dst, count(*)::double as w from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_suppkey <> b.l_suppkey group by all)"
#: A clustering of the nations a year: quarters by that year's trade.
YEARLY = TRADE + ", yearly as materialized (select yr as run, i as node, ntile(4) over (partition by yr order by sum(w), i)::bigint as label from trade group by yr, i)"


def pairs_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, w), src < dst: one half of the pairs, counted over tasks that grow in number with the lines."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    rows = lines.count()
    lines = dealt(lines, rows, "l_orderkey")
    a, b = (lines.select("l_orderkey", F.col("l_suppkey").alias(end)) for end in ("src", "dst"))
    pairs = dealt(a.join(b, "l_orderkey").where("src < dst").select("src", "dst"), 2 * rows, "src", "dst")  # some four lines an order
    return pairs.groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))


def cosupply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both halves: the other is the mirror image."""
    half = cut(pairs_once(spark, sf_dir))
    return half.unionByName(half.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = trade(spark, sf_dir).groupBy(F.col("yr").alias("run"), F.col("i").alias("node")).agg(F.sum("w").alias("s"))
    return sums.select("run", F.col("node").cast("long").alias("node"), F.ntile(4).over(Window.partitionBy("run").orderBy("s", "node")).cast("long").alias("label"))


def louvain_sql(rounds: int, levels: int) -> str:
    """Common tables that end in ``found`` (node, community)."""
    out = [COSUPPLY, "m as materialized (select sum(w) as m2 from cosupply)", "l0 as (from cosupply)", "n0 as (select distinct src as node, src as community from cosupply)"]
    for v in range(levels):
        state = f"s{v}_0"
        out.append(f"{state} as materialized (select src as node, sum(w) as k, src as c from l{v} group by src)")
        for r in range(rounds):
            t = f"{v}_{r}"
            out += [
                f"u{t} as materialized (select c, sum(k) as s from {state} group by c)",
                f"a{t} as materialized (select src as node, c, sum(w) as a from l{v} join {state} on node = dst where src <> dst group by all)",
                f"""b{t} as materialized (select node, c0, c, v - (m2 * coalesce(a0, 0) - k * (s0 - k)) as gain from (
  select x.node, p.c as c0, x.c, k, z.s as s0, m2, m2 * a - k * y.s as v, max(case when x.c = p.c then a end) over (partition by x.node) as a0,
    row_number() over (partition by x.node order by x.c = p.c, m2 * a - k * y.s desc, x.c) as n
  from a{t} x join {state} p on p.node = x.node join u{t} y on y.c = x.c join u{t} z on z.c = p.c, m) where n = 1 and c <> c0 and gain > 1e-12 * m2 * m2)""",
                f"h{t} as (select node, c, row_number() over (partition by t order by gain desc, node) as n from (select *, unnest([c0, c]) as t from b{t}))",
                f"s{v}_{r + 1} as materialized (select node, k, coalesce(q.c, p.c) as c from {state} p left join (select node, c from h{t} where n = 1 group by all having count(*) = 2) q using (node))",
            ]
            state = f"s{v}_{r + 1}"
        out += [
            f"n{v + 1} as (select n.node, s.c as community from n{v} n join {state} s on s.node = n.community)",
            f"l{v + 1} as materialized (select p.c as src, q.c as dst, sum(w) as w from l{v} l join {state} p on p.node = l.src join {state} q on q.node = l.dst group by all)",
        ]
    out.append(f"found as materialized (select node, min(node) over (partition by community) as community from n{levels})")
    return ", ".join(out)


#: Common tables that end in ``found``. A step of ``walk`` is a round of moves; without any, communities become the next level's nodes (``part``) if
#: the level moved something (``made``), else the walk ends.
LOUVAIN_WHOLE = (
    COSUPPLY
    + """, m as materialized (select sum(w) as m2 from cosupply),
  walk as (select 0 as step, src as node, src as part, src as c, sum(w) as k, false as made from cosupply group by src
    union all (
      with p as (select part as node, c, sum(k) as k from walk group by all), u as (select c, sum(k) as s from p group by c),
      near as (select x.part as node, y.c, sum(w) as a from cosupply join walk x on x.node = src join walk y on y.node = dst where x.part <> y.part group by all),
      b as (select node, c0, c, v - (m2 * coalesce(a0, 0) - k * (s0 - k)) as gain from (
        select x.node, p.c as c0, x.c, k, z.s as s0, m2, m2 * a - k * y.s as v, max(case when x.c = p.c then a end) over (partition by x.node) as a0,
          row_number() over (partition by x.node order by x.c = p.c, m2 * a - k * y.s desc, x.c) as n
        from near x join p on p.node = x.node join u y on y.c = x.c join u z on z.c = p.c, m) where n = 1 and c <> c0 and gain > 1e-12 * m2 * m2),
      h as (select node, c, row_number() over (partition by t order by gain desc, node) as n from (select *, unnest([c0, c]) as t from b)),
      q as (select node, c from h where n = 1 group by all having count(*) = 2)
      select step + 1, x.node, case when moved then x.part else x.c end, coalesce(q.c, x.c), x.k, moved
      from walk x left join q on q.node = x.part, (select count(*) > 0 as moved from q) where moved or made)),
  found as materialized (select node, min(node) over (partition by c) as community from walk where step = (select max(step) from walk))"""
)


def linkage_sql(nodes: int) -> str:
    """Common tables that end in ``merges`` (a, b, height); a round merges one pair at least, so ``nodes`` - 1 rounds are enough."""
    out = ["p as materialized (select x.node as i, y.node as j, sum((x.label <> y.label)::int)::double / count(*) as d from yearly x join yearly y on x.run = y.run and x.node <> y.node group by all)"]
    out.append("t0 as materialized (select i as a, j as b, coalesce(d, 1.0) as s, 1 as n from (select x.node as i, y.node as j from (select distinct node from yearly) x join (select distinct node from yearly) y on x.node < y.node) left join p using (i, j))")
    for r in range(nodes - 1):
        out += [
            f"g{r} as materialized (select a, b, height from (select a, b, s / n as height, row_number() over (partition by c order by s / n, a, b) as k from (select *, unnest([a, b]) as c from t{r})) where k = 1 group by all having count(*) = 2)",
            f"t{r + 1} as materialized (select least(a, b) as a, greatest(a, b) as b, sum(s) as s, sum(n) as n from (select coalesce(x.a, t.a) as a, coalesce(y.a, t.b) as b, s, n from t{r} t left join g{r} x on x.b = t.a left join g{r} y on y.b = t.b) where a <> b group by 1, 2)",
        ]
    return ", ".join(out) + ", merges as materialized (" + " union all ".join(f"from g{r}" for r in range(nodes - 1)) + ")"


LOUVAIN = louvain_sql(rounds=4, levels=2)


@query(LOUVAIN, sql="from found")
def louvain_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four rounds a level and two levels over the whole graph of suppliers, written out alike in SQL."""
    return communities.louvain_of_half(written(pairs_once(spark, sf_dir)), rounds=4, levels=2).select("node", "community")


@query()
def louvain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Until nothing moves."""
    return communities.louvain_of_half(written(pairs_once(spark, sf_dir))).select("node", "community")


@query(
    "recursive " + LOUVAIN_WHOLE,
    "e as (select p.community as a, sum(case when p.community = q.community then w else 0 end) as inside, sum(w) as k from cosupply join found p on p.node = src join found q on q.node = dst group by all)",
    sql="select round(sum(inside / m2 - k / m2 * (k / m2)), 9) as modularity from e, m",
)
def modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the communities that are left when nothing moves."""
    return rounded(communities.quality(communities.louvain_of_half(written(pairs_once(spark, sf_dir)))), "modularity", digits=9)


@query(YEARLY, sql="select x.node as i, y.node as j, sum((x.label <> y.label)::int)::bigint as apart, count(*) as both from yearly x join yearly y on x.run = y.run and x.node <> y.node group by all")
def runs_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return communities.together(yearly(spark, sf_dir))


@query("recursive " + YEARLY, linkage_sql(25), sql="""select node, min(root) as cluster from (
  with recursive cutoff as (select max(height) as h from (select height from merges order by height limit (select greatest(count(distinct node) - 4, 0) from yearly))),
  up as (select distinct node, node as root from yearly union select up.node, m.a from up join merges m on m.b = up.root, cutoff where m.height <= h)
  select node, root from up) group by node""")  # fmt: skip
def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations that the years put together, at most four clusters."""
    return communities.consensus(yearly(spark, sf_dir), 4)


FIRST = "base as materialized (select node, label from yearly where run = (select min(run) from yearly))"


@query(
    "recursive " + YEARLY,
    FIRST,
    "o as materialized (select y.run, y.label, b.label as base, count(*) as n from yearly y join base b using (node) group by all)",
    "names as (select distinct label from base)",
    """tried as (select run, 0::bigint as label, []::bigint[] as used, 0::bigint as total from (select distinct run from yearly)
  union all select t.run, t.label + 1, list_append(used, k.label), total + coalesce(o.n, 0) from tried t join names k on not list_contains(used, k.label) left join o on o.run = t.run and o.label = t.label + 1 and o.base = k.label where t.label < 4)""",
    sql="select run, max(total) as overlap, 4::bigint as names from tried where label = 4 group by run",
)
def one_to_one_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that keep the first year's label under the best one-to-one names; the SQL tries all of them."""
    labels = yearly(spark, sf_dir)
    base = labels.where(F.col("run") == labels.agg(F.min("run")).first()[0]).select("node", "label")
    return communities.one_to_one(labels, base).groupBy("run").agg(F.sum("overlap").alias("overlap"), F.countDistinct("name").alias("names"))


# Graph operators over the whole graph of suppliers, beside those over a graph's strongest links.

WHOLE = COSUPPLY + ", deg as materialized (select src as node, count(*) as degree from cosupply group by src)"
#: Links of more than 1.05 times the mean weight: sparse enough for components and orders to say something, and no fixed number of them.
HEAVY = COSUPPLY + ", heavy as materialized (select src, dst, w from cosupply, (select avg(w) as mean from cosupply) where w > 1.05 * mean)"


def heavy(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = cosupply(spark, sf_dir)
    return links.crossJoin(F.broadcast(links.agg(F.avg("w").alias("mean")))).where("w > 1.05 * mean").drop("mean")  # one row is broadcast


@query(WHOLE, sql="from deg")
def degree_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.degree(cosupply(spark, sf_dir))


@query(
    WHOLE,
    "ks as (select distinct degree - 1 as k from deg)",
    "n as (select k, (select count(*) from deg where degree > k) as nodes from ks)",
    "e as (select k, count(*) as links from ks, cosupply join deg a on a.node = src join deg b on b.node = dst where src < dst and least(a.degree, b.degree) > k group by k)",
    sql="select k, nodes::bigint as nodes, coalesce(links, 0)::bigint as links, round(2 * coalesce(links, 0) / (nodes * (nodes - 1))::double, 6) as phi from n left join e using (k) where nodes >= 2",
)
def rich_club_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graphs.rich_club(cosupply(spark, sf_dir)), "phi")


@query("recursive " + HEAVY, "reach as (select src as node, src as other from heavy union select r.node, dst from reach r join heavy on src = r.other)", sql="select node, min(other) as component from reach group by node")
def components_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.components(heavy(spark, sf_dir))


@query("recursive " + HEAVY, "hop as (select distinct src, dst, 1 as hops from heavy union select h.src, e.dst, hops + 1 from hop h join heavy e on e.src = h.dst where hops < 3)", sql="select src, dst, min(hops) as hops from hop where src <> dst group by all")
def k_hop_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.k_hop(heavy(spark, sf_dir), 3)


@query()
def bandwidth_order_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nulls.bandwidth_order(heavy(spark, sf_dir))
