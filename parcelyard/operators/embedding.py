"""Embeddings, clusterings and ordered series."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut


def barycentric(points: DataFrame, corners: list[tuple[float, float]], x: str = "x", y: str = "y") -> DataFrame:
    """Weights w0, w1, w2 of a point in a triangle, clipped to [0, 1] and made to sum to 1; 0 where they can't be."""
    (ax, ay), (bx, by), (cx, cy) = corners
    area = (by - cy) * (ax - cx) + (cx - bx) * (ay - cy)
    if area == 0:
        return points.withColumns({f"w{k}": F.lit(0.0) for k in range(3)})
    px, py = F.col(x), F.col(y)
    w0 = ((by - cy) * (px - cx) + (cx - bx) * (py - cy)) / area
    w1 = ((cy - ay) * (px - cx) + (ax - cx) * (py - cy)) / area
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    raw = points.withColumns({"_a": clip(w0), "_b": clip(w1), "_c": clip(1 - w0 - w1)})
    total = F.nullif(F.col("_a") + F.col("_b") + F.col("_c"), F.lit(0.0))
    return raw.withColumns({f"w{k}": F.coalesce(F.col(c) / total, F.lit(0.0)) for k, c in enumerate(("_a", "_b", "_c"))}).drop("_a", "_b", "_c")


def _hull(points: DataFrame, node: str, x: str, y: str) -> DataFrame:
    """The corners (n, x, y) of the convex hull: of every partition's rows first, then of what these leave, by monotone chains. Of equal points the least node stays."""

    def corners(n: np.ndarray, px: np.ndarray, py: np.ndarray) -> np.ndarray:
        order = np.lexsort((n, py, px))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(px[order]) != 0) | (np.diff(py[order]) != 0)
        order = order[new].tolist()
        kept: set = set(order[:1])
        for way in (order, order[::-1]):
            chain: list[int] = []
            for k in way:
                while len(chain) > 1 and (px[chain[-1]] - px[chain[-2]]) * (py[k] - py[chain[-2]]) - (py[chain[-1]] - py[chain[-2]]) * (px[k] - px[chain[-2]]) <= 0:
                    chain.pop()
                chain.append(k)
            kept.update(chain)
        return np.array(sorted(kept), np.int64)

    def run(batches):
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            held = held.take(pa.array(corners(*(c.to_numpy() for c in held.columns))))
        if held is not None:
            yield from held.combine_chunks().to_batches()

    rows = points.select(F.col(node).cast("long").alias("n"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("n is not null and x is not null and y is not null and not isnan(x) and not isnan(y)")
    schema = "n bigint, x double, y double"
    return rows.mapInArrow(run, schema).repartition(1).mapInArrow(run, schema)


def largest_triangle(points: DataFrame, node: str, x: str = "x", y: str = "y") -> DataFrame:
    """(a, b, c, area) of the largest triangle over all points. Its corners are corners of the convex hull, so only those are joined with one another."""
    e = cut(_hull(points, node, x, y))
    a, b, c = (e.select(*(F.col(col).alias(f"{col}{k}") for col in ("n", "x", "y"))) for k in "abc")
    area = F.round(F.abs((F.col("xb") - F.col("xa")) * (F.col("yc") - F.col("ya")) - (F.col("xc") - F.col("xa")) * (F.col("yb") - F.col("ya"))) / 2, 9)
    every = a.join(b, F.col("na") < F.col("nb")).join(c, F.col("nb") < F.col("nc")).select(F.col("na").alias("a"), F.col("nb").alias("b"), F.col("nc").alias("c"), area.alias("area"))
    return every.orderBy(F.desc("area"), "a", "b", "c").limit(1)


def coassociation(labels: DataFrame, run: str, node: str, label: str) -> DataFrame:
    """(i, j, share): share of the runs in which two nodes have one label. Nodes are parcels: some hundreds."""
    runs = labels.agg(F.countDistinct(run).alias("_runs"))
    a = labels.select(run, label, F.col(node).alias("i"))
    b = labels.select(run, label, F.col(node).alias("j"))
    both = a.join(b, [run, label]).where("i < j").groupBy("i", "j").agg(F.count("*").alias("_c"))
    return both.crossJoin(F.broadcast(runs)).select("i", "j", (F.col("_c") / F.col("_runs")).alias("share"))


def majority_label(labels: DataFrame, run: str, node: str, label: str) -> DataFrame:
    """Each node's most frequent label; of equals, the one seen in the earliest run."""
    counts = labels.groupBy(node, label).agg(F.count("*").alias("_c"), F.min(run).alias("_first"))
    best = F.row_number().over(Window.partitionBy(node).orderBy(F.desc("_c"), "_first", label))
    return counts.withColumn("_n", best).where("_n = 1").select(node, label)


def relabelled(labels: DataFrame, base: DataFrame, node: str, label: str) -> DataFrame:
    """Each label renamed to the base label with which it shares most nodes (ties to the least)."""
    overlap = labels.join(base.select(node, F.col(label).alias("_base")), node).groupBy(label, "_base").count()
    best = F.row_number().over(Window.partitionBy(label).orderBy(F.desc("count"), "_base"))
    names = overlap.withColumn("_n", best).where("_n = 1").select(label, "_base")
    return labels.join(names, label, "left").withColumn(label, F.coalesce("_base", label)).drop("_base")


def moving_average(series: DataFrame, by: list[str], pos: str, value: str, width: int) -> DataFrame:
    """Mean of ``width`` values around each, the first and last repeated beyond the ends."""
    w = Window.partitionBy(*by).orderBy(pos)
    every = Window.partitionBy(*by)
    before, after = width // 2, width - 1 - width // 2
    rows = w.rowsBetween(-before, after)
    n, k = F.count("*").over(every), F.row_number().over(w)
    lead = F.greatest(F.lit(0), before - k + 1) * F.first(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    tail = F.greatest(F.lit(0), k + after - n) * F.last(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return series.withColumn("smooth", (F.sum(value).over(rows) + lead + tail) / F.lit(float(width)))


def interpolated(series: DataFrame, by: list[str], pos: str, value: str, points: int) -> DataFrame:
    """(by, k, v): ``points`` values at equal steps from the first position to the last, on straight lines between neighbours."""
    w = Window.partitionBy(*by).orderBy(pos)
    every = Window.partitionBy(*by)
    at = (F.row_number().over(w) - 1).cast("double") / F.greatest(F.count("*").over(every) - 1, F.lit(1)) * (points - 1)
    spans = series.select(*by, pos, F.col(value).alias("_v"), at.alias("_at")).withColumn("_next", F.lead("_v").over(w)).withColumn("_end", F.lead("_at").over(w))
    last = F.col("_end").isNull()
    ks = F.sequence(F.ceil("_at").cast("int"), F.when(last, F.lit(points - 1)).otherwise(F.greatest(F.ceil("_at"), F.ceil("_end") - 1)).cast("int"))
    held = spans.withColumn("k", F.explode(ks)).where((F.col("k") >= F.col("_at")) & (last | (F.col("k") < F.col("_end"))))
    inside = F.col("_v") + (F.col("_next") - F.col("_v")) * (F.col("k") - F.col("_at")) / (F.col("_end") - F.col("_at"))
    return held.select(*by, "k", F.when(last, F.col("_v")).otherwise(inside).alias("v"))


def islands(points: DataFrame, by: list[str], pos: str, value: str) -> DataFrame:
    """(by, island, first, last, n): runs of values between NaNs or nulls that hold two at least."""
    gap = (F.isnan(value) | F.col(value).isNull()).cast("int")
    w = Window.partitionBy(*by).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    marked = points.withColumn("_gap", gap).withColumn("island", F.sum(gap).over(w)).where("_gap = 0")
    return marked.groupBy(*by, "island").agg(F.min(pos).alias("first"), F.max(pos).alias("last"), F.count("*").alias("n")).where("n >= 2")


def circle_layout(nodes: DataFrame, order: str, span: float = 2 * math.pi) -> DataFrame:
    """angle, cx, cy of each node on a circle, in ``order``. Nodes are parcels: some hundreds."""
    one = Window.partitionBy(F.lit(0))
    angle = span * (F.row_number().over(one.orderBy(order)) - 1) / F.count("*").over(one)
    return nodes.withColumn("angle", angle).withColumn("cx", F.cos("angle")).withColumn("cy", F.sin("angle"))


def spiral(nodes: DataFrame, order: str, turns: float, inner: float, outer: float) -> DataFrame:
    one = Window.partitionBy(F.lit(0))
    share = (F.row_number().over(one.orderBy(order)) - 1) / F.greatest(F.count("*").over(one) - 1, F.lit(1))
    theta, radius = 2 * math.pi * turns * share, inner + (outer - inner) * share
    return nodes.withColumn("sx", radius * F.cos(theta)).withColumn("sy", radius * F.sin(theta))


def diffusion_component(edges: DataFrame, steps: int = 12) -> DataFrame:
    """(node, v): the second eigenvector of D^-1/2 A D^-1/2 by power iteration with the first one taken out; edges in both directions."""
    d = cut(edges.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("d")))
    sq = d.select("node", F.sqrt("d").alias("s"))
    links = cut(edges.join(d.select(F.col("node").alias("src"), F.col("d").alias("ds")), "src").join(d.select(F.col("node").alias("dst"), F.col("d").alias("dd")), "dst").select("src", "dst", (F.col("w") / F.sqrt(F.col("ds") * F.col("dd"))).alias("a")))
    v = sq.withColumn("v", F.sin(F.col("node") + 1.0))
    for _ in range(steps):
        first = v.agg(F.sum(F.col("v") * F.col("s")).alias("_p"), F.sum(F.col("s") * F.col("s")).alias("_q"))
        free = v.crossJoin(F.broadcast(first)).select("node", "s", (F.col("v") - F.col("_p") / F.col("_q") * F.col("s")).alias("v"))
        # Half the step is the vector itself, so that no eigenvalue is negative.
        walked = links.join(free.select(F.col("node").alias("dst"), "v"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum(F.col("a") * F.col("v")).alias("_av"))
        new = free.join(walked, "node").select("node", "s", ((F.col("v") + F.col("_av")) / 2).alias("v"))
        v = cut(new.crossJoin(F.broadcast(new.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("_norm")))).select("node", "s", (F.col("v") / F.col("_norm")).alias("v")))
    return v.select("node", "v")


def bandwidths(neighbours: DataFrame, steps: int = 64) -> DataFrame:
    """(i, rho, sigma): rho is a node's least distance, sigma the bandwidth at which exp(-max(d - rho, 0) / sigma) sum to log2 of the number of neighbours.

    ``neighbours``: (i, j, d), a row a neighbour, a few a node. ``steps`` halvings are far beyond the precision of a double's sum. Where more
    than log2(k) neighbours are as near as the nearest there is no such bandwidth, and sigma goes to 0 from above.
    """
    rows = neighbours.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "d"))).alias("_n"), F.min("d").alias("rho"))
    ds, want = F.transform("_n", lambda x: x["d"]), F.log2(F.size("_n").cast("double"))
    bounds = lambda lo, hi, mid: F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"), mid.cast("double").alias("mid"))

    def step(s: Column, _: Column) -> Column:
        lo, hi, mid = s["lo"], s["hi"], s["mid"]
        over = F.aggregate(ds, F.lit(0.0), lambda t, d: t + F.exp(-F.greatest(d - F.col("rho"), F.lit(0.0)) / mid)) > want
        return bounds(F.when(over, lo).otherwise(mid), F.when(over, mid).otherwise(hi), F.when(over, (lo + mid) / 2).when(hi < 0, mid * 2).otherwise((mid + hi) / 2))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), bounds(F.lit(0.0), F.lit(-1.0), F.lit(1.0)), step)  # an upper end not yet met is -1
    return rows.select("i", "rho", found["mid"].alias("sigma"))


def memberships(neighbours: DataFrame) -> DataFrame:
    """(i, j, w), both ways: the fuzzy union a + b - ab of the memberships exp(-max(d - rho, 0) / sigma) of both directions."""
    sized = neighbours.join(bandwidths(neighbours), "i").select("i", "j", F.exp(-F.greatest(F.col("d") - F.col("rho"), F.lit(0.0)) / F.col("sigma")).alias("m"))
    none = F.lit(0.0)
    both = sized.select("i", "j", F.col("m").alias("a"), none.alias("b")).unionByName(sized.select(F.col("j").alias("i"), F.col("i").alias("j"), none.alias("a"), F.col("m").alias("b")))
    return both.groupBy("i", "j").agg(F.max("a").alias("a"), F.max("b").alias("b")).select("i", "j", (F.col("a") + F.col("b") - F.col("a") * F.col("b")).alias("w"))


def principal_components(vectors: DataFrame, node: str, vector: str, k: int):
    """(model, (node, pc)): principal components by Spark's own PCA."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select(node, array_to_vector(F.col(vector)).alias("_v"))
    model = PCA(k=k, inputCol="_v", outputCol="_pc").fit(rows)
    return model, model.transform(rows).select(node, vector_to_array("_pc").alias("pc"))


def k_means(vectors: DataFrame, node: str, vector: str, k: int, seed: int = 1) -> DataFrame:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select(node, array_to_vector(F.col(vector)).alias("features"))
    return KMeans(k=k, seed=seed, maxIter=10).fit(rows).transform(rows).select(node, F.col("prediction").alias("label"))


def mixture_scores(vectors: DataFrame, vector: str, ks: list[int], seed: int = 1) -> DataFrame:
    """(k, bic, aic) of Gaussian mixtures."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select(array_to_vector(F.col(vector)).alias("features")).cache()
    n, dims = rows.count(), len(rows.first()[0])
    out = []
    for k in ks:
        likelihood = GaussianMixture(k=k, seed=seed, maxIter=10).fit(rows).summary.logLikelihood
        free = k * (dims + dims * (dims + 1) / 2) + k - 1
        out.append((k, float(-2 * likelihood + free * math.log(n)), float(-2 * likelihood + 2 * free)))
    rows.unpersist()
    return vectors.sparkSession.createDataFrame(out, "k int, bic double, aic double")


def min_max(c: str | Column, by: list[str]) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    w = Window.partitionBy(*by)
    return (c - F.min(c).over(w)) / F.nullif(F.max(c).over(w) - F.min(c).over(w), F.lit(0.0))


def aligned(points: DataFrame, subject: str, node: str, g: str, dims: int, reference: DataFrame | None = None, rounds: int = 10, tolerance: float = 1e-5) -> tuple[DataFrame, DataFrame]:
    """((subject, node, g), (node, g)): every subject's points turned or mirrored about the origin to lie nearest to a reference, and that reference.

    ``g`` is an array of ``dims`` coordinates. The first reference is the one given, else the least subject's points; after each round it is
    the mean of the turned points, until it moves by less than ``tolerance`` (sum of squares). A subject's turn comes from its ``dims`` by
    ``dims`` products with the reference over the nodes they share; points are neither centred nor scaled. Points with a null, and subjects
    that share no node with the reference, are left out.
    """
    k = range(dims)
    sound = points.select(subject, node, *(F.get(F.col(g), F.lit(a)).cast("double").alias(f"_s{a}") for a in k)).dropna()
    sound = cut(sound)
    if reference is None:
        least = sound.agg(F.min(subject).alias("_first"))
        ref = sound.join(F.broadcast(least), F.col(subject) == F.col("_first")).select(node, *(F.col(f"_s{a}").alias(f"_t{a}") for a in k))  # one row is broadcast
    else:
        ref = reference.select(node, *(F.get(F.col(g), F.lit(a)).cast("double").alias(f"_t{a}") for a in k)).dropna()

    @F.pandas_udf("array<double>")
    def turn(products: pd.Series) -> pd.Series:
        if not len(products):
            return pd.Series([], dtype=object)
        u, _, v = np.linalg.svd(np.array(products.tolist(), float).reshape(-1, dims, dims))
        return pd.Series(list((u @ v).reshape(-1, dims * dims)))

    for _ in range(max(rounds, 1)):
        products = sound.join(ref, node).groupBy(subject).agg(F.array(*(F.sum(F.col(f"_s{a}") * F.col(f"_t{b}")) for a in k for b in k)).alias("_m"))
        turns = products.select(subject, turn("_m").alias("_r"))
        turned = sound.join(turns, subject).select(subject, node, *(sum((F.col(f"_s{a}") * F.get("_r", F.lit(a * dims + b)) for a in k), F.lit(0.0)).alias(f"_t{b}") for b in k))
        turned = cut(turned)
        new = cut(turned.groupBy(node).agg(*(F.avg(f"_t{b}").alias(f"_t{b}") for b in k)))
        old = ref.select(node, *(F.col(f"_t{b}").alias(f"_o{b}") for b in k))
        square = lambda b: F.pow(F.coalesce(f"_t{b}", F.lit(0.0)) - F.coalesce(f"_o{b}", F.lit(0.0)), F.lit(2.0))
        moved = new.join(old, node, "full").agg(F.sum(sum((square(b) for b in k), F.lit(0.0)))).first()[0]
        ref = new
        if moved is None or moved < tolerance:
            break
    whole = F.array(*(F.col(f"_t{b}") for b in k)).alias(g)
    return turned.select(subject, node, whole), ref.select(node, whole)
