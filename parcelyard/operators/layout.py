"""Positions and colours of nodes and links, unions and repairs of graphs, labels of atlases."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Links that atlases of one scheme lack, by hemisphere: one pair of labels, and brain-stem labels with cerebellar ones.
STEM = [277, 278, 279]
VERMIS = [2006, 2009, 2012, 2015, 2018, 2021]
EXTRA_LINKS = {
    "rh": {"pair": (118, 109), "lobules": [2002, 2004, 2007, 2010, 2013, 2016, 2019, 2022, *VERMIS]},
    "lh": {"pair": (251, 248), "lobules": [2001, 2003, 2005, 2008, 2011, 2014, 2017, 2020, *VERMIS]},
}
GREY = 0.65
CHANNEL_SCALARS = {"R": 0.0, "B": 0.5, "G": 1.0}


def polylines(edges: DataFrame, places: DataFrame) -> DataFrame:
    """(src, dst, line): each link as the two points of its ends. ``places(node, x, y, z)``; links with an end nowhere are left out."""
    at = lambda c: places.select(F.col("node").alias(c), F.struct("x", "y", "z").alias(f"_{c}"))
    return edges.select("src", "dst").join(at("src"), "src").join(at("dst"), "dst").select("src", "dst", F.array("_src", "_dst").alias("line"))


def control_points(edges: DataFrame, places: DataFrame, curvature: float = 0.18, direction: float = 1.0) -> DataFrame:
    """(src, dst, cx, cy): control point of a quadratic curve, beside the middle of the link by ``curvature`` of its length; links of no length are left out."""
    at = lambda c: places.select(F.col("node").alias(c), F.col("x").alias(f"x_{c}"), F.col("y").alias(f"y_{c}"))
    side = curvature if direction >= 0 else -curvature
    dx, dy = F.col("x_dst") - F.col("x_src"), F.col("y_dst") - F.col("y_src")
    both = edges.select("src", "dst").join(at("src"), "src").join(at("dst"), "dst").where(F.sqrt(dx * dx + dy * dy) > 1e-12)
    return both.select("src", "dst", ((F.col("x_src") + F.col("x_dst")) / 2 - side * dy).alias("cx"), ((F.col("y_src") + F.col("y_dst")) / 2 + side * dx).alias("cy"))


def connection_counts(edges: DataFrame, order: list[str]) -> DataFrame:
    """(src, dst, n_src, n_dst, seen_src, seen_dst): links of each end in all, and so far in the stated order, this one included."""
    ends = edges.select("src", "dst", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("src").alias("node")), F.struct(F.lit(1).alias("side"), F.col("dst").alias("node")))).alias("e"), *[c for c in order if c not in ("src", "dst")])
    here = Window.partitionBy("node")
    flat = ends.select("src", "dst", "e.side", "e.node", *[c for c in order if c not in ("src", "dst")])
    counted = flat.withColumns({"n": F.count("*").over(here), "seen": F.count("*").over(here.orderBy(*order, "side").rowsBetween(Window.unboundedPreceding, 0))})
    pick = lambda c, side: F.max(F.when(F.col("side") == side, F.col(c)))
    return counted.groupBy("src", "dst").agg(pick("n", 0).alias("n_src"), pick("n", 1).alias("n_dst"), pick("seen", 0).alias("seen_src"), pick("seen", 1).alias("seen_dst"))


def picked_links(edges: DataFrame, angles: DataFrame, at: float) -> DataFrame:
    """Links of the node whose angle (modulo a turn) is nearest to ``at``; ties to the least node. ``angles(node, angle)``."""
    turn = F.pmod(F.col("angle"), F.lit(2 * math.pi))
    picked = angles.agg(F.min_by("node", F.struct(F.round(F.abs(turn - at), 12), F.col("node"))).alias("_node"))
    return edges.crossJoin(F.broadcast(picked)).where((F.col("src") == F.col("_node")) | (F.col("dst") == F.col("_node"))).drop("_node")


def label_ranges(labels: DataFrame, prefixes: DataFrame, position: str, name: str, prefix: str) -> DataFrame:
    """(prefix, lo, hi): from half a place before the first label that holds the prefix (0 at least) to half a place behind the last. A label may hold several."""
    held = labels.join(F.broadcast(prefixes), F.contains(F.col(name), F.col(prefix)))  # prefixes: some dozens
    return held.groupBy(prefix).agg(F.greatest(F.lit(0.0), F.min(position) - 0.5).alias("lo"), (F.max(position) + 0.5).alias("hi"))


def scaled_widths(edges: DataFrame, value: str, lo: float, hi: float, out: str = "width") -> DataFrame:
    """Absolute weights on a scale from ``lo`` to ``hi``; its middle if all are equal."""
    size = F.abs(value)
    ends = edges.agg(F.min(size).alias("_lo"), F.max(size).alias("_hi"))
    scaled = F.when(F.col("_hi") == F.col("_lo"), (lo + hi) / 2).otherwise(lo + (size - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * (hi - lo))
    return edges.crossJoin(F.broadcast(ends)).withColumn(out, scaled).drop("_lo", "_hi")


def least_gap(angles: DataFrame) -> DataFrame:
    """One row: the least difference of two nodes' angles. Neighbours in order hold it."""
    w = Window.orderBy("angle")  # nodes of one graph of parcels
    return angles.select((F.col("angle") - F.lag("angle").over(w)).alias("_g")).agg(F.min("_g").alias("gap"))


def branch_spiral(branch: DataFrame, places: DataFrame, scale: float = 0.48) -> DataFrame:
    """(node, x, y) of a branch that leaves a laid-out path: from its first node on that path (its own first, at the origin, if none is) a spiral outwards. ``branch(pos, node)``, ``places(node, x, y)``."""
    held = branch.join(places, "node", "left")
    meets = held.agg(F.coalesce(F.min(F.when(F.col("x").isNotNull(), F.col("pos"))), F.min("pos")).alias("_from"), F.count("*").alias("_all"))
    from_there = held.crossJoin(F.broadcast(meets)).where("pos >= _from")
    order = Window.orderBy("pos")  # one path
    placed = from_there.withColumns({"_k": F.row_number().over(order) - 1, "_n": F.count("*").over(Window.partitionBy(F.lit(0))), "_ax": F.coalesce(F.first("x").over(order), F.lit(0.0)), "_ay": F.coalesce(F.first("y").over(order), F.lit(0.0))})
    turns = F.greatest(F.lit(0.5), F.least(F.lit(2.0), F.col("_all") / 8.0))
    share = F.col("_k") / F.greatest(F.col("_n") - 1, F.lit(1))
    theta = F.atan2("_ay", "_ax") + 2 * math.pi * turns * share
    return placed.select("node", (F.col("_ax") + scale * share * F.cos(theta)).alias("x"), (F.col("_ay") + scale * share * F.sin(theta)).alias("y"))


def triangle_colours(weights: DataFrame, order: str = "RBG") -> DataFrame:
    """``weights(w0, w1, w2)`` with r, g, b (largest channel 1; grey where there is no point) and scalar (null where all weights are 0). Corner k has the k-th colour of ``order``."""
    order = order if sorted(order) == ["B", "G", "R"] else "RBG"
    corner = {c: F.col(f"w{k}") for k, c in enumerate(order)}
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    top = F.greatest(*(clip(c) for c in corner.values()))
    top = F.when(top <= 1e-9, 1.0).otherwise(top)
    known = F.col("w0").isNotNull()
    colours = {n: F.when(known, clip(clip(corner[c]) / top)).otherwise(GREY) for n, c in (("r", "R"), ("g", "G"), ("b", "B"))}
    total = F.col("w0") + F.col("w1") + F.col("w2")
    scalar = F.when(total > 0, sum((corner[c] * v for c, v in CHANNEL_SCALARS.items()), F.lit(0.0)))
    return weights.withColumns(colours | {"scalar": scalar})


def united(*graphs: DataFrame) -> DataFrame:
    """(src, dst): links that any of the graphs has, once."""
    out = graphs[0].select("src", "dst")
    for g in graphs[1:]:
        out = out.unionByName(g.select("src", "dst"))
    return out.distinct()


def signed_links(positive: DataFrame, negative: DataFrame) -> DataFrame:
    """Both tables one after another, with the sign of their links."""
    return positive.withColumn("sign", F.lit(1)).unionByName(negative.withColumn("sign", F.lit(-1)))


def shares_pair(triplets: DataFrame, seen: DataFrame) -> DataFrame:
    """``triplets(id, a, b, c)`` with duplicate: whether a pair (a, b), (a, c) or (b, c) stands in a triplet of ``seen``."""
    pairs = lambda df, *keep: df.select(*keep, F.explode(F.array(*(F.struct(F.col(p).alias("p"), F.col(q).alias("q")) for p, q in (("a", "b"), ("a", "c"), ("b", "c"))))).alias("x"))
    hit = pairs(triplets, "id").join(pairs(seen).distinct(), "x", "left_semi").select("id").distinct().withColumn("duplicate", F.lit(True))
    return triplets.join(hit, "id", "left").withColumn("duplicate", F.coalesce("duplicate", F.lit(False)))


def with_extra_links(edges: DataFrame, labels: DataFrame, hemisphere: str) -> DataFrame:
    """(src, dst) with the links that the atlas of a hemisphere lacks, between labels that are there, both ways."""
    extra = EXTRA_LINKS[hemisphere]
    listed = [extra["pair"], *((lobule, stem) for lobule in extra["lobules"] for stem in STEM)]
    table = F.explode(F.array(*(F.struct(F.lit(a).alias("src"), F.lit(b).alias("dst")) for pair in listed for a, b in (pair, pair[::-1])))).alias("e")
    present = labels.select("node").distinct()
    added = edges.sparkSession.range(1).select(table).select("e.src", "e.dst").join(present.withColumnRenamed("node", "src"), "src", "left_semi").join(present.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return united(edges, added)


def graph_of_pairs(edges: DataFrame, nodes: int) -> DataFrame:
    """(node, degree) of the sound links between nodes 0 to ``nodes`` - 1; nodes without a link have degree 0."""
    from .graph import sound_edges

    ends = sound_edges(edges, nodes).select(F.explode(F.array("src", "dst")).alias("node"))
    degree = ends.groupBy("node").agg(F.count("*").alias("degree"))
    return edges.sparkSession.range(nodes).withColumnRenamed("id", "node").join(degree, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))


def prepared_edges(edges: DataFrame, binarise: bool = False, log: bool = False, value: str = "w") -> DataFrame:
    """Edge weights as read, as 1 where positive, or on a logarithmic scale (log of 1 + w, kept at 0 for what isn't positive)."""
    w = F.col(value)
    if binarise:
        w = F.when(w > 0, 1.0).otherwise(0.0)
    if log:
        w = F.when(w > 0, F.log1p(w)).otherwise(0.0)
    return edges.withColumn(value, w)


def without_named(voxels: DataFrame, atlas: DataFrame, label: str, tokens: str, ignored: list[str]) -> tuple[DataFrame, DataFrame]:
    """Voxels with 0 for the labels one of whose name tokens is ignored, and the atlas without them. ``atlas(label, tokens)``."""
    gone = F.arrays_overlap(F.col(tokens), F.array(*map(F.lit, ignored)))
    dropped = atlas.where(gone).select(label).withColumn("_gone", F.lit(True))
    return voxels.join(dropped, label, "left").withColumn(label, F.when(F.col("_gone"), 0).otherwise(F.col(label))).drop("_gone"), atlas.where(~F.coalesce(gone, F.lit(False)))


def only_listed(voxels: DataFrame, atlas: DataFrame, label: str) -> DataFrame:
    """Voxels with 0 for the labels that the atlas doesn't list."""
    listed = atlas.select(label).distinct().withColumn("_listed", F.lit(True))
    return voxels.join(listed, label, "left").withColumn(label, F.when(F.col("_listed"), F.col(label)).otherwise(0)).drop("_listed")


def centre_of(voxels: DataFrame, value: str) -> DataFrame:
    """One row x, y, z: mean place of the voxels whose value isn't 0."""
    return voxels.where(F.col(value) != 0).agg(*(F.avg(a).alias(a) for a in "xyz"))


def positive_mask(voxels: DataFrame, value: str, out: str = "mask") -> DataFrame:
    """1 where the value is positive, else 0 (null and NaN too)."""
    return voxels.withColumn(out, (F.coalesce(F.col(value) > 0, F.lit(False)) & ~F.coalesce(F.isnan(value), F.lit(False))).cast("int"))


def aligned_profiles(profiles: DataFrame, labels: DataFrame, recording: str, node: str, keys: list[str], value: str) -> DataFrame:
    """Every recording's profile on all of ``labels``, in the labels' order, 0 where a recording has no value; labels of no list are left out."""
    grid = profiles.select(recording, *keys).distinct().crossJoin(F.broadcast(labels.select(node)))  # the atlas: some hundreds
    return grid.join(profiles.select(recording, node, *keys, value), [recording, node, *keys], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def profile_arrays(profiles: DataFrame, node: str, row: str, order: str, value: str, rows: int) -> DataFrame:
    """(node, row, values): values of each row in order; an error if a node's values can't be dealt into ``rows`` rows of one length."""
    listed = profiles.groupBy(node, row).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("_l"))
    whole = Window.partitionBy(node)
    sizes = F.size("_l")
    sound = (F.min(sizes).over(whole) == F.max(sizes).over(whole)) & (F.count("*").over(whole) == rows)
    checked = listed.withColumn("_ok", sound)
    return checked.select(node, row, F.when(F.col("_ok"), F.transform("_l", lambda s: s["v"])).otherwise(F.raise_error(F.lit("values can't be dealt into rows of one length"))).alias("values"))


def turned_to(points: DataFrame, target: DataFrame, node: str, x: str = "x", y: str = "y") -> DataFrame:
    """(node, x, y): plane points turned, or mirrored and turned, about the origin to lie nearest to those of ``target`` with the same node, after both are centred and scaled to unit size; all from six sums."""
    both = points.select(node, F.col(x).alias("ax"), F.col(y).alias("ay")).join(target.select(node, F.col(x).alias("bx"), F.col(y).alias("by")), node)
    m = both.agg(*(F.avg(c).alias(f"m{c}") for c in ("ax", "ay", "bx", "by")))
    c = both.crossJoin(F.broadcast(m)).select(node, *((F.col(k) - F.col(f"m{k}")).alias(k) for k in ("ax", "ay", "bx", "by")))
    p = lambda a, b: F.sum(F.col(a) * F.col(b))
    s = c.agg(p("ax", "bx").alias("xx"), p("ay", "by").alias("yy"), p("ax", "by").alias("xy"), p("ay", "bx").alias("yx"), F.sqrt(p("ax", "ax") + p("ay", "ay")).alias("na"))
    turn, mirror = F.hypot(F.col("xx") + F.col("yy"), F.col("xy") - F.col("yx")), F.hypot(F.col("xx") - F.col("yy"), F.col("xy") + F.col("yx"))
    keep = turn >= mirror
    cos = F.when(keep, (F.col("xx") + F.col("yy")) / F.nullif(turn, F.lit(0.0))).otherwise((F.col("xx") - F.col("yy")) / F.nullif(mirror, F.lit(0.0)))
    sin = F.when(keep, (F.col("xy") - F.col("yx")) / F.nullif(turn, F.lit(0.0))).otherwise((F.col("xy") + F.col("yx")) / F.nullif(mirror, F.lit(0.0)))
    r = s.select(cos.alias("c"), sin.alias("s"), F.when(keep, 1.0).otherwise(-1.0).alias("f"), "na")
    rows = c.crossJoin(F.broadcast(r))
    px, py = F.col("ax") / F.col("na"), F.col("ay") / F.col("na")
    return rows.select(node, (F.col("c") * px - F.col("f") * F.col("s") * py).alias("x"), (F.col("s") * px + F.col("f") * F.col("c") * py).alias("y"))


def exponential_fit(cells: DataFrame, m: str, s: str, steps: int = 60, tolerance: float = 1e-10) -> tuple[float, float]:
    """(g, r): g for which exp(g s) is nearest to m by mean square, from 0 by damped Newton steps, one aggregation each; and the correlation of m with it."""
    g, last = 0.0, None
    for _ in range(steps):
        e = F.exp(F.lit(g) * F.col(s))
        r_of = F.covar_pop(F.col(m), e) / F.nullif(F.stddev_pop(m) * F.stddev_pop(e), F.lit(0.0))
        gap = F.col(m) - e
        loss, slope, bend, r = cells.agg(F.avg(gap * gap), F.avg(-2 * gap * e * F.col(s)), F.avg(2 * e * F.col(s) * F.col(s) * (2 * e - F.col(m))), r_of).first()
        if last is not None and loss > last[1]:  # too far: half of the way back
            if abs(g - last[0]) < tolerance:
                break
            g = (g + last[0]) / 2
            continue
        if abs(slope) < tolerance:
            break
        last = (g, loss)
        g -= slope / bend if bend > 0 else math.copysign(0.1, slope)
    return g, float("nan") if r is None else float(r)


def angle_column(position: Column, n: Column) -> Column:
    """Angles of a uniform circle."""
    return 2 * math.pi * position / n
