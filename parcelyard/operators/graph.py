"""Graphs as edge tables (src, dst, w), in both directions unless said otherwise; several graphs at once by more key columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut, dealt


def degree(edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    return edges.groupBy(*(by or []), F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def hubs_by_quantile(edges: DataFrame, share: float) -> DataFrame:
    """Nodes whose degree reaches the (1 - share) quantile of degrees."""
    d = degree(edges)
    return d.crossJoin(F.broadcast(d.agg(F.percentile("degree", 1 - share).alias("_least")))).where("degree >= _least").select("node", "degree")  # one row is broadcast


def rich_club(edges: DataFrame) -> DataFrame:
    """(k, nodes, links, phi): phi = 2E / (N (N - 1)) of the nodes of degree > k, for every k that leaves two.

    One row a degree, then sums over larger degrees: the graph isn't walked once for each k.
    """
    d = degree(edges)
    by_degree = d.groupBy("degree").agg(F.count("*").alias("n"))
    links = edges.where("src < dst").join(d.select(F.col("node").alias("src"), F.col("degree").alias("a")), "src").join(d.select(F.col("node").alias("dst"), F.col("degree").alias("b")), "dst")
    by_least = links.groupBy(F.least("a", "b").alias("degree")).agg(F.count("*").alias("e"))
    each = by_degree.join(by_least, "degree", "left").select("degree", "n", F.coalesce("e", F.lit(0)).alias("e"))
    above = Window.orderBy(F.desc("degree")).rowsBetween(Window.unboundedPreceding, 0)  # one row a distinct degree
    k = each.select((F.col("degree") - 1).alias("k"), F.sum("n").over(above).alias("nodes"), F.sum("e").over(above).alias("links"))
    return k.where("nodes >= 2").withColumn("phi", 2 * F.col("links") / (F.col("nodes") * (F.col("nodes") - 1)))


def rich_club_means(stack: DataFrame, hubs: DataFrame, by: str, value: str = "w") -> DataFrame:
    """Mean weight a recording of rich-club, feeder and peripheral links, upper triangle."""
    h = hubs.select("node").distinct()
    marked = (
        stack.where("i < j")
        .join(h.select(F.col("node").alias("i"), F.lit(1).alias("hi")), "i", "left")
        .join(h.select(F.col("node").alias("j"), F.lit(1).alias("hj")), "j", "left")
        .withColumn("_h", F.coalesce("hi", F.lit(0)) + F.coalesce("hj", F.lit(0)))
    )
    kind = F.when(F.col("_h") == 2, "rich-club").when(F.col("_h") == 1, "feeder").otherwise("peripheral")
    return marked.groupBy(by, kind.alias("kind")).agg(F.avg(value).alias("mean"))


def label_adjacency(voxels: DataFrame, label: str) -> DataFrame:
    """(src, dst, n), both ways: touching faces of different labels. A voxel looks in the three positive directions only."""
    v = voxels.select("x", "y", "z", F.col(label).alias("_l")).distinct()
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a, b, c in ((1, 0, 0), (0, 1, 0), (0, 0, 1))))
    near = v.select(F.col("_l").alias("src"), "x", "y", "z", F.explode(steps).alias("s")).select("src", (F.col("x") + F.col("s.a")).alias("x"), (F.col("y") + F.col("s.b")).alias("y"), (F.col("z") + F.col("s.c")).alias("z"))
    faces = near.join(v.withColumnRenamed("_l", "dst"), ["x", "y", "z"]).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    both = faces.select(F.explode(F.array(F.struct("src", "dst", "n"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))).alias("e"))
    return both.groupBy("e.src", "e.dst").agg(F.sum("e.n").alias("n"))


#: A node's set of others is kept as rows of eight words of 64 bits, a row for each 512 ids of which it holds some.
_WORDS = [f"w{i}" for i in range(8)]


def _bits(pairs: DataFrame) -> DataFrame:
    """(node, block, w0 .. w7) of rows (src, dst)."""
    word, bit = F.shiftright("dst", 6).bitwiseAND(F.lit(7)), F.expr("shiftleft(1L, cast(dst & 63 as int))")
    rows = pairs.select(F.col("src").alias("node"), F.shiftright("dst", 9).alias("block"), word.alias("_i"), bit.alias("_b"))
    return rows.groupBy("node", "block").agg(*(F.bit_or(F.when(F.col("_i") == i, F.col("_b")).otherwise(F.lit(0).cast("long"))).alias(w) for i, w in enumerate(_WORDS)))


def _pairs(sets: DataFrame) -> DataFrame:
    """(src, dst) of rows (node, block, w0 .. w7)."""
    words = sets.select("node", "block", F.posexplode(F.array(*_WORDS)).alias("_i", "_w")).where("_w <> 0")
    bits = F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit("_w", b) == 1))
    return words.select("node", "block", "_i", bits.alias("_b")).select(F.col("node").alias("src"), (F.col("block") * 512 + F.col("_i") * 64 + F.col("_b")).alias("dst"))


def k_hop(edges: DataFrame, k: int) -> DataFrame:
    """(src, dst, hops): nodes reachable in 1 to ``k`` steps, with the fewest. Ids are whole numbers.

    A step joins a node's links with the sets that were new to its neighbours, as bits, so that a dense graph costs a row for each 512 ids
    of a link's far side, not one for each way there.
    """
    kind = dict(edges.dtypes)
    links = cut(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src <> dst").distinct())
    rows = links.count()
    links = cut(dealt(links, rows, "dst"))
    front = cut(_bits(links))
    known = _bits(links.unionByName(links.select("src", F.col("src").alias("dst")).distinct()))  # a node isn't reached anew
    found = links.withColumn("hops", F.lit(1))
    for n in range(2, k + 1):
        step = links.join(front.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node"), "block").agg(*(F.bit_or(w).alias(w) for w in _WORDS))
        before = known.select("node", "block", *(F.col(w).alias(f"_{w}") for w in _WORDS))
        new = step.join(before, ["node", "block"], "left").select("node", "block", *(F.col(w).bitwiseAND(F.bitwise_not(F.coalesce(f"_{w}", F.lit(0).cast("long")))).alias(w) for w in _WORDS))
        front = cut(new.where(" or ".join(f"{w} <> 0" for w in _WORDS)))
        if front.isEmpty():
            break
        found = found.unionByName(_pairs(front).withColumn("hops", F.lit(n)))
        known = known.unionByName(front).groupBy("node", "block").agg(*(F.bit_or(w).alias(w) for w in _WORDS))
    return found.select(F.col("src").cast(kind["src"]).alias("src"), F.col("dst").cast(kind["dst"]).alias("dst"), "hops")


def components(edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, node, component): the least node that can be reached. All graphs of a table at once; labels halve their distance each round."""
    by = by or []
    links = cut(edges.select(*by, "src", "dst").where("src <> dst").distinct())
    return reached(cut(dealt(links, links.count(), *by, "dst")), by)


def reached(links: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``components`` of written links without loops, in both directions, dealt by ``by`` and dst."""
    by = by or []
    labels = cut(links.groupBy(*by, F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("component")))
    while True:
        near = links.join(labels.withColumnRenamed("node", "dst"), [*by, "dst"]).groupBy(*by, F.col("src").alias("node")).agg(F.min("component").alias("_near"))
        beyond = labels.select(*by, F.col("node").alias("component"), F.col("component").alias("_beyond"))
        new = labels.join(near, [*by, "node"]).join(beyond, [*by, "component"], "left")
        new = cut(new.select(*by, "node", F.least("component", "_near", "_beyond").alias("_new"), "component"))
        moved = not new.where("_new <> component").isEmpty()
        labels = new.select(*by, "node", F.col("_new").alias("component"))
        if not moved:
            return labels


def simple_paths(edges: DataFrame, start: int, cutoff: int, goal: int | None = None) -> DataFrame:
    """(nodes, length): paths without repeated nodes from ``start`` of 1 to ``cutoff`` links, by joins that lengthen them; each length is written once."""
    links = cut(edges.select(F.col("src").alias("_at"), F.col("dst").alias("_to")).distinct())
    front = links.where(F.col("_at") == start).where("_at <> _to").select(F.array("_at", "_to").alias("nodes"))
    found = front
    for _ in range(cutoff - 1):
        grow = front if goal is None else front.where(F.element_at("nodes", -1) != goal)
        front = cut(grow.withColumn("_at", F.element_at("nodes", -1)).join(links, "_at").where(~F.array_contains("nodes", F.col("_to"))).select(F.concat("nodes", F.array("_to")).alias("nodes")))
        if front.isEmpty():
            break
        found = found.union(front)
    found = found if goal is None else found.where(F.element_at("nodes", -1) == goal)
    return found.withColumn("length", F.size("nodes") - 1)


def shortest_paths(edges: DataFrame, start: int, most: int) -> DataFrame:
    """(node, path, length): of the shortest paths from ``start``, the least node list; nodes within ``most`` links. A step reads what the one before wrote."""
    links = cut(edges.select(F.col("src").alias("_at"), F.col("dst").alias("node")).distinct())
    found = links.sparkSession.range(1).select(F.lit(start).cast("int").alias("node"), F.array(F.lit(start).cast("int")).alias("path"))
    front = found
    for _ in range(most):
        step = front.withColumnRenamed("node", "_at").join(links, "_at").select(F.col("node").cast("int").alias("node"), F.concat("path", F.array(F.col("node").cast("int"))).alias("path"))
        front = cut(step.join(found, "node", "left_anti").groupBy("node").agg(F.min("path").alias("path")))
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found.withColumn("length", F.size("path") - 1)


def with_path_ids(paths: DataFrame) -> DataFrame:
    """(path_id, pos, node): the id is the node list as text, so it doesn't depend on order."""
    named = paths.withColumn("path_id", F.array_join(F.transform("nodes", lambda x: x.cast("string")), ","))
    return named.select("path_id", F.posexplode("nodes").alias("pos", "node"))


def path_gradient(steps: DataFrame, value: str, path: str = "path_id", pos: str = "pos") -> DataFrame:
    """Differences along each path: central inside, one-sided at the ends."""
    w = Window.partitionBy(path).orderBy(pos)
    before, after, here = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    slope = F.when(before.isNull() & after.isNull(), F.lit(0.0)).when(before.isNull(), after - here).when(after.isNull(), here - before).otherwise((after - before) / 2)
    return steps.withColumn("grad", slope)


def path_scores(steps: DataFrame, value: str, lo: float, hi: float, bins: int, path: str = "path_id") -> DataFrame:
    """(path_id, length, sum of squared gradients, entropy of the values' histogram, cost = their ratio)."""
    graded = path_gradient(steps, value, path)
    sums = graded.groupBy(path).agg(F.count("*").alias("nodes"), F.sum(F.col("grad") * F.col("grad")).alias("grad2"))
    b = F.least(F.floor((F.col(value) - lo) / (hi - lo) * bins), F.lit(bins - 1))
    p = F.col("count") / F.sum("count").over(Window.partitionBy(path))
    spread = steps.groupBy(path, b.alias("_b")).count().withColumn("_p", p).groupBy(path).agg((-F.sum(F.col("_p") * F.ln("_p")) / F.ln(F.lit(float(bins)))).alias("entropy"))
    return sums.join(spread, path).withColumn("cost", F.col("grad2") / F.nullif(F.col("entropy"), F.lit(0.0)))


def whitelisted(steps: DataFrame, allowed: DataFrame, path: str = "path_id") -> DataFrame:
    """Steps of the paths all of whose nodes are allowed."""
    bad = steps.join(allowed.select("node"), "node", "left_anti").select(path).distinct()
    return steps.join(bad, path, "left_anti")


def perturbed(steps: DataFrame, edges: DataFrame, path: str = "path_id") -> DataFrame:
    """(path_id, pos, old, new): every inner node replaced by another common neighbour of the nodes beside it that isn't on the path."""
    w = Window.partitionBy(path).orderBy("pos")
    inner = steps.select(path, "pos", F.col("node").alias("old"), F.lag("node").over(w).alias("_prev"), F.lead("node").over(w).alias("_next")).where("_prev is not null and _next is not null")
    a = edges.select(F.col("src").alias("_prev"), F.col("dst").alias("new"))
    b = edges.select(F.col("src").alias("_next"), F.col("dst").alias("new"))
    options = inner.join(a, "_prev").join(b, ["_next", "new"])
    return options.join(steps.select(path, F.col("node").alias("new")), [path, "new"], "left_anti").select(path, "pos", "old", "new").distinct()


def energy_all(values: DataFrame, value: str) -> DataFrame:
    """Sum of squared differences of all pairs, from two moments: n * sum(x^2) - sum(x)^2."""
    x = F.col(value)
    return values.agg((F.count(x) * F.sum(x * x) - F.pow(F.sum(x), 2)).alias("energy"))


def energy_adjacent(values: DataFrame, edges: DataFrame, value: str) -> DataFrame:
    """The same over the pairs that an edge joins."""
    pairs = edges.select(F.least("src", "dst").alias("_a"), F.greatest("src", "dst").alias("_b")).where("_a <> _b").distinct()
    a = values.select(F.col("node").alias("_a"), F.col(value).alias("_va"))
    b = values.select(F.col("node").alias("_b"), F.col(value).alias("_vb"))
    return pairs.join(a, "_a").join(b, "_b").agg(F.sum(F.pow(F.col("_va") - F.col("_vb"), 2)).alias("energy"))


def free_energy(values: DataFrame, value: str, edges: DataFrame | None = None, bins: int | None = None) -> DataFrame:
    """(energy, entropy), one row: squared differences of all pairs, or of the pairs that an edge joins, and the entropy (base 10) of the values' histogram.

    ``values(node, value)``. Null, NaN and infinite values take no part, but count for the number of bins: 2 * n ** (1 / 3) of all rows,
    rounded, at least 2. The histogram reaches from the least to the largest value; values that hardly differ have entropy 0. Without
    finite values both are NaN.
    """
    x = F.col(value).cast("double")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    sound = values.where(finite).withColumn(value, x)
    of_all = F.bround(2 * F.pow(F.count("*"), F.lit(1 / 3))) if bins is None else F.lit(bins)
    own = F.when(finite, x)
    span = values.agg(F.greatest(of_all.cast("int"), F.lit(2)).alias("_bins"), F.min(own).alias("_lo"), F.max(own).alias("_hi"))
    at = F.least(F.floor((F.col(value) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * F.col("_bins")), F.col("_bins") - 1)
    counts = sound.crossJoin(F.broadcast(span)).groupBy(at.alias("_b")).agg(F.count("*").alias("_c"))  # one row is broadcast
    # p log p from sums of c and of c log c, so the bins needn't meet.
    spread = counts.agg(F.sum("_c").alias("_n"), F.sum(F.col("_c") * F.log10("_c")).alias("_clogc"))
    energy = energy_all(sound, value) if edges is None else energy_adjacent(sound, edges, value)
    flat = F.abs(F.col("_hi") - F.col("_lo")) <= 1e-8 + 1e-5 * F.abs("_hi")
    entropy = F.when(flat, 0.0).otherwise(F.log10("_n") - F.col("_clogc") / F.col("_n"))
    none = F.col("_lo").isNull()
    whole = energy.join(span).join(spread)  # one row each
    return whole.select(F.when(none, float("nan")).otherwise(F.coalesce("energy", F.lit(0.0))).alias("energy"), F.when(none, float("nan")).otherwise(entropy).alias("entropy"))


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, community): each round a node takes the label with most weight around it, ties to the least; all nodes at once."""
    labels = cut(edges.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node")))
    for _ in range(rounds):
        votes = edges.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node"), "community").agg(F.sum("w").alias("v"))
        labels = cut(votes.groupBy("node").agg(F.min_by("community", F.struct(-F.col("v"), F.col("community"))).alias("community")))
    return labels


def restricted(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between the given nodes, without self loops."""
    return edges.where("src <> dst").join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")


def sound_edges(edges: DataFrame, nodes: int) -> DataFrame:
    """Edges whose ends are 0 to ``nodes`` - 1 and differ; weights that are null, not finite or not positive become 1."""
    w = F.col("w")
    bad = w.isNull() | F.isnan(w) | (F.abs(w) == float("inf")) | (w <= 0)
    return edges.where(F.col("src").between(0, nodes - 1) & F.col("dst").between(0, nodes - 1) & (F.col("src") != F.col("dst"))).withColumn("w", F.when(bad, 1.0).otherwise(w))


def hemisphere(nodes: DataFrame, edges: DataFrame, name: str, other: str) -> tuple[DataFrame, DataFrame]:
    """Nodes whose name doesn't hold ``other``, numbered anew from 0, and the edges between them under the new numbers."""
    kept = nodes.where(~F.col(name).contains(other)).withColumn("idx", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("node")) - 1)  # a node a parcel
    ids = kept.select("node", "idx")
    moved = edges.join(ids.select(F.col("node").alias("src"), F.col("idx").alias("_a")), "src").join(ids.select(F.col("node").alias("dst"), F.col("idx").alias("_b")), "dst")
    return kept, moved.select(F.col("_a").alias("src"), F.col("_b").alias("dst"), "w")


def oriented(steps: DataFrame, value: str, path: str = "path_id") -> DataFrame:
    """Values turned round (largest of all less each) on paths that start higher than they end."""
    w = Window.partitionBy(path).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    top = steps.agg(F.max(value).alias("_top"))
    return steps.crossJoin(F.broadcast(top)).withColumn(value, F.when(F.first(value).over(w) > F.last(value).over(w), F.col("_top") - F.col(value)).otherwise(F.col(value))).drop("_top")


def few_gaps(steps: DataFrame, value: str, most: int = 1, path: str = "path_id") -> DataFrame:
    """Steps of the paths with at most ``most`` values that are null or NaN."""
    gaps = F.sum((F.isnan(value) | F.col(value).isNull()).cast("int")).over(Window.partitionBy(path))
    return steps.withColumn("_gaps", gaps).where(F.col("_gaps") <= most).drop("_gaps")


def adjusted_end(node: int, values: DataFrame, edges: DataFrame, goal: float) -> DataFrame:
    """(node, v): of a node and its neighbours the one whose value lies farthest from ``goal``; ties to the least node."""
    near = edges.where(F.col("src") == node).select(F.col("dst").alias("node")).unionByName(edges.sparkSession.range(1).select(F.lit(node).cast("int").alias("node"))).distinct()
    far = F.abs(F.col("v") - goal)
    return values.join(near, "node", "left_semi").orderBy(F.desc(far), "node").limit(1)


def through(edges: DataFrame, stops: list[int], most: int) -> DataFrame:
    """(leg, path, length): the shortest path of each two stops in a row; legs without one are left out."""
    legs = None
    for k, (a, b) in enumerate(zip(stops[:-1], stops[1:], strict=True)):
        leg = shortest_paths(edges, a, most).where(F.col("node") == b).select(F.lit(k).alias("leg"), "path", "length")
        legs = leg if legs is None else legs.unionByName(leg)
    return legs
