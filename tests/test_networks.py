"""The network statistic in one call, relabellings, splines and alignment, against plain versions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelyard.operators import embedding, graph, inference, nulls, statistics

PRIME = 2147483647


def keyed(p, y):
    """The keyed numbers, plainly."""
    u = (48271 * ((p * 1000003 + y) % PRIME) + 11) % PRIME
    u = (u * u + 69621 * (u % 30011) + 7) % PRIME
    return (u * u + 40692 * (u % 20011) + p) % PRIME


def walked(links, chain, swaps, seed=2):
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    nodes = sorted(near)
    held = {n: n for n in nodes}
    for s in range(swaps * len(nodes)):
        u = nodes[keyed(chain + seed * 1_000_003, 2 * s) % len(nodes)]
        around = sorted(near[u])
        v = around[keyed(chain + seed * 1_000_003, 2 * s + 1) % len(around)]
        held[u], held[v] = held[v], held[u]
    return held


def fitted_t(y, columns):
    """t of the last column by least squares."""
    x = np.column_stack(columns)
    inverse = np.linalg.pinv(x)  # squares of the design would lose half of the digits
    beta = inverse @ y
    s2 = ((y - x @ beta) ** 2).sum() / max(len(y) - x.shape[1], 1)
    return beta[-1] / math.sqrt(s2 * (inverse @ inverse.T)[-1, -1])


def largest(hit):
    """Number of links of the largest component."""
    parent = {}

    def root(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in hit:
        parent[root(a)] = root(b)
    sizes = {}
    for a, _ in hit:
        sizes[root(a)] = sizes.get(root(a), 0) + 1
    return max(sizes.values(), default=0)


@pytest.fixture(scope="module")
def case(spark):
    r = np.random.RandomState(5)
    n, nodes = 14, 6
    cols = {"x": r.randn(n), "a": 1e4 + r.randn(n), "b": r.rand(n), "c": r.rand(n)}
    pairs = list(itertools.combinations(range(nodes), 2))
    y = {p: r.randn(n) + (1.2 * cols["x"] if p[1] < 3 else 0) + 2 * cols["b"] for p in pairs}
    design = spark.createDataFrame([(k, *(float(v[k]) for v in cols.values()), k % 2) for k in range(n)], "item int, x double, a double, b double, c double, half int")
    stack = spark.createDataFrame([(k, *e, float(y[p][k])) for p in pairs for e in (p, p[::-1]) for k in range(n)], "item int, i int, j int, w double")
    return n, cols, pairs, y, design, stack


@pytest.mark.parametrize(("tail", "block", "intercept"), [("both", None, True), ("right", "half", True), ("left", None, False)])
def test_network_statistic_equals_least_squares(spark, case, tail, block, intercept):
    n, cols, pairs, y, design, stack = case
    found = inference.network_statistic(stack, design, "item", "w", 1.0, 12, "x", ["a", "b", "c"], intercept, block, tail=tail)
    reduced = [*([np.ones(n)] if intercept else []), cols["a"], cols["b"], cols["c"]]
    t = {p: fitted_t(y[p], [*reduced, cols["x"]]) for p in pairs}
    got = {(r["i"], r["j"]): r["t"] for r in found.t.collect()}
    assert got.keys() == t.keys() and all(got[p] == pytest.approx(t[p], abs=1e-6) for p in pairs)
    over = {"both": abs, "right": lambda v: v, "left": lambda v: -v}[tail]
    dealt = {}
    for r in statistics.permuted(design.withColumn("f", F.col("item")), "item", "f", 12, block).collect():
        dealt.setdefault(r["perm"], [0] * n)[r["item"]] = r["f"]
    x = np.column_stack(reduced)
    left = {p: y[p] - x @ (np.linalg.pinv(x) @ y[p]) for p in pairs}
    null = {k: largest([p for p in pairs if over(fitted_t(y[p] - left[p] + left[p][dealt[k]], [*reduced, cols["x"]])) >= 1.0]) for k in range(1, 13)}
    assert {r["perm"]: r["largest"] for r in found.null.collect()} == null
    edges = found.edges.collect()
    assert {(r["i"], r["j"]) for r in edges} == {p for p in pairs if over(t[p]) >= 1.0}
    assert all(r["p"] == pytest.approx((sum(v >= r["size"] for v in null.values()) + 1) / 13) for r in edges)


def test_network_statistic_by_relabelling(spark, case):
    n, cols, pairs, y, design, stack = case
    links = [(0, 1), (1, 2), (2, 3), (3, 4)]  # 5 has no neighbour
    found = inference.network_statistic(stack, design, "item", "w", 1.0, 6, "x", ["b"], True, adjacency=spark.createDataFrame(links, "src int, dst int"))
    columns = [np.ones(n), cols["b"], cols["x"]]
    null = {}
    for k in range(1, 7):
        maps = [walked(links, (k - 1) * n + m + 1, 4) for m in range(n)]
        moved = {(i, j): np.array([y[tuple(sorted((maps[m].get(i, i), maps[m].get(j, j))))][m] for m in range(n)]) for i, j in pairs}
        null[k] = largest([p for p in pairs if abs(fitted_t(moved[p], columns)) >= 1.0])
    assert {r["perm"]: r["largest"] for r in found.null.collect()} == null


def test_network_statistic_odd_inputs(spark, case):
    n, cols, pairs, y, design, stack = case
    holes = stack.withColumn("w", F.when((F.col("item") == 3) & (F.least("i", "j") == 0) & (F.greatest("i", "j") == 1), None).otherwise(F.col("w")))
    assert {(r["i"], r["j"]) for r in inference.network_statistic(holes, design, "item", "w", 1.0, 2, "x").t.collect()} == set(pairs) - {(0, 1)}
    doubled = inference.network_statistic(stack, design.withColumn("d", 2 * F.col("x")), "item", "w", 1.0, 2, "x", ["d"])
    assert {r["t"] for r in doubled.t.collect()} == {0.0}
    with pytest.raises(ValueError, match="constant"):
        inference.network_statistic(stack, design.withColumn("one", F.lit(1.0)), "item", "w", 1.0, 2, "one")
    alone = inference.network_statistic(stack, design, "item", "w", 1.0, 4)
    got = {(r["i"], r["j"]): r["t"] for r in alone.t.collect()}
    assert all(got[p] == pytest.approx(y[p].mean() / (y[p].std(ddof=1) / math.sqrt(n)), abs=1e-6) for p in pairs)
    assert inference.network_statistic(stack.where("false"), design, "item", "w", 1.0, 2, "x").edges.count() == 0


def test_freedman_lane_leaves_out_edges_with_gaps(spark, case):
    n, cols, pairs, y, design, stack = case
    holes = stack.where("i < j and not (i = 0 and j = 1 and item = 3)")
    got = inference.freedman_lane(holes, design, "item", "x", "b", "w", ["i", "j"], 2).where("perm = 0").collect()
    assert {(r["i"], r["j"]) for r in got} == set(pairs) - {(0, 1)}
    assert all(r["t"] == pytest.approx(fitted_t(y[r["i"], r["j"]], [np.ones(n), cols["b"], cols["x"]])) for r in got)


def test_several_regressors_equal_least_squares(spark, case):
    n, cols, pairs, y, design, stack = case
    got = {(r["i"], r["j"]): r["t"] for r in statistics.several_regressors_t(stack, ["i", "j"], "w", design, "item", ["x", "a", "b", "c"], "x").collect()}
    assert all(got[p] == pytest.approx(fitted_t(y[p], [np.ones(n), cols["a"], cols["b"], cols["c"], cols["x"]]), abs=1e-6) for p in pairs)


def test_relabellings_equal_the_plain_walk(spark):
    links = [(7, 2), (2, 9), (9, 4), (4, 7), (4, 2)]
    got = {}
    for r in nulls.swapped_labels(spark.createDataFrame(links, "src int, dst int"), 5).collect():
        got.setdefault(r["perm"], {})[r["node"]] = r["image"]
    assert got == {k: walked(links, k, 10) for k in range(1, 6)}
    assert nulls.swapped_labels(spark.createDataFrame([(3, 3)], "src int, dst int"), 5).count() == 0


def test_no_relabelling_occurs_twice(spark):
    pair, path = spark.createDataFrame([(1, 2)], "src int, dst int"), spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src int, dst int")
    maps = lambda df: [tuple(sorted((x["node"], x["image"]) for x in r["m"])) for r in df.groupBy("perm").agg(F.collect_list(F.struct("node", "image")).alias("m")).collect()]
    assert maps(nulls.distinct_labels(pair, 10)) == [((1, 1), (2, 2))]  # an even number of exchanges
    found = maps(nulls.distinct_labels(path, 20))
    assert len(found) == len(set(found)) == 12  # all the even ones
    assert len(set(maps(nulls.distinct_labels(path, 9)))) == 9


def test_spatial_test_equals_a_loop(spark):
    r = np.random.RandomState(1)
    n, links = 7, [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5)]
    a, b = (np.round(m + m.T, 1) for m in (r.rand(n, n), r.rand(n, n)))  # with ties
    frame = lambda m: spark.createDataFrame([(i, j, float(m[i, j])) for i in range(n) for j in range(n) if i != j], "i int, j int, w double")
    images = nulls.swapped_labels(spark.createDataFrame(links, "src int, dst int"), 8)
    up = np.triu_indices(n, 1)
    rank = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    corr = lambda m: np.corrcoef(rank(m[up]), rank(b[up]))[0, 1]
    null = []
    for k in range(1, 9):
        order = [walked(links, k, 10).get(v, v) for v in range(n)]
        null.append(corr(a[np.ix_(order, order)]))
    got = nulls.spatial_test(frame(a), frame(b), images).first()
    assert got["r"] == pytest.approx(corr(a)) and got["perms"] == 8 and got["p"] == pytest.approx(np.mean(np.array(null) >= corr(a) - 1e-12))


def plain_spline(y, at):
    """Not-a-knot by a dense solve."""
    n = len(y)
    m = np.zeros((n, n))
    rhs = np.zeros(n)
    for k in range(1, n - 1):
        m[k, k - 1 : k + 2] = 1, 4, 1
        rhs[k] = 6 * (y[k + 1] - 2 * y[k] + y[k - 1])
    m[0, :3] = m[-1, -3:] = 1, -2, 1
    s = np.linalg.solve(m, rhs)
    k = np.clip(np.floor(at).astype(int), 0, n - 2)
    left, right = at - k, k + 1 - at
    return (s[k] * right**3 + s[k + 1] * left**3) / 6 + (y[k] - s[k] / 6) * right + (y[k + 1] - s[k + 1] / 6) * left


@pytest.mark.parametrize("n", [4, 5, 6, 9, 30])
def test_spline_equals_a_dense_solve(spark, n):
    y = np.random.RandomState(n).randn(n)
    points = spark.createDataFrame([("g", 10 * k, float(v), float(k**3)) for k, v in enumerate(y)], "s string, pos int, v double, cube double")
    got = nulls.spline(points, "s", "pos", ["v", "cube"], 17, start=1).orderBy("k").toPandas()
    at = np.linspace(1, n - 1, 17)
    assert got["v"].tolist() == pytest.approx(plain_spline(y, at).tolist()) and got["cube"].tolist() == pytest.approx((at**3).tolist())


def test_spline_of_few_points(spark):
    rows = [("one", 1, 5.0), ("two", 1, 1.0), ("two", 2, 3.0), ("three", 1, 0.0), ("three", 2, 1.0), ("three", 3, 4.0), ("three", 3, 9.0), ("void", None, 1.0), ("hole", 1, 1.0), ("hole", 2, None), ("hole", 3, 1.0)]
    got = {}
    for r in nulls.spline(spark.createDataFrame(rows, "s string, pos int, v double"), "s", "pos", ["v"], 5).orderBy("s", "k").collect():
        got.setdefault(r["s"], []).append(r["v"])
    assert got.pop("hole")[2] is None
    assert got.pop("three") == pytest.approx([0.0, 0.25, 1.0, 2.25, 4.0])
    assert got == {"one": [5.0] * 5, "two": [1.0, 1.5, 2.0, 2.5, 3.0]}


@pytest.mark.parametrize("dims", [1, 3, 5])
def test_alignment_recovers_turns_and_mirrors(spark, dims):
    r = np.random.RandomState(dims)
    base = r.randn(20, dims)
    turns = [np.eye(dims), *(np.linalg.qr(r.randn(dims, dims))[0] for _ in range(2))]
    turns.append(turns[1] @ np.diag([-1.0, *[1.0] * (dims - 1)]))
    rows = [(s, k, [float(v) for v in base[k] @ t]) for s, t in enumerate(turns) for k in range(20)]
    points = spark.createDataFrame([*rows, (0, 99, None), (9, 1, [None] * dims)], "s int, n int, g array<double>")
    found, reference = embedding.aligned(points, "s", "n", "g", dims)
    got = {(x["s"], x["n"]): x["g"] for x in found.collect()}
    assert len(got) == 80 and all(np.allclose(got[s, k], base[k], atol=1e-8) for s in range(4) for k in range(20))
    assert all(np.allclose(x["g"], base[x["n"]], atol=1e-8) for x in reference.collect())


def test_alignment_equals_a_plain_version(spark):
    r = np.random.RandomState(8)
    data = [r.randn(15, 3) for _ in range(4)]
    given = r.randn(15, 3)
    rows = [(s, k, [float(v) for v in d[k]]) for s, d in enumerate(data) for k in range(15)]
    points = spark.createDataFrame(rows, "s int, n int, g array<double>")
    ref = given
    for _ in range(4):
        turned = []
        for d in data:
            u, _, v = np.linalg.svd(d.T @ ref)
            turned.append(d @ u @ v)
        new = np.mean(turned, axis=0)
        ref = new
    start = spark.createDataFrame([(k, [float(v) for v in given[k]]) for k in range(15)], "n int, g array<double>")
    found, reference = embedding.aligned(points, "s", "n", "g", 3, start, rounds=4, tolerance=0.0)
    assert all(np.allclose(x["g"], ref[x["n"]]) for x in reference.collect())
    assert all(np.allclose(x["g"], turned[x["s"]][x["n"]]) for x in found.collect())


def test_rich_club_comparison(spark):
    r = np.random.RandomState(4)
    n, subjects = 6, 9
    hubs = {0, 1, 2}
    data = {s: np.triu(r.rand(n, n), 1) for s in range(subjects)}
    rows = [(s, "c" if s < 5 else "p", i, j, float(data[s][i, j])) for s in range(subjects) for i in range(n) for j in range(i + 1, n)]
    stack = spark.createDataFrame(rows, "s int, g string, i int, j int, w double")
    ref = spark.createDataFrame([(0, 1), (1, 0), (0, 2), (1, 2), (2, 3), (0, 4), (1, 5)], "i int, j int")
    got = {x["kind"]: x for x in inference.compare_rich_club(stack, "s", "w", "g", "c", 15, 30, 3, reference=ref, trim=0.25).collect()}
    dealt = {}
    for x in statistics.permuted(stack.select("s", "g").distinct(), "s", "g", 15).collect():
        dealt.setdefault(x["perm"], {})[x["s"]] = x["g"]
    ps = {}
    for kind, wanted in (("rich-club", 2), ("feeder", 1), ("peripheral", 0)):
        cells = [(i, j) for i in range(n) for j in range(i + 1, n) if (i in hubs) + (j in hubs) == wanted]
        m = np.array([np.mean([data[s][c] for c in cells]) for s in range(subjects)])
        x, y, found = m[:5], m[5:], got[kind]
        assert (found["n_first"], found["n_other"]) == (5, 4)
        assert [found[c] for c in ("mean_first", "mean_other", "median_first", "median_other", "diff")] == pytest.approx([x.mean(), y.mean(), np.median(x), np.median(y), x.mean() - y.mean()])
        assert (found["trimmed_first"], found["trimmed_other"]) == pytest.approx((np.sort(x)[1:-1].mean(), np.sort(y)[1:-1].mean()))
        e1, e2 = x.var(ddof=1) / 5, y.var(ddof=1) / 4
        t, df = (x.mean() - y.mean()) / math.sqrt(e1 + e2), (e1 + e2) ** 2 / (e1**2 / 4 + e2**2 / 3)
        assert found["t"] == pytest.approx(t) and found["p_t"] == pytest.approx(statistics.student_p(t, df))
        gap = lambda d, m=m: np.mean([m[s] for s in d if d[s] == "c"]) - np.mean([m[s] for s in d if d[s] == "p"])
        ps[kind] = (sum(abs(gap(dealt[k])) >= abs(gap(dealt[0])) - 1e-12 for k in range(1, 16)) + 1) / 16
        assert found["p_perm"] == pytest.approx(ps[kind]) and found["lo"] <= found["hi"]
    order = sorted(ps, key=lambda k: (ps[k], k))
    q = {k: min(min(1.0, ps[v] * 3 / (order.index(v) + 1)) for v in order[order.index(k) :]) for k in order}
    assert {k: got[k]["q_perm"] for k in got} == pytest.approx(q)


def test_rich_club_without_hubs(spark):
    stack = spark.createDataFrame([(s, "c" if s < 3 else "p", i, j, float(s + i)) for s in range(6) for i in range(3) for j in range(i + 1, 3)], "s int, g string, i int, j int, w double")
    got = {x["kind"]: x for x in inference.compare_rich_club(stack, "s", "w", "g", "c", 5, 10).collect()}
    assert set(got) == {"rich-club", "feeder", "peripheral"} and got["peripheral"]["n_first"] == 3
    assert [(got["feeder"][c]) for c in ("n_first", "n_other", "mean_first", "t", "d", "p_t", "p_perm")] == [0, 0, None, None, 0.0, 1.0, 1.0]


def test_free_energy(spark):
    v = np.random.RandomState(6).randn(40)
    rows = [*((k, float(x)) for k, x in enumerate(v)), (40, None), (41, float("nan")), (42, float("inf"))]
    values = spark.createDataFrame(rows, "node int, v double")
    edges = spark.createDataFrame([(0, 1), (1, 0), (2, 3), (3, 3), (5, 40), (6, 99)], "src int, dst int")
    c = np.histogram(v, bins=round(2 * 43 ** (1 / 3)))[0]
    p = c[c > 0] / 40
    every, near = graph.free_energy(values, "v").first(), graph.free_energy(values, "v", edges, bins=5).first()
    assert every["energy"] == pytest.approx(sum((a - b) ** 2 for a, b in itertools.combinations(v, 2))) and every["entropy"] == pytest.approx(-(p * np.log10(p)).sum())
    c = np.histogram(v, bins=5)[0]
    p = c[c > 0] / 40
    assert near["energy"] == pytest.approx((v[0] - v[1]) ** 2 + (v[2] - v[3]) ** 2) and near["entropy"] == pytest.approx(-(p * np.log10(p)).sum())
    flat, none = graph.free_energy(values.where("node = 3"), "v").first(), graph.free_energy(values.where("node >= 40"), "v").first()
    assert (flat["energy"], flat["entropy"]) == (0.0, 0.0) and math.isnan(none["energy"]) and math.isnan(none["entropy"])
    assert math.isnan(graph.free_energy(values.where("false"), "v").first()["entropy"])


def test_trade_is_made_once(spark, sf_dir):
    # Label propagation used to join all lines again in every round, as the links were a plan over the whole tables.
    from parcelyard.plans import views

    plan = views.edges(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan and "Join" not in plan


def test_hops_are_joined_as_sets(spark):
    # 60 nodes, all linked, then 60 more in a row: a step used to make a row for each way to a node.
    links = [(a, b) for a in range(60) for b in range(60) if a != b] + [(n, n + 1) for n in range(59, 700, 1)] + [(5, -3), (-3, 10**12)]
    rows = spark.createDataFrame(links, "src bigint, dst bigint")
    got = {(r["src"], r["dst"]): r["hops"] for r in graph.k_hop(rows, 3).collect()}
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
    expected = {}
    for a in near:
        seen, front = {a}, {a}
        for n in (1, 2, 3):
            front = {c for b in front for c in near.get(b, ())} - seen
            seen |= front
            expected |= {(a, c): n for c in front}
    assert got == expected
    assert dict(graph.k_hop(rows.selectExpr("cast(src as int) as src", "cast(dst % 1000 as int) as dst"), 2).dtypes) == {"src": "int", "dst": "int", "hops": "int"}


def test_tasks_grow_in_number_with_rows(spark):
    from parcelyard.functions.lineage import ROWS_A_TASK, dealt

    rows = spark.range(100)
    assert dealt(rows, 100, "id").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert dealt(rows, 50 * ROWS_A_TASK, "id").rdd.getNumPartitions() == 50


def test_pairs_of_suppliers_are_counted_by_half(spark, sf_dir):
    from parcelyard.plans import community_queries

    links = community_queries.cosupply(spark, sf_dir)
    assert links.join(links.selectExpr("src as dst", "dst as src", "w as other"), ["src", "dst"]).where("w = other").count() == links.count() > 0
    assert "Join" not in links._jdf.queryExecution().optimizedPlan().toString()


def test_reference_graph_by_density_makes_the_mean_once(spark, tmp_path):
    """Rows come in another order each time they are made, as after a shuffle, and so sum to another last bit."""
    runs = tmp_path / "runs"

    def rows(batches):
        with runs.open("a") as f:
            f.write(".")
        for batch in batches:
            yield batch.sort_values("w", ascending=runs.stat().st_size <= 2)

    frame = [(i, 100 + i, w * 2**i) for i in range(10) for w in (1.0, 1.0, 1e16)]
    stack = spark.createDataFrame(frame, "i int, j int, w double").coalesce(1).mapInPandas(rows, "i int, j int, w double")
    assert {tuple(r) for r in inference.reference_graph(stack, "density", 0.2).collect()} == {(8, 108), (9, 109)}
