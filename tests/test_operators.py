"""Cases whose answers are known by hand."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parcelyard.operators import catalog, embedding, graph, matrices, nulls, parcels, similarity, statistics, volumes


def both_ways(spark, pairs):
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs] + [(b, a, 1.0) for a, b in pairs], "src int, dst int, w double")


def test_average_rank_of_ties(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (0, 2.0), (0, 3.0)], "k int, v double")
    assert sorted(r["rnk"] for r in similarity.average_rank(df, ["k"], "v").collect()) == [1, 2.5, 2.5, 4]


def test_constant_profiles_have_no_correlation(spark):
    df = spark.createDataFrame([(n, k, float(k if n else 1)) for n in (0, 1) for k in range(4)], "n int, k int, v double")
    r = {(x["i"], x["j"]): x["r"] for x in similarity.pearson(df, "n", ["k"], "v").collect()}
    assert r[0, 0] is None and r[0, 1] is None and r[1, 1] == pytest.approx(1)


def test_energy(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "v double")
    assert graph.energy_all(df, "v").first()["energy"] == pytest.approx(14)


def test_paths_of_the_four_node_example(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (2, 4)], "src int, dst int")
    got = {tuple(r["nodes"]) for r in graph.simple_paths(e, 1, 3, goal=4).collect()}
    assert got == {(1, 2, 3, 4), (1, 2, 4), (1, 3, 4)}


def test_rich_club_of_a_clique_with_a_pendant(spark):
    e = both_ways(spark, [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3), (3, 4)])
    phi = {r["k"]: (r["nodes"], r["links"], r["phi"]) for r in graph.rich_club(e).collect()}
    assert phi[2] == (4, 6, 1.0) and phi[0] == (5, 7, pytest.approx(0.7))


def test_components_of_a_long_chain(spark):
    e = both_ways(spark, [(k, k + 1) for k in range(40)] + [(100, 101)])
    got = {r["node"]: r["component"] for r in graph.components(e).collect()}
    assert all(got[k] == 0 for k in range(41)) and got[101] == 100


def test_empty_graph(spark):
    e = both_ways(spark, [(0, 1)]).where("false")
    assert graph.components(e).count() == 0 and graph.rich_club(e).count() == 0 and graph.degree(e).count() == 0


def test_fisher_z_clips(spark):
    z = spark.createDataFrame([(0.0,), (1.0,)], "r double").select(statistics.fisher_z(F.col("r")).alias("z")).collect()
    assert z[0]["z"] == 0 and z[1]["z"] == pytest.approx(math.atanh(0.999999))


def test_fdr(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.02), (3, 0.03)], "id int, p double")
    assert [r["q"] for r in statistics.bh_fdr(df, "p", ["id"]).orderBy("id").collect()] == pytest.approx([0.03, 0.03, 0.03])


@pytest.mark.parametrize(("t", "df", "p"), [(2.228139, 10, 0.05), (1.959964, 1e7, 0.05), (12.706205, 1, 0.05), (0.0, 5, 1.0), (3.169273, 10, 0.01)])
def test_student_tail(t, df, p):
    assert statistics.student_p(t, df) == pytest.approx(p, abs=1e-6)


@settings(max_examples=60, deadline=None)
@given(st.floats(-50, 50), st.floats(0.5, 500))
def test_student_tail_is_a_probability(t, df):
    assert 0 <= statistics.student_p(t, df) <= 1 and statistics.student_p(t, df) == pytest.approx(statistics.student_p(-t, df))


def test_barycentre(spark):
    p = spark.createDataFrame([(1.0, 1.0)], "x double, y double")
    r = embedding.barycentric(p, [(0, 0), (3, 0), (0, 3)]).first()
    assert [r["w0"], r["w1"], r["w2"]] == pytest.approx([1 / 3] * 3)


def test_nan_is_skipped_in_parcel_means(spark):
    df = spark.createDataFrame([(1, 1.0), (1, float("nan")), (2, float("nan"))], "k int, v double")
    got = {r["k"]: r["mean"] for r in parcels.parcel_mean(df, ["k"], "v", spark.createDataFrame([(1,), (2,), (3,)], "k int")).collect()}
    assert got == {1: 1.0, 2: None, 3: 0.0}


def test_trimming_everything_leaves_the_median(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 5.0), (0, 9.0), (0, 10.0)], "k int, v double")
    assert parcels.trimmed_mean(df, ["k"], "v", 0.5).first()["trimmed"] == 7.0


def test_predicates(spark):
    df = spark.createDataFrame([("a", "12", "1"), ("B", "x", " 2"), (None, None, "")], "name string, age string, n string")
    assert catalog.numeric_columns(df) == {"n"}
    keep = lambda *t: [r[0] for r in df.where(catalog.predicate(list(t), df.columns, {"age", "n"})).collect()]
    assert keep("AGE,>3") == ["a"] and keep("age,!=12") == ["B", None] and keep("name,B") == ["B"] and keep("name,a", "name,==B") == ["a", "B"]
    assert keep("name,a", "n,2") == [] and keep("name,!=a") == ["B", None] and keep("n,<=1") == ["a"]
    assert df.where(catalog.predicate(["name,a", "name,B"], df.columns, set(), strict=True)).count() == 0
    assert catalog.selection_suffix(["name,a", "name,B", "age,>5"], df.columns) == "sel-name-ina_B_age-gt5"
    for bad in (["size,3"], ["name"], ["name,>a"]):
        with pytest.raises(ValueError):
            catalog.predicate(bad, df.columns, set())


def test_bad_regular_expression_matches_all(spark):
    df = spark.createDataFrame([("x",)], "c string")
    assert df.where(catalog.text_search(F.col("c"), "re:[")).count() == 1


def test_inpainting_and_holes(spark):
    grid = [(x, y, z, (x, y, z) != (1, 1, 1), 2.0 if (x, y, z) != (1, 1, 1) else 50.0) for x in range(3) for y in range(3) for z in range(3)]
    v = spark.createDataFrame(grid, "x int, y int, z int, m boolean, value double")
    hole = volumes.holes(v, "m")
    assert [tuple(r) for r in hole.collect()] == [(1, 1, 1)]
    assert {r["value"] for r in volumes.median_inpainted(v, hole, "value").collect()} == {2.0}
    assert volumes.median_inpainted(v.where("false"), hole, "value").count() == 0


def test_alignment_fills_zeros(spark):
    m = spark.createDataFrame([(1, 0, 0, 1.0), (1, 0, 1, 1.0), (1, 1, 0, 1.0), (1, 1, 1, 1.0), (2, 0, 0, 5.0)], "yr int, i int, j int, w double")
    got = {(r["yr"], r["i"], r["j"]): r["w"] for r in matrices.aligned(m, "yr").collect()}
    assert len(got) == 8 and got[2, 0, 0] == 5.0 and got[2, 1, 1] == 0.0


def test_islands_need_two_points(spark):
    df = spark.createDataFrame([(0, k, v) for k, v in enumerate([1.0, 2.0, float("nan"), 3.0, None, 4.0, 5.0, 6.0])], "s int, pos int, value double")
    assert sorted((r["first"], r["last"]) for r in embedding.islands(df, ["s"], "pos", "value").collect()) == [(0, 1), (5, 7)]


def test_rewiring_keeps_degrees(spark):
    e = both_ways(spark, [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (4, 5), (5, 0), (1, 4)])
    got = nulls.rewired(e, 5).toPandas()
    want = graph.degree(e).toPandas().set_index("node")["degree"].to_dict()
    for _, g in got.groupby("perm"):
        d = g["src"].value_counts().add(g["dst"].value_counts(), fill_value=0).astype(int).to_dict()
        assert d == want and (g["src"] < g["dst"]).all()
    assert got.equals(nulls.rewired(e, 5).toPandas())


def test_swapped_labels_are_permutations(spark):
    e = both_ways(spark, [(k, k + 1) for k in range(9)])
    for _, g in nulls.swapped_labels(e, 4).toPandas().groupby("perm"):
        assert sorted(g["image"]) == sorted(g["node"]) == list(range(10))


def test_spline_passes_through_points(spark):
    p = spark.createDataFrame([("a", k, float(k * k)) for k in range(5)], "s string, pos int, x double")
    got = nulls.spline(p, "s", "pos", ["x"], 9).orderBy("k").toPandas()
    assert got["x"].iloc[::2].tolist() == pytest.approx([0, 1, 4, 9, 16])


def test_order_of_a_path(spark):
    e = both_ways(spark, [(3, 0), (0, 4), (4, 1), (1, 2)])
    at = {r["node"]: r["position"] for r in nulls.bandwidth_order(e).collect()}
    assert max(abs(at[a] - at[b]) for a, b in [(3, 0), (0, 4), (4, 1), (1, 2)]) == 1


def test_sound_edges(spark):
    e = spark.createDataFrame([(0, 1, 2.0), (1, 1, 1.0), (0, 9, 1.0), (1, 0, float("nan")), (0, 1, -3.0)], "src int, dst int, w double")
    assert [r["w"] for r in graph.sound_edges(e, 3).collect()] == [2.0, 1.0, 1.0]


def test_hemisphere(spark):
    n = spark.createDataFrame([(4, "ctx-lh-a"), (7, "ctx-rh-a"), (9, "ctx-lh-b")], "node int, name string")
    kept, moved = graph.hemisphere(n, both_ways(spark, [(4, 9), (4, 7)]), "name", "-rh")
    assert [(r["node"], r["idx"]) for r in kept.orderBy("node").collect()] == [(4, 0), (9, 1)] and {(r["src"], r["dst"]) for r in moved.collect()} == {(0, 1), (1, 0)}


def test_largest_triangle_of_a_round_cloud(spark):
    """Any corner of the hull may be in it, not only the farthest points of a few directions."""
    import itertools

    import numpy as np

    r = np.random.RandomState(2)
    turn, reach = r.uniform(0, 2 * np.pi, 60), np.concatenate([np.ones(40), r.uniform(0, 0.9, 20)])
    at = np.column_stack([reach * np.cos(turn), reach * np.sin(turn)])
    best = max(abs((at[b] - at[a])[0] * (at[c] - at[a])[1] - (at[c] - at[a])[0] * (at[b] - at[a])[1]) / 2 for a, b, c in itertools.combinations(range(60), 3))
    points = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(at)], "n int, x double, y double").repartition(5)
    (got,) = embedding.largest_triangle(points, "n").collect()
    assert math.isclose(got["area"], best, abs_tol=1e-8)
    assert embedding.largest_triangle(points.where("false"), "n").count() == 0


def test_large_groups_are_shared_by_tasks(spark, monkeypatch):
    from parcelyard.functions import numbering
    from parcelyard.operators import similarity

    monkeypatch.setattr(numbering, "ROWS_A_TASK", 7)  # so that a group spans ranges
    rows = spark.range(200).selectExpr("id % 2 as g", "if(id % 11 = 0, null, double((id * 37) % 61)) as v")
    plain = {tuple(r) for r in similarity.average_rank(rows, ["g"], "v", "r").collect()}
    assert {tuple(r) for r in similarity.ranked_by_ranges(rows, ["g"], "v", "r", 200).collect()} == plain
    for share in (0.0, 0.1, 0.37, 0.5):
        for r in parcels.trimmed_mean(rows, ["g"], "v", share).collect():
            own = sorted(((x["v"] is not None, x["v"] or 0.0) for x in rows.where(f"g = {r['g']}").collect()))
            cut = math.floor(share * len(own))
            core = [v for known, v in own[cut : len(own) - cut] if known] or [v for known, v in own if known]
            expected = sum(core) / len(core) if 2 * cut < len(own) else sorted(core)[len(core) // 2] / 2 + sorted(core)[(len(core) - 1) // 2] / 2
            assert math.isclose(r["trimmed"], expected), (share, r)


def test_nearest_in_tiles(spark, monkeypatch):
    from parcelyard.operators import similarity

    monkeypatch.setattr(similarity, "_QUERIES", 5)
    monkeypatch.setattr(similarity, "_POINTS", 9)
    points = [(n, [float(n % 7), float(n * n % 5), 1e3]) for n in range(60)] + [(60, None)]
    p = spark.createDataFrame(points, "id bigint, e array<double>")
    found = similarity.nearest_edges(p.where("id % 4 = 0"), p, "id", "e", 6)
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()  # not an expression for each pair
    got = {(r["i"], r["rank"]): r["j"] for r in found.collect()}
    for i in range(0, 60, 4):
        near = sorted((round(math.dist(points[i][1], e), 9), j) for j, e in points if e)[:6]
        assert [got[i, n + 1] for n in range(6)] == [j for _, j in near]
    assert similarity.nearest_edges(p.where("false"), p, "id", "e", 6).count() == 0


def test_quadratic_rho_comes_with_its_p(spark):
    """As the reference returns both. A constant side has neither."""
    import numpy as np

    x = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]
    y = [3.1, 0.4, 5.2, 1.7, 9.9, 2.8, 4.6, 7.3]
    rows = [("a", *v) for v in zip(x, y, strict=True)] + [("b", 2.0, v) for v in y]
    got = {r["g"]: r for r in similarity.quadratic_rho(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y").collect()}
    slope, intercept = np.polyfit(x, y, 1)
    ranks = lambda v: np.argsort(np.argsort(v))
    rho = np.corrcoef(ranks(np.square(x)), ranks(np.array(y) - slope * np.array(x) - intercept))[0, 1]
    assert got["a"]["rho"] == pytest.approx(rho) and got["a"]["n"] == 8
    assert got["a"]["p"] == pytest.approx(statistics.student_p(rho * np.sqrt(6 / (1 - rho**2)), 6))
    assert got["b"]["rho"] is None and got["b"]["p"] is None
