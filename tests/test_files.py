"""Names, paths, labels and paths through graphs with answers known by hand."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelyard.operators import catalog, files, inference, layout, paths
from parcelyard.sources import tables


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("a/sub-01/ses-T2/anat/sub-01_ses-T2_T1w.nii.gz", ("01", "V2", "subject from filename, session from filename")),
        ("a/Results_S7_T3/MRSI_NIFTI/x.nii", ("S7", "V3", "subject from folder Results_S7_T3, session from folder Results_S7_T3")),
        ("a/S9_v1/Results_S7/x.nii", ("S7", "V1", "subject from folder Results_S7, session from folder S9_v1")),
        ("a/b/p1S3_T4_x.nii", ("p1S3", "V4", "subject from loose pattern, session from loose pattern")),
        ("a/b/x.nii", ("", "", "")),
        ("a/S5-V2/sub-8_x.nii", ("8", "V2", "subject from filename, session from folder S5-V2")),
    ],
)
def test_guess(spark, path, want):
    assert tuple(one(spark, files.guess(F.col("p")), p=path)) == want


def test_guess_keeps_what_is_given(spark):
    got = one(spark, files.guess(F.col("p"), subject=F.lit("me"), session=F.lit("t5")), p="sub-01_ses-T2.nii")
    assert tuple(got) == ("me", "V5", "")


@pytest.mark.parametrize(("argument", "want"), [(None, (3, 5)), ("7", (7, 9)), ("Ins, Glu", (None, 2)), (["GABA"], (None, 1)), (3.0, (3, 5))])
def test_field_strength(argument, want):
    strength, listed = files.field_strength(argument)
    assert (strength, len(listed)) == want


def test_field_strength_of_another_number():
    with pytest.raises(ValueError):
        files.field_strength("1.5")


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("OrigRes_NAA+NAAG_conc.nii.gz", ("NAANAAG", "signal", None)),
        ("OrigRes_Voxel_snr.nii.gz", (None, "snr", None)),
        ("fwhm.nii.gz", (None, "fwhm", None)),
        ("brain_mask.nii.gz", (None, "brainmask", None)),
        ("WaterSignal.nii.gz", ("water", "signal", None)),
        ("Ins_metabnorm.nii.gz", (None, None, "metabnorm")),
        ("Ins_other.nii.gz", (None, None, "quantity")),
    ],
)
def test_map_names(spark, name, want):
    assert tuple(one(spark, files.map_name(F.col("n")), n=name)) == want


def test_tags_of_a_path(spark):
    df = spark.createDataFrame([("x/sub-no/sub-A1.b_ses-T1_atlas-chimeraLFM_desc-scale3grow2mm_npert_50_res-5mm.nii.gz",), (None,)], "n string")
    got = catalog.with_tags(df, "n").collect()
    assert got[0]["subject"] == "A1.b" and got[0]["atlas"] == "LFM" and (got[0]["scale"], got[0]["grow"], got[0]["npert"]) == (3, 2, 50)
    assert all(v is None for k, v in got[1].asDict().items())


def test_strict_suffix_keeps_signs():
    assert catalog.selection_suffix(["AGE,>=5", "age,!=7"], ["AGE"], strict=True) == "AGE->=5_AGE-!=7"


def test_rows_without_session_stay(spark):
    df = spark.createDataFrame([("a", None), ("b", "V2BIS"), ("c", "V1")], "subject string, session string")
    assert sorted(r["subject"] for r in tables.without_sessions(df).collect()) == ["a", "c"]


def test_folders_and_destinations(spark):
    assert one(spark, files.in_derivative(F.col("p"), F.lit("/r"), F.lit("mine")), p="/r/derivatives/mrsi-x/a/b.nii") == "/r/derivatives/mine/a/b.nii"
    assert [one(spark, files.valid_folder(F.col("p")), p=p) for p in ("/a/", "..", "a/../b", " x ", "")] == ["a", None, None, "x", None]


def test_two_nodes_at_once(spark):
    """On the ring 1-2-3-4-5 with 6 beside 2 and 3's neighbours and 7 beside 6 and 4: what brute force over all replacements gives."""
    links = [(1, 2), (2, 3), (3, 4), (4, 5), (1, 6), (6, 3), (2, 7), (7, 4), (6, 7)]
    both = {(a, b) for a, b in links} | {(b, a) for a, b in links}
    path = [1, 2, 3, 4]
    near = lambda n: {b for a, b in both if a == n}
    options = [[path[0]], *([path[k], *(near(path[k - 1]) & near(path[k + 1])) - {path[k]}] for k in (1, 2)), [path[3]]]
    want = {p for p in itertools.product(*options) if list(p) != path and len(set(p)) == 4 and all((a, b) in both for a, b in itertools.pairwise(p))}
    steps = spark.createDataFrame([("p", k, n) for k, n in enumerate(path)], "path_id string, pos int, node int")
    edges = spark.createDataFrame(sorted(both), "src int, dst int")
    got = {tuple(r["nodes"]) for r in paths.perturbed_anywhere(steps, edges, 4).collect()}
    assert got == want and any(a != 2 and b != 3 for _, a, b, _ in want)


def test_interpolated_path(spark):
    links = [(1, 2), (2, 3), (1, 4), (4, 3), (3, 5), (8, 9)]
    edges = spark.createDataFrame(links + [(b, a) for a, b in links], "src int, dst int").withColumn("w", F.lit(1.0))
    values = spark.createDataFrame([(1, 0.0, 1.0), (2, 9.0, 1.0), (3, 2.0, 1.0), (4, 1.0, 1.0), (5, 3.0, 1.0), (8, 1.0, 1.0), (9, None, 1.0)], "node int, v double, strength double")
    got = [r["node"] for r in paths.interpolated(edges, [1, 3, 5, 8], values, 3, 10.0).orderBy("pos").collect()]
    assert got == [1, 4, 3, 5, 8]


def test_costs_of_a_path(spark):
    v = [1.0, 3.0, 2.0, 6.0]
    steps = spark.createDataFrame([("p", k, k, x, 2.0) for k, x in enumerate(v)], "path_id string, pos int, node int, v double, s double")
    grad = np.gradient(np.array(v), np.linspace(0, 1, 4)) / 4
    assert paths.node_cost(steps, "v", "s", 8.0).first()["cost"] == pytest.approx(np.abs(grad).mean() - 0.5 * 2.0 / 8.0)
    bins = round(2 * 50 ** (1 / 3))
    p = np.histogram(v, bins=bins)[0] / 4
    entropy = -(p[p > 0] * np.log(p[p > 0])).sum() / math.log(bins)
    alternating = np.gradient(np.where(np.arange(4) % 2 == 0, 1.0, 6.0)) / 4
    nabla = ((np.gradient(np.array(v)) / 4) ** 2).sum() / (alternating**2).sum()
    got = paths.total_cost(steps, "v", 50).first()
    assert (got["nabla"], got["entropy"], got["total"]) == pytest.approx((nabla, entropy, nabla / entropy))


def test_freedman_lane_equals_least_squares(spark):
    r = np.random.RandomState(3)
    n = 12
    x, z = r.randn(n), r.randn(n)
    y = 0.7 * x + 2 * z + r.randn(n) + 1
    design = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, z, strict=True))], "item int, x double, z double")
    stack = spark.createDataFrame([(k, 0, 1, float(v)) for k, v in enumerate(y)], "item int, i int, j int, w double")
    got = {t["perm"]: t["t"] for t in inference.freedman_lane(stack, design, "item", "x", "z", "w", ["i", "j"], 5).collect()}
    full = np.column_stack([np.ones(n), x, z])
    beta, *_ = np.linalg.lstsq(full, y, rcond=None)
    s2 = ((y - full @ beta) ** 2).sum() / (n - 3)
    assert got[0] == pytest.approx(beta[1] / math.sqrt(s2 * np.linalg.inv(full.T @ full)[1, 1])) and len(got) == 6


def test_exponential_fit(spark):
    s = np.linspace(-1, 1, 50)
    cells = spark.createDataFrame([(float(a), float(math.exp(1.3 * a))) for a in s], "s double, m double")
    g, r = layout.exponential_fit(cells, "m", "s")
    assert g == pytest.approx(1.3, abs=1e-6) and r == pytest.approx(1.0)


def test_mirrored_shape_is_found(spark):
    a = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate([(0.0, 0.0), (2.0, 0.0), (0.0, 1.0), (3.0, 3.0)])], "node int, x double, y double")
    b = a.select("node", (-F.col("x")).alias("x"), "y")
    got = layout.turned_to(a, b, "node").orderBy("node").collect()
    c = np.array([[-r["x"], r["y"]] for r in a.collect()])
    c = (c - c.mean(0)) / np.linalg.norm(c - c.mean(0))
    assert np.allclose([[r["x"], r["y"]] for r in got], c)


def test_a_column_is_worked_out_once(spark):
    # Each of these named what it was made of many times over, so a plan held some thousand patterns and a row took a millisecond.
    rows = spark.createDataFrame([("raw/Results_A_T1/x.nii",)], "path string")
    for column in (files.guess(F.col("path")), files.cat12(F.col("path")), files.map_name(F.col("path"))):
        plan = rows.select(column.alias("c"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.lower().count("regexp_") + plan.count("RLIKE") < 60, plan.lower().count("regexp_")


def test_numbers_without_one_task(spark):
    from parcelyard.functions.numbering import numbered

    rows = spark.range(1000).selectExpr("id", "(id * 7919) % 1000 as k", "id % 3 as g")
    got = {(r["g"], r["k"]): r["n"] for r in numbered(rows, ["g", "k"]).collect()}
    assert got == {key: n for n, key in enumerate(sorted(got), 1)}
    assert numbered(rows.where("false"), ["g"]).count() == 0
