import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelyard.sources import tables, volumes


def test_nifti_round_trip(spark, tmp_path):
    values = np.random.RandomState(0).rand(4, 3, 2).astype("f4").astype(float)
    affine = np.array([[-2, 0, 0, 90], [0, 2, 0, -126], [0, 0, 2, -72], [0, 0, 0, 1.0]])
    (tmp_path / "a.nii.gz").write_bytes(volumes.encode_nifti(values, affine))
    (tmp_path / "b.nii").write_bytes(volumes.encode_nifti(values * 2, affine, compress=False))
    rows = volumes.read_nifti(spark, str(tmp_path)).toPandas()
    assert len(rows) == 2 * values.size
    a = rows[rows["path"].str.endswith("a.nii.gz")]
    got = np.zeros(values.shape)
    got[a["x"], a["y"], a["z"]] = a["value"]
    assert np.allclose(got, values)
    head = volumes.volume_headers(spark, str(tmp_path)).first()
    assert list(head["shape"]) == [4, 3, 2] and np.allclose(head["affine"], affine)
    made = volumes.nifti_files(volumes.read_nifti(spark, str(tmp_path), "b.nii").withColumn("r", F.lit("s1")), "r", (4, 3, 2), affine.tolist()).first()
    assert np.allclose(volumes.decode_nifti(bytes(made["file"]))[0], values * 2)


def test_not_a_volume():
    with pytest.raises(Exception):
        volumes.decode_nifti(b"\0" * 400)


def test_arrays(spark, tmp_path):
    np.savez(tmp_path / "m.npz", a=np.arange(6).reshape(2, 3), b=np.array([1.5]))
    rows = volumes.read_arrays(spark, str(tmp_path)).collect()
    assert {(r["member"], tuple(r["index"]), r["value"]) for r in rows} == {("a", (i, j), float(3 * i + j)) for i in range(2) for j in range(3)} | {("b", (0,), 1.5)}


def test_atlas(spark, tmp_path):
    f = tmp_path / "atlas.tsv"
    f.write_text("index\tname\tcolor\n1\tctx-lh-a_1\t#010203\n3001\twm-lh-b \t#040506\n7\tcer-rh-c\t#000000\n")
    atlas = tables.read_atlas(spark, str(f), ignore=["cer"])
    assert [r["idx"] for r in atlas.orderBy("idx").collect()] == [1, 3001]
    header = {r["parcel_id"]: r["label"] for r in tables.parcel_header(atlas).collect()}
    assert header == {0: ["BND"], 1: ["ctx", "lh", "a_1"]}
    f.write_text("index\tname\tcolor\n1\ta\t#1\n2\tb\n")
    assert tables.read_atlas(spark, str(f), strict=False).count() == 1
    with pytest.raises(Exception):
        tables.read_atlas(spark, str(f)).collect()


def test_participants(spark, tmp_path):
    f = tmp_path / "p.tsv"
    f.write_text("Participant ID\tses\r\nS2\tV1\r\n\r\n S1 \tV1\r\nS2\tV1\r\nS3\tV2BIS\r\n")
    rows = tables.read_participants(spark, str(f)).orderBy("ord").collect()
    assert [(r["subject"], r["session"]) for r in rows] == [("S2", "V1"), ("S1", "V1")]


def test_xml_colours_and_listing(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<atlas><data><label index="1">one</label><label index="2">two</label></data></atlas>')
    assert {(r["idx"], r["name"]) for r in tables.read_atlas_xml(spark, str(tmp_path / "a.xml"), "x-").collect()} == {(1, "x-one"), (2, "x-two")}
    (tmp_path / "c.txt").write_text("0.1 0.2 0.3\n" + "1 1 1\n" * 255)
    colours = tables.read_colour_map(spark, str(tmp_path / "c.txt")).orderBy("n").collect()
    assert len(colours) == 256 and (colours[0]["r"], colours[1]["r"]) == (0.1, 1.0)
    (tmp_path / "short.txt").write_text("1 1 1\n")
    with pytest.raises(ValueError):
        tables.read_colour_map(spark, str(tmp_path / "short.txt"))
    d = tmp_path / "sub-1" / "ses-V1"
    d.mkdir(parents=True)
    (d / "x.nii").write_bytes(b"1")
    assert [tuple(r) for r in tables.discover_recordings(spark, str(tmp_path)).collect()] == [("1", "V1", 1)]


def test_bundle_and_matrix_text(spark, tmp_path):
    m = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.5), (2, 1, 0.5), (2, 2, 1.0)], "i int, j int, w double")
    tables.write_bundle({"m": m}, str(tmp_path / "b"))
    assert tables.read_bundle(spark, str(tmp_path / "b"), ["m"])["m"].count() == 4
    tables.write_matrix_text(m, str(tmp_path / "t"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "t")).collect()] == ["1.000000 0.500000", "0.500000 1.000000"]


def test_recordings_with_a_modality(spark, tmp_path):
    for sub, kind in (("2", "anat"), ("1", "anat"), ("1", "mrsi")):
        d = tmp_path / f"sub-{sub}" / "ses-V1" / kind
        d.mkdir(parents=True)
        (d / "x.nii").write_bytes(b"1")
    assert [tuple(r) for r in tables.recordings_with(spark, str(tmp_path), "anat").collect()] == [("1", "V1", 1), ("2", "V1", 1)]
    assert [tuple(r) for r in tables.recordings_to_process(spark, str(tmp_path)).collect()] == [("1", "V1"), ("2", "V1")]


def test_statistic_inputs(spark, tmp_path):
    stack = spark.createDataFrame([(s, i, j, float(i + j)) for s in ("a", "b") for i in (0, 1) for j in (0, 1)], "subject string, i int, j int, w double")
    places = spark.createDataFrame([(0, 1.0, 2.0, 3.0, "one"), (1, 4.0, 5.0, 6.0, "two")], "node int, x double, y double, z double, name string")
    design = spark.createDataFrame([("a", 1.0), ("b", 0.0)], "subject string, group double")
    tables.write_statistic_inputs(stack, places, design, str(tmp_path / "out"))
    read = lambda name: [r[0] for r in spark.read.text(str(tmp_path / "out" / name)).collect()]
    assert read("matrices/a") == ["0.000000 1.000000", "1.000000 2.000000"] and read("coordinates")[0] == "1.000000 2.000000 3.000000" and read("labels") == ["one", "two"] and read("design") == ["1.000000", "0.000000"]


def test_json_and_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    tables.write_json(df, str(tmp_path / "j"))
    tables.write_csv(df, str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1 and spark.read.option("header", True).csv(str(tmp_path / "c")).first()["v"] == "a"
