"""The jobs over growing input, reruns, odd rows, and against DuckDB."""

import json
import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import document_profiles, queries, similarity_network
from jobs.common import settings

ROOT = Path(__file__).resolve().parent.parent
DOCUMENT = "doc_id bigint, text string, lang string, source string, batch string"


def rows(df):
    return sorted((tuple(sorted(r.asDict().items())) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_same_rows_as_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "events"):
        c.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    df = queries.QUERIES[name](spark, sf_dir)
    rel = c.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    theirs = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
    ours = [r.asDict() for r in df.collect()]
    key = lambda r: str([r[k] for k in sorted(r) if not isinstance(r[k], float)])
    assert len(ours) == len(theirs) > 0
    for a, b in zip(sorted(ours, key=key), sorted(theirs, key=key), strict=True):
        assert all(a[k] == b[k] or isinstance(a[k], float) and math.isclose(a[k], b[k], abs_tol=1e-5) for k in a), (a, b)


def test_settings_are_those_of_the_files_and_no_others(tmp_path):
    got = settings(similarity_network.Settings, str(ROOT / "jobs/similarity_network.json"), input="a", output="b")
    assert got.stretch == "week" and got.input == "a"
    (tmp_path / "odd.json").write_text(json.dumps({"strech": "day"}))
    with pytest.raises(ValueError, match="strech"):
        settings(similarity_network.Settings, str(tmp_path / "odd.json"), input="a", output="b")


def test_profiles_take_only_new_files(spark, sf_dir, tmp_path):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id")
    first, second = documents.where("doc_id % 3 < 2"), documents.where("doc_id % 3 = 2")
    incoming = f"file://{tmp_path}/in"
    first.repartition(3).write.parquet(incoming)
    wanted = document_profiles.Settings(incoming, f"file://{tmp_path}/out", f"file://{tmp_path}/state", files_a_batch=2)
    one = rows(document_profiles.run(spark, wanted))
    batches = lambda: {r["batch"]: r["docs"] for r in spark.read.parquet(f"{wanted.output}/partials").where("measure = 'chars'").groupBy("batch").agg(F.sum("docs").alias("docs")).collect()}
    before = batches()
    assert len(before) == 2 and sum(before.values()) == first.count()
    assert rows(document_profiles.run(spark, wanted)) == one and batches() == before  # nothing new
    second.write.mode("append").parquet(incoming)
    two = rows(document_profiles.run(spark, wanted))
    after = batches()
    assert {k: after[k] for k in before} == before and sum(after.values()) - sum(before.values()) == second.count()
    whole = document_profiles.Settings(incoming, f"file://{tmp_path}/again", f"file://{tmp_path}/other")
    assert rows(document_profiles.run(spark, whole)) == two != one


def test_profiles_by_hand(spark, tmp_path):
    data = [(1, "Ab 12, é\nx", "en", "s", "b"), (2, None, "en", "s", "b"), (3, "", "", None, "b"), (3, "", "", None, "b"), (None, "Z" * 70000, None, "", "b")]
    spark.createDataFrame(data, DOCUMENT).write.parquet(f"{tmp_path}/in")
    got = {(r["lang"], r["source"], r["measure"]): r for r in document_profiles.run(spark, document_profiles.Settings(f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp")).collect()}
    assert len(got) == 14
    en = {m: (got["en", "s", m]["docs"], got["en", "s", m]["most"]) for m in ("chars", "bytes", "words", "capitals", "figures", "marks", "lines")}
    assert en == {"chars": (2, 10), "bytes": (2, 11), "words": (2, 4), "capitals": (2, 1), "figures": (2, 2), "marks": (2, 1), "lines": (2, 2)}
    assert got["en", "s", "chars"]["mean"] == 5 and got["en", "s", "chars"]["sd"] == pytest.approx(math.sqrt(50), abs=1e-4)
    other = got[None, None, "capitals"]
    assert (other["docs"], other["most"], other["least"]) == (3, 70000, 0)


def test_profiles_of_nothing(spark, tmp_path):
    spark.createDataFrame([], DOCUMENT).write.parquet(f"{tmp_path}/in")
    wanted = document_profiles.Settings(f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp")
    assert document_profiles.run(spark, wanted).count() == 0 and document_profiles.run(spark, wanted).count() == 0


def test_networks_rerun_and_renew(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    middle = events.agg(F.to_date(F.percentile_approx(F.unix_timestamp(F.col("ts").cast("timestamp")), 0.5).cast("timestamp")).cast("string")).first()[0]
    events.where(F.col("ts") < middle).write.parquet(f"{tmp_path}/in")
    wanted = similarity_network.Settings(f"{tmp_path}/in", f"{tmp_path}/out", stretch="day", values=3)
    one = rows(similarity_network.run(spark, wanted))
    assert rows(similarity_network.run(spark, wanted)) == one
    events.where(F.col("ts") >= middle).write.mode("append").parquet(f"{tmp_path}/in")
    later = similarity_network.Settings(f"{tmp_path}/in", f"{tmp_path}/out", stretch="day", values=3, since=middle)
    two = rows(similarity_network.run(spark, later))
    assert set(map(str, one)) < set(map(str, two))
    fresh = similarity_network.Settings(f"{tmp_path}/in", f"{tmp_path}/all", stretch="day", values=3)
    assert rows(similarity_network.run(spark, fresh)) == two
    assert rows(similarity_network.output(spark, fresh, "nodes")) == rows(similarity_network.output(spark, later, "nodes"))


def test_network_by_hand(spark, tmp_path):
    # Regions 0 and 1 rise together, 2 falls, 3 is constant.
    data = [(k, f"2024-01-0{1 + k % 2}", u, "c", float({0: k, 1: 2 * k + 1, 2: -k, 3: 5}[u])) for k in range(10) for u in range(4)]
    odd = [(3, None, 1, "c", 9.0), (3, "2024-01-01", None, "c", 9.0), (3, "2024-01-01", 1, None, 9.0), (3, "2024-01-02", 1, "c", None), (3, "2024-01-02", 1, "c", float("nan"))]
    spark.createDataFrame(data + odd, "event_id bigint, day string, user_id bigint, event_type string, value double").withColumn("ts", F.to_timestamp("day")).write.parquet(f"{tmp_path}/in")
    wanted = similarity_network.Settings(f"{tmp_path}/in", f"{tmp_path}/out", stretch="month", regions=4, draws=10, least=0.9)
    got = {(r["i"], r["j"]): (r["r"], r["n"], r["kept"]) for r in similarity_network.run(spark, wanted).collect()}
    assert got == {(0, 1): (1, 10, True), (0, 2): (-1, 10, True), (1, 2): (-1, 10, True), **{(k, 3): (None, 10, False) for k in range(3)}}
    assert {r["node"]: (r["degree"], r["strength"]) for r in similarity_network.output(spark, wanted, "nodes").collect()} == {0: (2, 0), 1: (2, 0), 2: (2, -2)}
    with pytest.raises(ValueError, match="stretch"):
        similarity_network.run(spark, similarity_network.Settings(f"{tmp_path}/in", f"{tmp_path}/x", stretch="hour"))


def test_networks_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "event_id bigint, ts timestamp, user_id bigint, event_type string, value double").write.parquet(f"{tmp_path}/in")
    assert similarity_network.run(spark, similarity_network.Settings(f"{tmp_path}/in", f"{tmp_path}/out")).count() == 0


@pytest.mark.parametrize("name", ["document_profiles", "similarity_network"])
def test_command_line(name):
    got = subprocess.run([sys.executable, "-m", f"jobs.{name}", "--help"], cwd=ROOT, capture_output=True, text=True, timeout=60)
    assert got.returncode == 0 and "--input" in got.stdout and "--config" in got.stdout
