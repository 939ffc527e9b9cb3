"""Batch job: similarity networks of regions, one a recording, with their links and node strengths.

Observations are events: a recording is a stretch of time (``day``, ``week`` or ``month``), a region a user's group, a channel the event's
type, a draw the event's number modulo ``draws``. A recording's profile is the mean of every (region, channel, draw); two regions are as
similar as the ranks of what both have correlate. Links are kept where |r| reaches ``least`` and enough values stand behind them.

    python -m jobs.similarity_network --input IN --output OUT [--config jobs/similarity_network.json]

Output, Parquet by recording: ``OUT/links`` (recording, i, j, r, n, kept; i < j) and ``OUT/nodes`` (recording, node, degree, strength).
All recordings are made in one plan. Only recordings from ``since`` on are read and renewed, by dynamic partition overwrite; a rerun gives
the same files' rows.

Defined results: rows without time, user or type are left out, null and NaN values too; a constant profile has r null and no link; a
recording with one region has no links; an empty input gives no rows; other columns don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelyard.operators import graph, matrices, parcels, similarity

from .common import log, main

LINKS = "i bigint, j bigint, r double, n bigint, kept boolean, recording date"
NODES = "node bigint, degree bigint, strength double, recording date"


@dataclass(frozen=True)
class Settings:
    input: str
    output: str
    stretch: str = "week"
    regions: int = 12
    draws: int = 10
    least: float = 0.3
    values: int = 8
    since: str | None = None


def observations(events: DataFrame, wanted: Settings) -> DataFrame:
    """(recording, region, channel, draw, value)."""
    if wanted.stretch not in ("day", "week", "month"):
        raise ValueError(f"stretch is day, week or month, not {wanted.stretch}")
    rows = events.where("ts is not null and user_id is not null and event_type is not null")
    if wanted.since is not None:
        rows = rows.where(F.col("ts") >= F.date_trunc(wanted.stretch, F.to_timestamp(F.lit(wanted.since))))
    keyed = rows.select(F.to_date(F.date_trunc(wanted.stretch, "ts")).alias("recording"), F.pmod("user_id", F.lit(wanted.regions)).alias("region"), F.col("event_type").alias("channel"), F.pmod("event_id", F.lit(wanted.draws)).alias("draw"), "value")
    return keyed.where("value is not null and not isnan(value)")


def links(profile: DataFrame, wanted: Settings) -> DataFrame:
    """(recording, i, j, r, n, kept) of the regions' profiles (recording, region, channel, draw, mean)."""
    sim = similarity.spearman(profile, "region", ["channel", "draw"], "mean", by=["recording"]).where("i < j").withColumn("r", F.round("r", 6))
    marked = matrices.binarised(sim, "posneg", wanted.least, value="r", out="_b")
    return marked.select("i", "j", "r", F.col("n"), (F.coalesce(F.col("_b") != 0, F.lit(False)) & (F.col("n") >= wanted.values)).alias("kept"), "recording")


def nodes(made: DataFrame) -> DataFrame:
    """(node, degree, strength, recording) of the kept links."""
    kept = matrices.mirrored(made.where("kept").select("recording", "i", "j", "r"))
    ends = kept.select("recording", F.col("i").alias("src"), F.col("j").alias("dst"), "r")
    strength = ends.groupBy("recording", F.col("src").alias("node")).agg(F.round(F.sum("r"), 6).alias("strength"))
    return graph.degree(ends, ["recording"]).join(strength, ["recording", "node"]).select("node", "degree", "strength", "recording")


def output(spark: SparkSession, wanted: Settings, name: str = "links") -> DataFrame:
    return spark.read.schema({"links": LINKS, "nodes": NODES}[name]).parquet(f"{wanted.output}/{name}")


def run(spark: SparkSession, wanted: Settings) -> DataFrame:
    """Make the recordings' networks; gives all links as they stand."""
    events = spark.read.parquet(wanted.input)
    profile = parcels.parcel_mean(observations(events, wanted), ["recording", "region", "channel", "draw"], "value")

    def put(rows: DataFrame, name: str) -> None:
        rows.repartition("recording").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("recording").parquet(f"{wanted.output}/{name}")

    put(links(profile, wanted), "links")
    whole = output(spark, wanted)
    own = whole if wanted.since is None else whole.where(F.col("recording") >= F.to_date(F.date_trunc(wanted.stretch, F.to_timestamp(F.lit(wanted.since)))))
    put(nodes(own), "nodes")
    kept = own.agg(F.count("*"), F.coalesce(F.count_if("kept"), F.lit(0)), F.countDistinct("recording")).first()
    log.info("read %d events from %s; wrote %d links (%d kept) of %d recordings and %d nodes to %s", events.count(), wanted.input, *kept, output(spark, wanted, "nodes").count(), wanted.output)
    return whole


if __name__ == "__main__":
    main(Settings, run, __doc__.splitlines()[0], ["input", "output"])
