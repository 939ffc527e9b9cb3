"""Incremental job: measurement profiles of text recordings, kept up to date as files arrive.

Every document is measured (characters, bytes, words, capitals, figures, marks, lines); a profile is the number, mean, deviation and range
of each measure for each language and source. A file stream with a checkpoint takes the files that have come since the last run, in batches
of at most ``files_a_batch``. A batch leaves its sums in a partition of its own, ``partials/batch=<id>``, which a repeated batch overwrites;
profiles are then made from the sums of all batches, so old documents aren't read again.

    python -m jobs.document_profiles --input IN --output OUT --checkpoint CP [--config jobs/document_profiles.json]

Output: ``OUT/profiles``, Parquet by language: lang, source, measure, docs, mean, sd, least, most. A run without new files writes the same.

Defined results: a null text is measured as an empty one; a null or empty language or source is one group, null; sd of one document is
null; sums of squares are decimals, so long texts don't overflow; an empty input gives no rows; other columns don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import log, main

PARTIALS = "lang string, source string, measure string, docs bigint, total decimal(38,0), squares decimal(38,0), least bigint, most bigint, batch bigint"
PROFILES = "source string, measure string, docs bigint, mean double, sd double, least bigint, most bigint, lang string"
#: Matches of a pattern in a text, by measure.
PATTERNS = {"words": r"[^\x20\x09-\x0D]+", "capitals": "[A-Z]", "figures": "[0-9]", "marks": r"[!-/:-@\[-`{-~]", "lines": "[^\n]+"}


@dataclass(frozen=True)
class Settings:
    input: str
    output: str
    checkpoint: str
    files_a_batch: int = 1000
    measures: list[str] = field(default_factory=lambda: ["chars", "bytes", *PATTERNS])


def measured(measure: str) -> Column:
    text = F.coalesce("text", F.lit(""))
    plain = {"chars": F.length(text), "bytes": F.octet_length(text)}
    return (plain[measure] if measure in plain else F.regexp_count(text, F.lit(PATTERNS[measure]))).cast("long")


def partial_sums(documents: DataFrame, measures: list[str]) -> DataFrame:
    """(lang, source, measure, docs, total, squares, least, most): one shuffled row a task and group, however many documents a source has."""
    group = [F.when(F.col(c) != "", F.col(c)).alias(c) for c in ("lang", "source")]
    rows = documents.select(*group, *(measured(m).alias(f"m_{m}") for m in measures))
    aggregates = [F.count("*").alias("docs")]
    for m in measures:
        x = F.col(f"m_{m}")
        wide = x.cast("decimal(19,0)")
        aggregates.append(F.struct(F.lit(m).alias("measure"), F.sum(x.cast("decimal(28,0)")).alias("total"), F.sum((wide * wide).cast("decimal(28,0)")).alias("squares"), F.min(x).alias("least"), F.max(x).alias("most")).alias(m))
    sums = rows.groupBy("lang", "source").agg(*aggregates).select("lang", "source", "docs", F.explode(F.array(*measures)).alias("s"))
    return sums.select("lang", "source", "s.measure", "docs", F.col("s.total").cast("decimal(38,0)").alias("total"), F.col("s.squares").cast("decimal(38,0)").alias("squares"), "s.least", "s.most")


def profiles(partials: DataFrame) -> DataFrame:
    both = partials.groupBy("lang", "source", "measure").agg(F.sum("docs").alias("docs"), F.sum("total").cast("double").alias("total"), F.sum("squares").cast("double").alias("squares"), F.min("least").alias("least"), F.max("most").alias("most"))
    spread = F.when(F.col("docs") > 1, F.sqrt(F.greatest(F.col("squares") - F.col("total") * F.col("total") / F.col("docs"), F.lit(0.0)) / (F.col("docs") - 1)))
    return both.select("source", "measure", "docs", F.round(F.col("total") / F.col("docs"), 6).alias("mean"), F.round(spread, 4).alias("sd"), "least", "most", "lang")


def watched(path: str) -> str:
    """A pattern that only ``path`` matches: a file stream takes a single file by a pattern, not by its name, and a folder by either."""
    path = path.rstrip("/")
    return path if set(path) & set("*?[{") else f"{path[:-1]}[{path[-1]}]"


def output(spark: SparkSession, wanted: Settings) -> DataFrame:
    return spark.read.schema(PROFILES).parquet(f"{wanted.output}/profiles")


def run(spark: SparkSession, wanted: Settings) -> DataFrame:
    """Take what is new, renew the profiles and give them as they stand."""
    at = f"{wanted.output}/partials"
    # The folder is there even before any file has come.
    spark.createDataFrame([], PARTIALS).write.mode("append").partitionBy("batch").parquet(at)
    schema = spark.read.parquet(wanted.input).schema
    seen = {"batches": 0, "documents": 0}

    def batch(rows: DataFrame, number: int) -> None:
        sums = partial_sums(rows, wanted.measures).withColumn("batch", F.lit(number).cast("long"))
        sums.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(at)
        own = spark.read.schema(PARTIALS).parquet(at).where((F.col("batch") == number) & (F.col("measure") == wanted.measures[0]))
        docs = own.agg(F.sum("docs")).first()[0] or 0
        seen["batches"] += 1
        seen["documents"] += docs
        log.info("batch %d: read %d documents", number, docs)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", wanted.files_a_batch).parquet(watched(wanted.input))
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", wanted.checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    # One row a group, measure and batch is read; one a group and measure is written.
    made = profiles(spark.read.schema(PARTIALS).parquet(at))
    made.repartition("lang").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("lang").parquet(f"{wanted.output}/profiles")
    now = output(spark, wanted)
    log.info("read %d documents in %d batches from %s; wrote %d profile rows to %s", seen["documents"], seen["batches"], wanted.input, now.count(), wanted.output)
    return now


if __name__ == "__main__":
    main(Settings, run, __doc__.splitlines()[0], ["input", "output", "checkpoint"])
