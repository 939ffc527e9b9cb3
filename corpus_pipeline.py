"""The corpus pipeline: toxicity, near-duplicates, secrets, packing. Each stage takes (spark, docs, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelyard.llm import near_dedup, packing, secrets, toxicity
from parcelyard.llm.common import cut, drop_tables, table, written

THRESHOLD = 0.7


def clean_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.7 stay. The model is fitted on labelled documents of the table as it came."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, result="toxicity")
    name = next(c for c in scored.columns if c not in docs.columns)
    return scored.where(F.col(f"{name}.score") < THRESHOLD).select(*docs.columns)


def near_deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays."""
    return near_dedup.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; live-looking secrets are masked, copied examples are left, and n_chars follows the text."""
    clean = secrets.masked(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))) if "n_chars" in docs.columns else clean


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces in sequences of 4096 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", clean_toxicity), ("near_dedup", near_deduplicate), ("secrets", mask_secrets), ("packing", pack_sequences)]

#: Learned scores, components and tokenizers aren't expressible in SQL; tests/llm/test_pipeline.py holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table. What a stage wrote and read is deleted once the next has written its own."""
    docs, before = table(spark, sf_dir, "documents"), written()
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
        drop_tables(spark, since=before, keep=1)
    return docs
