"""Cutting a plan's lineage in iterative operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where it is unset (tests, one machine)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith(("local[", "local*")):
            raise RuntimeError("spark.checkpoint.dir is unset: on a cluster it must name a folder that all hosts share")
        if not _local_dirs:
            _local_dirs.append(tempfile.mkdtemp(prefix="parcelyard-"))
            atexit.register(shutil.rmtree, _local_dirs[0], ignore_errors=True)
        path = "file://" + _local_dirs[0]
    return path


#: Rows of a graph's links that one task holds.
ROWS_A_TASK = 500_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` by hash of ``keys`` over tasks that grow in number with ``rows``, not in size; at least as many as a shuffle has."""
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(usual, -(-rows // ROWS_A_TASK)), *keys)


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder that the session names. Rows are kept meanwhile, else they would be made once to count and again to write."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    kept = df.persist()
    try:
        return kept.checkpoint()
    finally:
        kept.unpersist()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: made once, smaller than a checkpoint, and read by column. How its rows were dealt is forgotten."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
