"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local_dirs: list[str] = []
_written: list[tuple[object, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where it is unset (tests, one machine)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir is unset: on a cluster it must name a folder that all hosts share")
        if not _local_dirs:
            _local_dirs.append(tempfile.mkdtemp(prefix="parcelyard-"))
            atexit.register(shutil.rmtree, _local_dirs[0], ignore_errors=True)
        path = "file://" + _local_dirs[0]
    return path


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000, size: str = "8m") -> Iterator[None]:
    """What is run inside sends Arrow batches of at most ``rows`` rows and about ``size`` to Python, so that rows with texts stay few MB a worker."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: its lineage ends there, and losing an executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many tables ``cut`` has written that are still there."""
    return len(_written)


def drop_tables(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the tables that ``cut`` wrote after ``written()`` was ``since``, but for the latest ``keep``. Call it when no result that reads them is needed any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    until = max(since, len(_written) - keep)
    for _, path in _written[since:until]:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    del _written[since:until]


def drop_table(df_or_path) -> None:
    """Delete one table that ``cut`` wrote, when nothing will read it again."""
    path = df_or_path if isinstance(df_or_path, str) else df_or_path.inputFiles()[0].rsplit("/", 1)[0] if df_or_path.inputFiles() else None
    for k, (spark, p) in enumerate(_written):
        if path and p.split("/tables/")[-1] in path:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(p)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
            del _written[k]
            return


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it (letter case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def id_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(modulus))
