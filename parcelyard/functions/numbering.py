"""Numbers of rows in a total order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import ROWS_A_TASK, cut

_ROWS = 33  # Spark's increasing ids: the partition above these bits, the row in it below


def summed_before(counts: DataFrame, by: list[str], order: str, count: str, out: str, rows: int) -> DataFrame:
    """``counts`` with the sum of ``count`` over lesser ``order`` within ``by``; ranges are summed apart, so a large group is shared by tasks."""
    ranges = max(1, -(-rows // ROWS_A_TASK))
    at = cut(counts.repartitionByRange(ranges, *by, order)).withColumn("_part", F.spark_partition_id())
    sums = at.groupBy(*by, "_part").agg(F.sum(count).alias("_sum"))
    before = sums.select(*by, "_part", (F.sum("_sum").over(Window.partitionBy(*by).orderBy("_part")) - F.col("_sum")).alias("_before"))  # one row a range
    own = F.sum(count).over(Window.partitionBy(*by, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(count)
    placed = at.withColumn("_own", own).alias("a").join(F.broadcast(before).alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*by, "_part"]])
    return placed.select(*(F.col(f"a.{c}").alias(c) for c in counts.columns), (F.col("_own") + F.col("_before")).alias(out))


def numbered(rows: DataFrame, order: list[str | Column], out: str = "n") -> DataFrame:
    """``rows`` with their place from 1 in ``order``: ranges are sorted apart, then each adds the counts of those before it."""
    at = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", _ROWS)
    counts = at.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = counts.select("_part", (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_before"))  # one row a partition
    placed = at.withColumn("_part", part).join(F.broadcast(before), "_part")
    return placed.withColumn(out, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << _ROWS) - 1)) + 1).drop("_part", "_at", "_before")
