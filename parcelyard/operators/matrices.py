"""Matrices and stacks of matrices as keyed edge lists."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def aligned(stack: DataFrame, by: str, row: str = "i", col: str = "j", value: str = "w") -> DataFrame:
    """Every matrix of the stack on the largest label set (rows of the first, by name, with most of them), zeros filled in."""
    base = stack.groupBy(by).agg(F.countDistinct(row).alias("_n")).orderBy(F.desc("_n"), by).limit(1).select(F.col(by).alias("_base"))
    labels = stack.join(F.broadcast(base), F.col(by) == F.col("_base")).select(F.col(row).alias("_l")).distinct()
    grid = stack.select(by).distinct().crossJoin(labels.withColumnRenamed("_l", row)).crossJoin(labels.withColumnRenamed("_l", col))
    return grid.join(stack, [by, row, col], "left").select(by, row, col, F.coalesce(value, F.lit(0.0)).alias(value))


def without_empty_nodes(matrix: DataFrame, row: str = "i", col: str = "j", value: str = "w") -> DataFrame:
    """Without the nodes whose row sums to 0, or that have no row."""
    full = matrix.groupBy(row).agg(F.sum(F.abs(value)).alias("_s")).where("_s > 0").select(row)
    return matrix.join(full, row, "left_semi").join(full.withColumnRenamed(row, col), col, "left_semi")


def without_sparse(stack: DataFrame, by: str, value: str = "w", sigmas: float = 1.0) -> DataFrame:
    """Without the matrices that have fewer nonzero cells than the mean less ``sigmas`` deviations."""
    counts = stack.groupBy(by).agg(F.count_if(F.col(value) != 0).alias("_n"))
    low = counts.agg((F.avg("_n") - sigmas * F.stddev_pop("_n")).alias("_least"))
    kept = counts.crossJoin(F.broadcast(low)).where("_n >= _least").select(by)
    return stack.join(kept, by, "left_semi")


def without_labels(matrix: DataFrame, labels: DataFrame, label: str, row: str = "i", col: str = "j") -> DataFrame:
    """Without the rows and columns of ``labels``."""
    return matrix.join(labels.select(F.col(label).alias(row)), row, "left_anti").join(labels.select(F.col(label).alias(col)), col, "left_anti")


def binarised(matrix: DataFrame, mode: str, threshold: float, value: str = "w", out: str = "b", keep_weights: bool = False) -> DataFrame:
    v = F.col(value)
    hit = {"abs": F.abs(v) > threshold, "posneg": F.abs(v) >= threshold, "pos": v >= threshold, "neg": v <= -threshold}[mode]
    to: Column = v if keep_weights else F.signum(v) if mode == "posneg" else F.lit(1.0)
    return matrix.withColumn(out, F.when(hit, to).otherwise(0.0))


def density_threshold(matrix: DataFrame, density: float, nodes: int, value: str = "w") -> DataFrame:
    """One row: the value of rank ceil(density * nodes^2) from the top. Only that many rows are sorted to the end."""
    k = math.ceil(density * nodes * nodes)
    return matrix.orderBy(F.desc(value)).limit(k).agg(F.min(value).alias("threshold"))


def strongest(matrix: DataFrame, n: int, value: str = "w") -> DataFrame:
    """The n largest absolute values, ties of the last kept."""
    least = matrix.select(F.abs(value).alias("_a")).orderBy(F.desc("_a")).limit(n).agg(F.min("_a").alias("_least"))
    return matrix.crossJoin(F.broadcast(least)).where(F.abs(value) >= F.col("_least")).drop("_least")


def group_mean(stack: DataFrame, row: str = "i", col: str = "j", value: str = "w") -> DataFrame:
    return stack.groupBy(row, col).agg(F.avg(value).alias(value))


def mirrored(upper: DataFrame, row: str = "i", col: str = "j") -> DataFrame:
    """Both halves of a matrix of which rows <= columns are given."""
    return upper.unionByName(upper.where(F.col(row) != F.col(col)).withColumnsRenamed({row: "_t", col: row}).withColumnRenamed("_t", col))


def sign_channels(values: DataFrame, value: str) -> DataFrame:
    return values.withColumn("pos", F.greatest(F.col(value), F.lit(0.0))).withColumn("neg", F.greatest(-F.col(value), F.lit(0.0)))


def row_normalised(matrix: DataFrame, by: list[str], value: str) -> DataFrame:
    norm = F.sqrt(F.sum(F.col(value) * F.col(value)).over(Window.partitionBy(*by)))
    return matrix.withColumn(value, F.col(value) / F.when(norm == 0, 1.0).otherwise(norm))
