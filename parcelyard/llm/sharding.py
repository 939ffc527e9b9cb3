"""Shards by jump consistent hashing.

``shard`` is the last jump of Lamping and Veach's sequence for the key that stays under the number of shards; growing from n to n + 1
shards moves only rows whose sequence jumps to n, about 1 in n + 1. There is no ring or table: key and count decide.

Slots number a shard's rows from 0 without gaps. No shard is sorted as a whole: its rows are dealt in chunks by a hash, the chunks are
counted in a first pass over the keys, and a chunk's rows are numbered from the chunk's offset.

Defined results: a null key counts as one more key; a null text has size 16 and the CRC of an empty one; equal rows share a shard and
take different slots; other columns stay, and added names get underscores in front if they clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of unsigned 64-bit keys, all at once."""
    state, at, to = keys.astype(np.uint64), np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
    live = np.arange(len(keys))
    while len(live):
        at[live] = to[live]
        state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        to[live] = ((at[live] + 1) * (2.0**31 / ((state[live] >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
        live = live[to[live] < shards]
    return at


def jump_shard(key: Column, shards: int) -> Column:
    """Shard of a key column of any type."""

    @F.pandas_udf("int")
    def of(hashed: pd.Series) -> pd.Series:
        return pd.Series(jump(hashed.to_numpy(np.int64).view(np.uint64), shards))

    return of(F.xxhash64(key))


def sharded(documents: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text", rows_a_chunk: int = 20_000) -> DataFrame:
    """``documents`` without its text, and size, text_crc32, shard, slot, grown_shard (with one shard more)."""
    chunks = max(1, -(-documents.count() // (shards * rows_a_chunk)))
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")
    crc = F.coalesce(F.crc32(F.col(text)), F.lit(0).cast("long"))
    name = {n: free_name(documents, n) for n in ("size", "text_crc32", "shard", "slot", "grown_shard", "chunk", "before")}
    chunk = F.pmod(F.xxhash64(F.lit("chunk"), key, crc), F.lit(chunks)).cast("int") if chunks > 1 else F.lit(0)
    rows = (
        documents.withColumn(name["size"], size)
        .withColumn(name["text_crc32"], crc)
        .withColumn(name["chunk"], chunk)
        .drop(text)
        .withColumn(name["shard"], jump_shard(F.col(key), shards))
        .withColumn(name["grown_shard"], jump_shard(F.col(key), shards + 1))
    )
    place = [name["shard"], name["chunk"]]
    # At most shards * chunks rows, of a few bytes each for 20,000 rows of input.
    counts = rows.groupBy(*place).count()
    before = counts.select(*place, (F.sum("count").over(Window.partitionBy(place[0]).orderBy(place[1])) - F.col("count")).alias(name["before"]))
    number = F.row_number().over(Window.partitionBy(*place).orderBy(key, name["text_crc32"], name["size"])) - 1
    numbered = rows.withColumn(name["slot"], number).join(before, place)
    return numbered.withColumn(name["slot"], (F.col(name["slot"]) + F.col(name["before"])).cast("long")).drop(name["before"], name["chunk"])


def write_shards(documents: DataFrame, path: str, shards: int = 40, key: str = "doc_id") -> None:
    """Write ``documents`` as one folder a shard."""
    name = free_name(documents, "shard")
    documents.withColumn(name, jump_shard(F.col(key), shards)).repartition(name, F.pmod(F.xxhash64(key), F.lit(8))).write.partitionBy(name).parquet(path)
