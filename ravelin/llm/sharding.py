"""Operator 3: sharding by jump consistent hashing (Lamping and Veach, 2014)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARDS, GROWN = 64, 80


def stable_key(*columns: Column | str) -> Column:
    """64 bits of the MD5 of the columns as text, as a bigint: the same on any engine, in any order of rows.

    The parts are joined by U+001F; a null part is U+0000, which no other value is written as.
    """
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("\0")) for c in columns]
    digest = F.unhex(F.substring(F.md5(F.concat_ws("\x1f", *parts)), 1, 16))
    return F.conv(F.hex(digest), 16, -10).cast("bigint")


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned key; all keys that have not landed take their next jump together."""
    if shards < 1:
        raise ValueError("there must be a shard")
    at = np.zeros(len(keys), np.int64)
    moving = np.arange(len(keys))
    state = keys.astype(np.uint64)
    while len(moving):
        state = state * np.uint64(2862933555777941757) + np.uint64(1)
        leap = np.float64(1 << 31) / ((state >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        further = np.floor((at[moving] + 1) * leap)
        stays = further < shards
        moving, state = moving[stays], state[stays]
        at[moving] = further[stays].astype(np.int64)
    return at


def shard_of(key: Column | str, shards: int) -> Column:
    """int column: the shard of a bigint key, whose bits are taken as unsigned; null for null."""
    if shards < 1:
        raise ValueError("there must be a shard")

    @F.arrow_udf("int")
    def landing(column: pa.Array) -> pa.Array:
        keys = np.asarray(column.fill_null(0)).astype(np.int64).view(np.uint64)
        return pa.array(jump(keys, shards).astype(np.int32), mask=np.asarray(column.is_null()))

    return landing(key)


def assign_shards(docs: DataFrame, shards: int = SHARDS, grown: int = GROWN, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The shard of every row among ``shards``, and among ``grown`` once shards are appended.

    Returns the key columns, shard, grown_shard, moved. A row that moves only ever moves to an
    appended shard. A null key is a key like any other; equal keys share a shard; an empty table
    gives an empty one; columns that aren't keys aren't read. No shuffle and no table of shards.
    """
    keyed = docs.select(*keys, stable_key(*keys).alias("__rv_key"))
    placed = keyed.select(*keys, shard_of("__rv_key", shards).alias("shard"), shard_of("__rv_key", grown).alias("grown_shard"))
    return placed.withColumn("moved", F.col("shard") != F.col("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, keys: tuple[str, ...] = ("doc_id",)) -> None:
    """Write the rows as Parquet, one folder a shard (column ``__shard``); the one shuffle sends each shard to one task."""
    placed = docs.withColumn("__shard", shard_of(stable_key(*keys), shards))
    placed.repartition(shards, "__shard").write.partitionBy("__shard").parquet(path)


def moved_rows(docs: DataFrame, shards: int, grown: int, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Only the rows that must be copied when shards are appended, with their old and new shard."""
    key = stable_key(*keys)
    both = docs.withColumn("__shard_from", shard_of(key, shards)).withColumn("__shard_to", shard_of(key, grown))
    return both.filter("__shard_from != __shard_to")


SHARD_SQL = f"""
WITH RECURSIVE keyed AS (
  SELECT doc_id, row_number() OVER () AS row,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), chr(0))), 1, 16))::UBIGINT::HUGEINT AS k
  FROM documents),
walk AS (
  SELECT doc_id, row, (k * 2862933555777941757 + 1) % 18446744073709551616 AS state, CAST(0 AS BIGINT) AS b FROM keyed
  UNION ALL
  SELECT doc_id, row, (state * 2862933555777941757 + 1) % 18446744073709551616,
         CAST(floor((b + 1) * (2147483648.0::DOUBLE / ((state // 8589934592) + 1)::DOUBLE)) AS BIGINT)
  FROM walk WHERE b < {GROWN}),
landed AS (
  SELECT doc_id, row, max(b) FILTER (WHERE b < {SHARDS}) AS shard, max(b) FILTER (WHERE b < {GROWN}) AS grown_shard
  FROM walk GROUP BY doc_id, row)
SELECT doc_id, CAST(shard AS INTEGER) AS shard, CAST(grown_shard AS INTEGER) AS grown_shard, shard <> grown_shard AS moved FROM landed
"""
