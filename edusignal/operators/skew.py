"""Joins and reuse that stay even when one key holds a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder (``spark.checkpoint.dir``)
    and go on from the written rows: later jobs don't repeat the work, and a lost
    executor costs a re-read only."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def shards(spark: SparkSession) -> int:
    """Into how many parts a hot key is split: four a shuffle partition, 64 at least."""
    return max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def shard_of(spark: SparkSession, *cols: Column) -> Column:
    """Part of a row, from its own columns (the same on every attempt of a task)."""
    return F.pmod(F.xxhash64(*cols), F.lit(shards(spark))).cast("int")


def attach(rows: DataFrame, found: DataFrame, key: str, shard: str = "__shard") -> DataFrame:
    """Left join of ``rows`` with ``found`` (one row a key) that stays even when one
    key holds a third of ``rows``: the distinct (shard, key) pairs meet ``found``
    first, at most one row a shard and key, and the rows then meet their own pair."""
    pairs = rows.select(shard, key).distinct().join(found, key)
    return rows.join(pairs, [shard, key], "left")
