"""Helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship_package
from ..operators.skew import attach, settle, shard_of, shards  # noqa: F401  (for the operators here)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of every row; a null text counts as empty."""
    ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


_HELD: dict[str, object] = {}


def held(name: str, make):
    """What an operator keeps in a worker process between tasks (remembered words and the like).
    Only the latest operator's is kept: a worker never holds that of two stages."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


def kept_rows(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, hash of text) is in ``keep`` (columns
    ``__id``, ``__h``), with all their columns; of rows that repeat both, one."""
    rows = docs.withColumn("__h", F.xxhash64("text"))
    keep = keep.select("__id", F.col("__h").alias("__kh"))
    cond = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__kh"))
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    first = Window.partitionBy("doc_id", "__h").orderBy(F.xxhash64(*rest) if rest else F.lit(0))
    return (rows.join(keep, cond, "left_semi")
            .withColumn("__n", F.row_number().over(first)).where("__n = 1")
            .select(*[F.col(f"`{c}`") for c in docs.columns]))


def sampled(rows: DataFrame, limit: int, key: str = "doc_id") -> DataFrame:
    """About ``limit`` rows (all, if there are fewer), chosen by the hash of ``key``:
    the same rows on every run, and no more as the table grows."""
    ship_package(rows.sparkSession)
    n = rows.count()
    if n <= limit:
        return rows
    share = limit / n
    return rows.where(F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)))


def one_a_key(rows: DataFrame, key: str, *rest: str) -> DataFrame:
    """(key, text, ``rest``) of one row a key, the text with the smallest hash; ``rest`` is the same in all
    rows of a key.  Repeats go before the shuffle, so no task sees all rows of a key.  64 parts whatever their size."""
    found = rows.groupBy(key).agg(F.min_by("text", F.xxhash64("text")).alias("text"), *[F.max(c).alias(c) for c in rest])
    return found.repartition(64)
