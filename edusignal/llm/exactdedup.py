"""Exact dedup by a tree-merge of sorted digest runs (DataFrame functions only).

Every row goes to one of R leaf runs (by the hash of its doc_id).  A run holds one
row a digest, sorted by digest, with the identifier to keep and the number of rows.
In each binomial round, ``fan_in`` neighbouring runs exchange their rows by digest
and are merged: the digest's identifiers are compared and the winner is kept.  After
log(R) rounds one logical run is left; it is spread over all partitions by digest.
A digest is its SHA-256 *and* byte length *and* a seeded 64-bit hash of the normalised
text; rows merge only if all three agree, at every level.

A group of copies of any size has at most one row a run, so no task holds a hot group.
The way back is two joins: leaf runs with the merged run, documents with their own leaf.

Defined cases: a null text counts as empty; upper and lower case A-Z are equal, other
letters are not; a null doc_id is smaller than any other; rows that repeat doc_id and
text stand for one document, of which one row is kept; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, kept_rows, settle, shard_of, shards

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LEAF = ["__shard", "__key"]


def lower_az(text):
    """A-Z lower-cased, all else as it is.  ``lower`` does just that unless the text
    has a capital (or titlecase) letter outside ASCII."""
    other = r"[\p{javaUpperCase}\p{javaTitleCase}&&[^\x00-\x7F]]"
    return F.when(text.rlike(other), F.translate(text, UPPER, UPPER.lower())).otherwise(F.lower(text))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the raw text, leaf run and digest of every row."""
    spark = docs.sparkSession
    norm = docs.select("doc_id", F.xxhash64("text").alias("__h"),
                       lower_az(F.coalesce(F.col("text"), F.lit(""))).alias("__norm"))
    return norm.select("doc_id", "__h", shard_of(spark, F.col("doc_id")).alias("__shard"),
                       F.struct(F.sha2("__norm", 256).alias("sha"), F.octet_length("__norm").alias("bytes"),
                                F.xxhash64(F.lit("verify"), "__norm").alias("check")).alias("__key"))


def merged_run(rows: DataFrame, fan_in: int = 4, keep: str = "max") -> DataFrame:
    """One row a digest: ``__best`` (struct of doc_id and text hash) and ``__size``."""
    pick = F.max if keep == "max" else F.min
    mine = F.struct(F.col("doc_id").isNull().alias("none") if keep == "min" else F.lit(0).alias("none"),
                    F.col("doc_id").alias("id"), F.col("__h").alias("h"))
    run = rows.groupBy(*LEAF).agg(pick(mine).alias("__best"), F.count(F.lit(1)).alias("__size"))
    left = shards(rows.sparkSession)
    while left > 1:
        run = (run.withColumn("__shard", F.floor(F.col("__shard") / fan_in).cast("int"))
               .groupBy(*LEAF).agg(pick("__best").alias("__best"), F.sum("__size").alias("__size")))
        left = -(-left // fan_in)
    return run.drop("__shard")


def exact_groups(docs: DataFrame, fan_in: int = 4, keep: str = "max") -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = settle(digests(docs))
    many = merged_run(rows, fan_in, keep).where("__size > 1")
    found = attach(rows, many, "__key")
    best = F.col("__best")
    mine = F.coalesce(best["id"].eqNullSafe(F.col("doc_id")) & best["h"].eqNullSafe(F.col("__h")), F.lit(True))
    mine = F.when(best.isNull(), F.lit(True)).otherwise(mine)
    turn = Window.partitionBy(*LEAF, "doc_id", "__h").orderBy("__h")
    return (found.withColumn("__turn", F.when(best.isNull(), 1).otherwise(F.row_number().over(turn)))
            .select("doc_id", F.when(best.isNull(), F.col("doc_id")).otherwise(best["id"]).alias("keep_id"),
                    F.coalesce("__size", F.lit(1)).cast("long").alias("group_size"),
                    (mine & (F.col("__turn") == 1)).alias("kept"), F.col("__key.sha").alias("text_sha256"), "__h"))


def drop_exact_copies(docs: DataFrame, fan_in: int = 4, keep: str = "max") -> DataFrame:
    """``docs`` (all columns) without all but one row of each group of equal texts."""
    run = merged_run(digests(docs), fan_in, keep)
    return kept_rows(docs, run.select(F.col("__best.id").alias("__id"), F.col("__best.h").alias("__h")))
