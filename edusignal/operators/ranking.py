"""Exact positions inside large groups without a one-task window.

``row_number() OVER (PARTITION BY g ORDER BY k)`` sends a whole group to one
task; with a group holding a third of all rows (a label, a course) that is
the bottleneck.  Instead:

1. map ``k`` to a bucket that is monotone in ``k`` (for md5 hex keys, the
   first hex digits; for bounded numbers, a scaled floor),
2. count rows per (group, bucket) — partial aggregation, tiny output,
3. prefix-sum those counts per group (a window over at most ``n_buckets``
   rows per group) to get each bucket's offset,
4. number rows inside each (group, bucket) and add the offset.

The result equals the one-task window exactly; the biggest sort is one
bucket of one group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HEX_DIGITS = 3  # 4096 buckets


def md5_key(seed, *cols) -> F.Column:
    """md5 of ``seed-col1-col2...`` as hex: a reproducible shuffle order that
    DuckDB computes identically."""
    parts = [F.lit(str(seed))] + [F.col(c).cast("string") for c in cols]
    return F.md5(F.concat_ws("-", *parts))


def hex_bucket(key_col: str, digits: int = HEX_DIGITS) -> F.Column:
    return F.conv(F.substring(F.col(key_col), 1, digits), 16, 10).cast("int")


def positions(df: DataFrame, group: list[str], key_col: str, bucket: F.Column,
              out: str = "pos", tie_cols: list[str] | None = None) -> DataFrame:
    """Add ``out`` = 1-based row number of each row inside its ``group``
    ordered by ``key_col`` (then ``tie_cols``), plus ``<out>_n`` = group size."""
    b = df.withColumn("_bkt", bucket)
    counts = b.groupBy(*group, "_bkt").agg(F.count(F.lit(1)).alias("_cnt"))
    wg = Window.partitionBy(*group).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    wt = Window.partitionBy(*group)
    offsets = counts.select(*group, "_bkt",
                            F.coalesce(F.sum("_cnt").over(wg), F.lit(0)).alias("_off"),
                            F.sum("_cnt").over(wt).alias(f"{out}_n"))
    wi = Window.partitionBy(*group, "_bkt").orderBy(F.col(key_col), *[F.col(c) for c in (tie_cols or [])])
    local = b.withColumn("_local", F.row_number().over(wi))
    return (local.join(offsets, [*group, "_bkt"])
                 .withColumn(out, (F.col("_off") + F.col("_local")).cast("bigint"))
                 .drop("_bkt", "_local", "_off"))


def prefix_sums(df: DataFrame, group: list[str], key_col: str, bucket: F.Column, values: dict[str, F.Column],
                tie_cols: list[str] | None = None) -> DataFrame:
    """Add ``<name>_before`` and ``<name>_total`` per value: its sum over the rows of the ``group`` before the row (by
    ``key_col``, then ``tie_cols``), and over all of them, with no group in one task (see above)."""
    b = df.withColumns({"_bkt": bucket, **{f"_{name}": v for name, v in values.items()}})
    sums = b.groupBy(*group, "_bkt").agg(*[F.sum(f"_{name}").alias(f"_{name}_b") for name in values])
    wg = Window.partitionBy(*group).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    wt = Window.partitionBy(*group)
    offsets = sums.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_bkt").alias("_gb"),
                          *[F.coalesce(F.sum(f"_{name}_b").over(wg), F.lit(0)).alias(f"_{name}_off") for name in values],
                          *[F.sum(f"_{name}_b").over(wt).alias(f"{name}_total") for name in values])
    wi = (Window.partitionBy(*group, "_bkt").orderBy(F.col(key_col), *[F.col(c) for c in (tie_cols or [])])
          .rowsBetween(Window.unboundedPreceding, -1))
    local = b.withColumns({f"_{name}_in": F.coalesce(F.sum(f"_{name}").over(wi), F.lit(0)) for name in values})
    same = F.col("_bkt") == F.col("_gb")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = local.join(offsets, same)
    return (out.withColumns({f"{name}_before": F.col(f"_{name}_off") + F.col(f"_{name}_in") for name in values})
            .drop("_bkt", "_gb", *[f"_g{i}" for i in range(len(group))], *[f"_{n}{x}" for n in values for x in ("", "_in", "_off")]))


def with_position(ordered: DataFrame, out: str = "position") -> DataFrame:
    """``ordered`` (the result of an ``orderBy``) with each row's 1-based place in it.

    The sorted rows are written once; a row's place is its place in its own
    (range) partition plus the sizes of the partitions before, a row per
    partition.  No task sees all rows."""
    from ..session import ensure_checkpoint_dir

    ensure_checkpoint_dir(ordered.sparkSession)
    rows = ordered.checkpoint().withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    sizes = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = sizes.select("_p", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_off"))
    local = F.col("_i").bitwiseAND((1 << 33) - 1)  # the id's low bits count within the partition
    return rows.join(offsets, "_p").withColumn(out, (F.col("_off") + local + 1).cast("bigint")).drop("_p", "_i", "_off")
