"""File sources and sinks (survey A14–A21, and the versioned writes behind A17/L*).

Writes never overwrite a path that is being read: table updates go to a new
version directory (:func:`write_version`), and readers pick the newest
committed version.  Everything is a distributed Spark write — per-course or
per-day files come from ``partitionBy``, not from driver loops.
"""

from __future__ import annotations

import json
import re
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

# --- versioned tables ----------------------------------------------------------------


def _hadoop_fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def list_versions(spark: SparkSession, base: str) -> list[int]:
    fs, p = _hadoop_fs(spark, base)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        m = re.fullmatch(r"v=(\d+)", name)
        if m and fs.exists(st.getPath().suffix("/_SUCCESS")):
            out.append(int(m.group(1)))
    return sorted(out)


def read_latest(spark: SparkSession, base: str) -> DataFrame:
    v = list_versions(spark, base)
    if not v:
        raise FileNotFoundError(f"no committed version under {base}")
    return spark.read.parquet(f"{base.rstrip('/')}/v={v[-1]}")


def write_version(df: DataFrame, base: str, partition_by: list[str] | None = None) -> str:
    """Write ``df`` as the next version of the table at ``base`` (parquet);
    the previous version stays readable until this one has committed."""
    spark = df.sparkSession
    v = (list_versions(spark, base) or [0])[-1] + 1
    path = f"{base.rstrip('/')}/v={v}"
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


# --- A13 -------------------------------------------------------------------------------


def scan(spark: SparkSession, path: str, course_id: str | None = None) -> DataFrame:
    """Table scan with an optional course predicate.  Tables written with
    ``partitionBy('course_id')`` get partition pruning; otherwise the filter is
    pushed into the parquet reader (row-group min/max skipping)."""
    df = spark.read.parquet(path)
    return df if course_id is None else df.where(F.col("course_id") == course_id)


# --- A14 / A21 -------------------------------------------------------------------------


def read_features_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV hand-off with a header, read with an explicit schema."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_feature_list(spark: SparkSession, path: str) -> DataFrame:
    """Model feature names from an importance CSV (``feature`` column)."""
    return spark.read.schema("feature string, importance double").option("header", True).csv(path) \
        .select("feature").where(F.col("feature").isNotNull())


# --- A15 / A16 -----------------------------------------------------------------------------


def write_features(df: DataFrame, path: str) -> None:
    """Whole feature table as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_predictions(df: DataFrame, path: str, as_of: str) -> None:
    """Predictions as CSV, one folder per course and day.  Running a day again
    replaces that day's folders (dynamic partition overwrite) and no other."""
    out = df.withColumn("day", F.date_format(F.lit(as_of).cast("timestamp_ntz"), "yyyyMMdd"))
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("course_id", "day").option("header", True).csv(path))


def write_eval(folds: DataFrame, summary: DataFrame, path: str) -> None:
    """Per-fold rows as CSV and JSON, the summary as JSON lines.  The frames hold
    a row per fold; they are worked out once and written three times, one file each."""
    ensure_checkpoint_dir(folds.sparkSession)
    folds, summary = folds.checkpoint(), summary.checkpoint()
    folds.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/folds_csv")
    folds.coalesce(1).write.mode("overwrite").json(f"{path}/folds_json")
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary_json")


# --- A18 -----------------------------------------------------------------------------------

# Fields of an intervention post.
INTERVENTION_SCHEMA = "user_id bigint, course_id string, type string, action string, notes string"


def append_interventions(spark: SparkSession, posts: DataFrame, path: str, as_of: str) -> DataFrame:
    """Append-only intervention log.  The frontend posts ``action`` while
    the route reads ``type`` (Q17): store ``coalesce(type, action)``.  Ids are
    a 64-bit hash of the batch time and the row's unique in-batch id
    (partition id and offset) — no global sort, no counter on the driver."""
    ts = F.lit(as_of).cast("timestamp_ntz")
    rows = posts.select(
        "user_id", "course_id", F.coalesce("type", "action").alias("intervention_type"),
        F.coalesce("notes", F.lit("")).alias("notes"), ts.alias("created_at"))
    out = rows.withColumn("id", F.xxhash64(ts, F.monotonically_increasing_id(), "user_id", "course_id"))
    out.write.mode("append").parquet(path)
    return out


# --- A19 -----------------------------------------------------------------------------------

# Columns of the export file.
EXPORT_COLUMNS = ["user_id", "full_name", "email", "risk_level", "fail_risk_score", "mooc_grade_percentage",
                  "mooc_completion_rate", "days_since_last_activity"]


def export_name(course_id: str | None, as_of: str) -> str:
    """``early_warning_<course with : + / \\ -> _, max 80>_<yyyymmdd>.csv``.  A longer course
    name ends in a hash of the whole id instead, so that no two courses share a file."""
    safe = re.sub(r"[:+/\\]", "_", course_id or "course")
    if len(safe) > 80:
        safe = f"{safe[:71]}_{zlib.crc32((course_id or '').encode()):08x}"
    return f"early_warning_{safe}_{as_of[:10].replace('-', '')}.csv"


def export_roster(roster: DataFrame, path: str) -> None:
    """The 8 export columns as CSV, one folder per course; values with
    ``" , \\n \\r`` are quoted with doubled quotes; NULL is empty."""
    out = roster.select("course_id", *[F.col(c).cast("string").alias(c) for c in EXPORT_COLUMNS])
    (out.write.mode("overwrite").partitionBy("course_id").option("header", True)
        .option("quote", '"').option("escape", '"').option("nullValue", "").option("emptyValue", "")
        .option("quoteAll", False).csv(path))


# --- A20 -----------------------------------------------------------------------------------


def describe_table(df: DataFrame, n: int = 3) -> dict:
    """Schema report and a ``n``-row sample (a peek: ``take``, never
    ``collect``)."""
    return {"columns": [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields],
            "sample": [r.asDict() for r in df.take(n)]}


def describe_json(df: DataFrame, n: int = 3) -> str:
    return json.dumps(describe_table(df, n), default=str)
