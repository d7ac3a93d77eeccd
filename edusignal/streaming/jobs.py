"""Structured Streaming re-aims (survey N1, N2).  The reference has no
streaming; these are the two streams a Spark user of it would run.

N1  landed JSON payload files of every kind -> a keyed table, processed incrementally
    with ``Trigger.AvailableNow`` and ``foreachBatch``: each micro-batch is
    flattened, upserted (A17) into the buckets that its keys touch and committed with
    its number (readers never see a half-written table, a replayed batch is skipped).
N2  daily activity counts per user from the event log with a 2-day
    watermark for late events; finalized days are appended to parquet.  Or per
    user, course and day into a bucketed table that takes late events whenever they come.  The
    result equals the batch pre-aggregate
    :func:`edusignal.operators.events.daily_counts`.

Checkpoints go under the shared folder named by ``spark.checkpoint.dir``
(read from the session), so a restarted query resumes where it stopped.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import DEFAULT_AS_OF
from ..operators.upsert import dedupe_source
from ..session import ensure_checkpoint_dir
from ..sources import payloads as PL
from ..sources.buckets import upsert_buckets

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def checkpoint_path(spark: SparkSession, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), "streams", name)


# --- N2 ------------------------------------------------------------------------------


def _events(spark: SparkSession, events_dir: str, files_per_trigger: int | None, courses: DataFrame | None) -> DataFrame:
    reader = spark.readStream.schema(EVENT_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    ev = reader.parquet(events_dir)
    return ev if courses is None else ev.join(courses.select("user_id", "course_id"), "user_id")


def daily_activity_stream(spark: SparkSession, events_dir: str, out_dir: str, name: str = "daily_activity",
                          late: str = "2 days", files_per_trigger: int | None = None) -> int:
    """Count events per (user, day) with a watermark; append finalized days.

    One run takes all files that have landed since the last one together, in any
    order, so the watermark moves between runs only (``files_per_trigger`` splits a
    run; files should then be in time order).  Returns how many counts (of a user and
    day within a task) came later than the watermark allows and were left out, summed over the run's batches: 0 means
    that the output is complete; where files come in any order, :func:`daily_counts_stream` keeps late rows."""
    ev = _events(spark, events_dir, files_per_trigger, None)
    ev = ev.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need a zoned timestamp (UTC session)
    counts = (ev.withWatermark("ts", late)
                .groupBy(F.window("ts", "1 day").alias("w"), "user_id")
                .agg(F.count(F.lit(1)).alias("events"))
                .select("user_id", F.to_date(F.col("w.start")).alias("day"), F.col("events").cast("bigint")))
    q = (counts.writeStream.outputMode("append").format("parquet")
         .option("checkpointLocation", checkpoint_path(spark, name)).option("path", out_dir)
         .trigger(availableNow=True).start())
    dropped: dict[int, int] = {}  # by batch: the query itself keeps its last reports only
    ended = False
    while not ended:
        ended = q.awaitTermination(1)
        for p in q.recentProgress:
            dropped[p.batchId] = max(dropped.get(p.batchId, 0), sum(op.numRowsDroppedByWatermark for op in p.stateOperators))
    return sum(dropped.values())


def daily_counts_stream(spark: SparkSession, events_dir: str, table_base: str, courses: DataFrame, name: str = "daily_counts",
                        files_per_trigger: int | None = None, committed=None) -> None:
    """Count events per (user, course, day) into a bucketed table, each micro-batch once: its counts are added to
    those of the rows it touches, however late they come, and committed with its number.  ``courses``: (user_id, course_id)."""
    keys = ["user_id", "course_id", "day"]

    def add(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy("user_id", "course_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("events"))
        upsert_buckets(batch.sparkSession, table_base, counts, keys, "events", batch=(name, batch_id), add_cols=["events"])
        if committed:
            committed(batch_id)

    (_events(spark, events_dir, files_per_trigger, courses).writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint_path(spark, name))
        .trigger(availableNow=True).start().awaitTermination())


def streamed_with_open_days(spark: SparkSession, events_dir: str, out_dir: str) -> DataFrame:
    """The streamed (finalized) days plus the days still open behind the
    watermark when input ended, counted in batch.  The open tail is at most
    ``late`` wide, so this is a small bounded batch."""
    done = spark.read.parquet(out_dir)
    last_done = done.select(F.max("day")).scalar()  # scalar subquery
    ev = spark.read.parquet(events_dir)
    tail = (ev.where(F.to_date("ts") > F.coalesce(last_done, F.lit("0001-01-01").cast("date")))
              .groupBy("user_id", F.to_date("ts").alias("day"))
              .agg(F.count(F.lit(1)).cast("bigint").alias("events")))
    return done.unionByName(tail)


# --- N1 ------------------------------------------------------------------------------

_BY = "_landed"  # when the payload's file landed, carried beside the rows
_STUDENT = ["user_id", "course_id"]
_WHOLE = None  # no key: a row equal in all fields but its fetch time is the same row


def _payload_rows(schema):
    """Course-level payloads as they are (A11 reads its benchmarks from them)."""
    return lambda df, at: df.select("course_id", *schema.fieldNames(), _BY)


# table -> (folder of the payloads, payload schema, rows of a batch with course_id, user_id / _file and _landed, key)
_KINDS = {
    "enrollments": ("enrollments", PL.ENROLL_PAGE, lambda df, at: PL.flatten_enrollments(PL.enrollment_items(df, _BY), at, _BY),
                    ["enrollment_id", "course_id", "user_id", "username"]),
    "course_info": ("course_info", PL.COURSE_INFO, lambda df, at: PL.course_info_rows(df, _BY), ["course_id"]),
    "h5p": ("h5p", PL.H5P_PAYLOAD, lambda df, at: PL.h5p_summaries(df, _BY), _STUDENT),
    "h5p_attempts": ("h5p", PL.H5P_PAYLOAD, lambda df, at: PL.h5p_attempts(df, at, _BY), _WHOLE),
    "video": ("video", PL.VIDEO_PAYLOAD, lambda df, at: PL.video_summaries(df, _BY), _STUDENT),
    "video_positions": ("video", PL.VIDEO_PAYLOAD, lambda df, at: PL.video_positions(df, at, _BY), _WHOLE),
    "combined": ("combined", PL.COMBINED, lambda df, at: PL.combined_rows(df, _BY), _STUDENT),
    "dashboard": ("dashboard", PL.DASHBOARD, lambda df, at: PL.dashboard_rows(df, _BY), _STUDENT),
    "grades": ("grades", PL.GRADES, lambda df, at: PL.grades_rows(PL.students_of(df, _BY), _BY), _STUDENT),
    "progress": ("progress", PL.PROGRESS, lambda df, at: PL.progress_rows(PL.students_of(df, _BY), _BY), _STUDENT),
    "discussions": ("discussions", PL.DISCUSSIONS, lambda df, at: PL.discussion_rows(PL.students_of(df, _BY), _BY), _STUDENT),
    **{kind: (kind, PL.STATS[kind], _payload_rows(PL.STATS[kind]), ["course_id"]) for kind in PL.STATS},
}


def payload_stream(spark: SparkSession, landing_root: str, table_base: str, kind: str = "grades",
                   name: str | None = None, as_of: str = DEFAULT_AS_OF, committed=None) -> None:
    """Upsert newly landed payloads of one kind into the bucketed table at ``table_base`` (:mod:`..sources.buckets`).

    Of several payloads of a key in a batch, the one whose file landed last counts.  A batch rewrites the buckets of its own
    keys and is committed with its number: one that is replayed after a crash is skipped.  ``committed`` is
    called with the batch number after each commit."""
    folder, schema, rows_of, keys = _KINDS[kind]
    name = name or f"payload_{kind}"
    path = F.col("_metadata.file_path")
    src = (spark.readStream.schema(schema).option("multiLine", True)
           .json(f"{landing_root.rstrip('/')}/*/{folder}/*.json")
           .select("*", F.regexp_extract(path, rf"/([^/]+)/{folder}/[^/]+$", 1).alias("course_id"),
                   F.regexp_extract(path, r"/([^/]+)\.json$", 1).alias("_file"),
                   F.col("_metadata.file_modification_time").alias(_BY)))

    def upsert_batch(batch: DataFrame, batch_id: int) -> None:
        payloads = batch.withColumn("user_id", F.col("_file").try_cast("bigint"))
        rows = rows_of(payloads, as_of)
        key = keys or [c for c in rows.columns if c not in ("fetched_at", _BY)]
        latest = dedupe_source(rows, key, _BY).drop(_BY)
        rest = [c for c in latest.columns if c not in key] or key[:1]
        upsert_buckets(batch.sparkSession, table_base, latest, key, rest, batch=(name, batch_id))
        if committed:
            committed(batch_id)

    (src.writeStream.foreachBatch(upsert_batch)
        .option("checkpointLocation", checkpoint_path(spark, name))
        .trigger(availableNow=True).start().awaitTermination())
