"""Source queries (A2–A13, A22, G1, B1, B14–B16, K1, I2): the given tables are packed
into the platform's JSON payloads, landed in memory as JSON text, decoded with
the payload schemas and flattened; the oracle states the tables they must give."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import models as M
from ..operators import roster as R
from ..operators.ranking import hex_bucket, positions
from ..session import ensure_checkpoint_dir
from ..sources import payloads as PL
from ..sources import sinks as SK
from .base import AS_OF, register

KEYS = ["user_id", "course_id"]


def landed(df: DataFrame, schema, payload: F.Column, *keep: str) -> DataFrame:
    """Rows whose ``payload`` went through JSON text and back by ``schema``."""
    return df.select(*keep, F.from_json(F.to_json(payload), schema).alias("_p")).select(*keep, "_p.*")


# --- A1 / A2 / A3 / G1 / G2 / A22 ------------------------------------------------------------

def pages(d) -> DataFrame:
    """Enrolment pages of at most 100 items per course: even pages hold the list in
    ``data.enrollments``, odd ones in ``results``."""
    info = F.struct("mssv", "class_code", "department")
    item = F.to_json(F.struct("user_id", "username", "email", "full_name", "enrollment_id", "mode", "is_active",
                              F.date_format("created", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created"), info.alias("student_info")))
    by = dealt(d.enrollments, ["course_id"]).groupBy("course_id", F.col("_part").alias("n")).agg(F.array_join(F.collect_list(item), ",").alias("items"))
    text = F.concat(F.lit("["), F.col("items"), F.lit("]"))
    even = F.col("n") % 2 == 0
    return by.select("course_id", F.concat(F.lit("page_"), "n").alias("_file"),
                     F.when(even, F.concat(F.lit('{"enrollments":'), text, F.lit("}"))).alias("data"),
                     F.lit(None).cast("string").alias("enrollments"), F.when(~even, text).alias("results"))


A2_COLS = ("course_id:s user_id:i username:s email:s full_name:s enrollment_id:i mode:s is_active:b created:t mssv:s first_name:s "
           "class_code:s department:s faculty:s fetched_at:t")


@register("landed_enrollments", A2_COLS, f"""
SELECT course_id, user_id, username, email, full_name, enrollment_id, mode, is_active, created, mssv, '' AS first_name,
  class_code, department, '' AS faculty, {AS_OF} AS fetched_at FROM enrollments""", "A1 A2 G1")
def q_a2(d):
    return PL.flatten_enrollments(PL.enrollment_items(pages(d)), d.as_of)


@register("enrollment_attributes", "course_id:s user_id:i key:s kind:s text:s number:d", """
WITH e AS (SELECT course_id, user_id, class_code, is_active, enrollment_id % 10 AS n FROM enrollments)
SELECT course_id, user_id, 'class' AS key, 'text' AS kind, class_code AS text, CAST(NULL AS DOUBLE) AS number FROM e WHERE n <> 9
UNION ALL SELECT course_id, user_id, 'active', 'boolean', CASE WHEN is_active THEN 'true' ELSE 'false' END, NULL FROM e WHERE n <> 9
UNION ALL SELECT course_id, user_id, 'visits_' || n, 'number', (user_id * 3)::VARCHAR, user_id * 3 FROM e WHERE n <> 9
UNION ALL SELECT course_id, user_id, 'points', 'text', n || '.5', n + 0.5 FROM e WHERE n <> 9
UNION ALL SELECT course_id, user_id, 'tags', 'array', '["a","t' || n || '"]', NULL FROM e WHERE n <> 9
UNION ALL SELECT course_id, user_id, NULL, 'malformed', '{"class": ' || user_id, NULL FROM e WHERE n = 9""", "A2 B8")
def q_attributes(d):
    """Typed values of the unknown keys of every enrolment's attributes, landed as JSON text."""
    n, user = (F.col("enrollment_id") % 10).cast("string"), F.col("user_id").cast("string")
    good = F.concat(F.lit('{"class": '), F.to_json(F.array("class_code")).substr(F.lit(2), F.length(F.to_json(F.array("class_code"))) - 2), F.lit(', "active": '),
                    F.col("is_active").cast("string"), F.lit(', "visits_'), n, F.lit('": '), (F.col("user_id") * 3).cast("string"),
                    F.lit(', "points": "'), n, F.lit('.5", "tags": ["a", "t'), n, F.lit('"]}'))
    text = F.when(n == "9", F.concat(F.lit('{"class": '), user)).otherwise(good)
    return PL.attribute_rows(d.enrollments.select("course_id", "user_id", text.alias("all_attributes")))


@register("scan_course_partition", "course_id:s user_id:i enrollment_id:i mode:s", """
SELECT course_id, user_id, enrollment_id, mode FROM enrollments WHERE course_id = 'BUILDING'""", "A13 with its predicate")
def q_a13_partition(d):
    """One course of a table laid out by course: the scan lists that course's folder alone."""
    path = f"{ensure_checkpoint_dir(d.spark).rstrip('/')}/tables/{uuid.uuid4()}"
    d.enrollments.select("course_id", "user_id", "enrollment_id", "mode").write.partitionBy("course_id").parquet(path)
    return SK.scan(d.spark, path, "BUILDING")


@register("landed_course_info", "course_id:s user_id:i course_name:s course_start:t", """
SELECT course_id, user_id, 'Course ' || course_id AS course_name, min(created) OVER (PARTITION BY course_id) AS course_start
FROM enrollments""", "A3")
def q_a3(d):
    starts = d.enrollments.groupBy("course_id").agg(F.min("created").alias("start"))
    data = F.struct(F.concat(F.lit("Course "), "course_id").alias("display_name"), F.col("start").cast("string").alias("start"))
    info = PL.course_info_rows(landed(starts, PL.COURSE_INFO, F.struct(F.lit(True).alias("success"), data.alias("data")), "course_id"))
    return PL.apply_course_info(d.enrollments, info)


@register("distinct_users", "course_id:s user_id:i", "SELECT DISTINCT course_id, user_id FROM h5p_scores", "G2")
def q_g2(d):
    return PL.distinct_users(d.h5p_scores)


@register("limit_users", "course_id:s user_id:i", """
SELECT course_id, user_id FROM (SELECT course_id, user_id, rank() OVER (PARTITION BY course_id ORDER BY user_id) AS r FROM enrollments)
WHERE r <= 25""", "A22")
def q_a22(d):
    return PL.limit_users(PL.distinct_users(d.enrollments), 25)


# --- A4 / A5 -----------------------------------------------------------------------------------

PART = 100  # items a payload at most


def in_parts(rows: DataFrame, item: F.Column, name: str) -> DataFrame:
    """Per student, payloads of at most ``PART`` items each: a student with more has several, dealt by the place of
    the row, so equal rows don't meet in one either."""
    return dealt(rows, KEYS).groupBy(*KEYS, "_part").agg(F.collect_list(item).alias(name))


def dealt(rows: DataFrame, group: list[str]) -> DataFrame:
    """``rows`` with ``_part``: which ``PART`` of the group's rows, in an order by digest, a row belongs to."""
    placed = positions(rows.withColumn("_key", F.md5(F.to_json(F.struct(*rows.columns)))), group, "_key", hex_bucket("_key", 2))
    return placed.withColumn("_part", F.floor((F.col("pos") - 1) / PART)).drop("_key", "pos", "pos_n")


def h5p_payloads(d) -> DataFrame:
    """A student's attempts in payloads of about 100."""
    item = F.struct("content_id", "content_title", "score", "max_score", F.col("percentage").cast("double").alias("percentage"), "opened",
                    "finished", F.col("time_spent").alias("time"), "folder_id", "folder_name")
    return landed(in_parts(d.h5p_scores, item, "scores"), PL.H5P_PAYLOAD, F.struct("scores"), *KEYS)


def h5p_totals(d) -> DataFrame:
    """One payload per student: the stored summary."""
    by = d.h5p_scores.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("s"))
    summary = F.struct(F.col("n").alias("total_contents"), F.col("s").alias("total_score"))
    return landed(by, PL.H5P_PAYLOAD, F.struct(summary.alias("summary")), *KEYS)


@register("landed_h5p_attempts",
          "user_id:i course_id:s content_id:i content_title:s score:i max_score:i percentage:d opened:i finished:i time_spent:i "
          "folder_id:i folder_name:s", """
SELECT user_id, course_id, content_id, content_title, score, max_score, percentage, opened, finished, time_spent, folder_id, folder_name
FROM h5p_scores""", "A4")
def q_a4(d):
    return PL.h5p_attempts(h5p_payloads(d), d.as_of)


@register("landed_h5p_summary", "user_id:i course_id:s total_contents:i completed_contents:i total_score:i overall_percentage:d", """
SELECT user_id, course_id, count(*) AS total_contents, 0 AS completed_contents, sum(score) AS total_score, 0.0 AS overall_percentage
FROM h5p_scores GROUP BY ALL""", "A4")
def q_a4s(d):
    return PL.h5p_summaries(h5p_totals(d))


def video_payloads(d) -> DataFrame:
    item = F.struct("content_id", "content_title", F.col("progress_percent").cast("double").alias("progress_percent"), "current_time",
                    "duration", "status", "folder_id", "folder_name")
    return landed(in_parts(d.video_progress, item, "video_progress"), PL.VIDEO_PAYLOAD, F.struct("video_progress"), *KEYS)


def video_totals(d) -> DataFrame:
    by = d.video_progress.groupBy(*KEYS).agg(F.sum("duration").alias("t"))
    return landed(by, PL.VIDEO_PAYLOAD, F.struct(F.struct(F.col("t").alias("total_duration")).alias("summary")), *KEYS)


@register("landed_video_positions",
          "user_id:i course_id:s content_id:i content_title:s progress_percent:d current_time:i duration:i status:s folder_id:i folder_name:s",
          'SELECT user_id, course_id, content_id, content_title, progress_percent, "current_time", duration, status, folder_id, folder_name '
          "FROM video_progress", "A5")
def q_a5(d):
    return PL.video_positions(video_payloads(d), d.as_of)


@register("landed_video_summary", "user_id:i course_id:s total_videos:i total_duration:i overall_progress:d",
          "SELECT user_id, course_id, 0 AS total_videos, sum(duration) AS total_duration, 0.0 AS overall_progress "
          "FROM video_progress GROUP BY ALL", "A5")
def q_a5s(d):
    return PL.video_summaries(video_totals(d))


# --- A6 / A7 -----------------------------------------------------------------------------------

@register("landed_dashboard", "user_id:i course_id:s overall_completion:d total_items:i completed_items:i items_to_complete:i "
          "h5p_total_score:i video_average_progress:d folder_total_folders:i", """
SELECT user_id, course_id, p.completion_rate AS overall_completion, p.total_blocks AS total_items, p.completed_blocks AS completed_items,
  greatest(0, p.total_blocks - p.completed_blocks) AS items_to_complete, 0 AS h5p_total_score, 0.0 AS video_average_progress,
  0 AS folder_total_folders
FROM mooc_progress p
UNION ALL
SELECT e.user_id, e.course_id, 12.5, 8, 1, 7, 0, 33.0, e.user_id % 5
FROM enrollments e ANTI JOIN mooc_progress p ON p.user_id = e.user_id AND p.course_id = e.course_id""", "A6 A7")
def q_a6(d):
    """Combined payloads of the students with progress; older dashboard payloads of all students."""
    overall = F.struct(F.col("total_blocks").alias("total_items"), F.col("completed_blocks").alias("completed_items"),
                       F.col("completion_rate").cast("double").alias("overall_completion"))
    combined = landed(d.mooc_progress, PL.COMBINED, F.struct(overall.alias("overall")), *KEYS)
    overview = F.struct(F.lit(12.5).alias("overall_completion"), F.lit(8).alias("total_items"), F.lit(1).alias("completed_items"),
                        F.lit(7).alias("items_to_complete"))
    older = landed(d.enrollments, PL.DASHBOARD, F.struct(
        overview.alias("overview"), F.struct(F.lit(33.0).alias("average_video_progress")).alias("video_stats"),
        F.struct((F.col("user_id") % 5).alias("total_folders")).alias("folder_scores_stats")), *KEYS)
    return PL.dashboard_summary(PL.combined_rows(combined), PL.dashboard_rows(older))


# --- A8 / A9 / A10 -----------------------------------------------------------------------------

def class_files(df: DataFrame, student: F.Column, schema) -> DataFrame:
    """``{students: [...]}`` files of at most 100 students each."""
    by = dealt(df, ["course_id"]).groupBy("course_id", "_part").agg(F.collect_list(student).alias("students"))
    return PL.students_of(landed(by, schema, F.struct("students"), "course_id"))


@register("landed_grades", "user_id:i course_id:s username:s email:s full_name:s percent_grade:d grade_percentage:d letter_grade:s is_passed:b", """
SELECT user_id, course_id, username, email, full_name, 0.0 AS percent_grade, grade_percentage,
  CASE WHEN is_passed THEN 'Pass' ELSE '' END AS letter_grade, ifnull(is_passed, FALSE) AS is_passed FROM mooc_grades""", "A8")
def q_a8(d):
    s = F.struct("user_id", "username", "email", "full_name", F.col("grade_percentage").cast("double").alias("grade_percentage"), "is_passed")
    return PL.grades_rows(class_files(d.mooc_grades, s, PL.GRADES))


@register("landed_progress", "user_id:i course_id:s current_chapter:s completion_rate:d last_activity:t", """
SELECT user_id, course_id, 'chapter ' || (user_id % 9) AS current_chapter, completion_rate, last_activity FROM mooc_progress""", "A9 A12")
def q_a9(d):
    s = F.struct("user_id", F.concat(F.lit("chapter "), (F.col("user_id") % 9).cast("string")).alias("current_chapter"),
                 F.col("completion_rate").cast("double").alias("completion_rate"),
                 F.date_format("last_activity", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("last_activity"))
    return PL.progress_rows(class_files(d.mooc_progress, s, PL.PROGRESS))


@register("landed_discussions", "user_id:i course_id:s username:s threads_count:i comments_count:i total_interactions:i questions_count:i", """
SELECT user_id, course_id, username, threads_count, comments_count, total_interactions, 0 AS questions_count FROM mooc_discussions""", "A10")
def q_a10(d):
    s = F.struct("user_id", "username", "threads_count", "comments_count", "total_interactions")
    return PL.discussion_rows(class_files(d.mooc_discussions, s, PL.DISCUSSIONS))


# --- A11 ---------------------------------------------------------------------------------------

@register("landed_benchmarks", "course_id:s activity_avg_score:d activity_total_activities:i activity_avg_per_user:d assessment_avg_score:d "
          "assessment_avg_attempts:d progress_avg_completion:d total_students:i active_students:i", """
WITH a AS (SELECT course_id, count(*) AS n, count(DISTINCT user_id) AS u FROM h5p_scores GROUP BY ALL),
p AS (SELECT course_id, count(*) AS n FROM mooc_progress GROUP BY ALL)
SELECT course_id, 70.5 AS activity_avg_score, a.n AS activity_total_activities,
  CASE WHEN a.u > 0 THEN ((a.n * 200 + a.u) // (2 * a.u)) / 100.0 ELSE 0 END AS activity_avg_per_user, 61.25 AS assessment_avg_score,
  CASE WHEN a.u > 0 THEN ((a.n * 200 + a.u) // (2 * a.u)) / 100.0 ELSE 0 END AS assessment_avg_attempts, 40.0 AS progress_avg_completion,
  greatest(ifnull(a.u, 0), ifnull(p.n, 0)) AS total_students, a.u AS active_students
FROM a FULL JOIN p USING (course_id)""", "A11")
def q_a11(d):
    a = d.h5p_scores.groupBy("course_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("u"))
    p = d.mooc_progress.groupBy("course_id").agg(F.count(F.lit(1)).alias("n"))
    ok = F.lit(True).alias("success")
    act = F.struct(F.lit(70.5).alias("avg_score"), F.col("n").alias("total_activities"), F.col("u").alias("total_active_users"))
    asmt = F.struct(F.lit(61.25).alias("avg_score"), F.col("u").alias("unique_students"), F.col("n").alias("total_attempts"))
    prog = F.struct(F.lit(40.0).alias("avg_progress"), F.col("n").alias("total_students"))
    return PL.stats_benchmarks(landed(a, PL.STATS_ACT, F.struct(ok, act.alias("summary")), "course_id"),
                               landed(a, PL.STATS_ASMT, F.struct(ok, asmt.alias("summary")), "course_id"),
                               landed(p, PL.STATS_PROG, F.struct(ok, prog.alias("summary")), "course_id"))


# --- A12 / A13 / B1 ----------------------------------------------------------------------------

@register("parsed_times", "id:i parsed:t", """
SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('milliseconds', ts)
  WHEN 2 THEN date_trunc('day', ts) WHEN 3 THEN date_trunc('second', ts) END AS parsed FROM events""", "A12")
def q_a12(d):
    """Every event's time in one of five spellings, the last of them not a time."""
    ts, kind = F.col("ts"), F.col("event_id") % 5
    text = (F.when(kind == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(kind == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'+07:00'"))
            .when(kind == 2, F.date_format(ts, "yyyy-MM-dd")).when(kind == 3, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
            .otherwise(F.date_format(ts, "dd/MM/yyyy")))
    return d.base("events").select(F.col("event_id").alias("id"), PL.parse_ts(text).alias("parsed"))


@register("scan_course", "c_custkey:i c_mktsegment:s", "SELECT c_custkey, c_mktsegment FROM customer", "A13")
def q_a13(d):
    return SK.scan(d.spark, f"{d.sf_dir}/customer.parquet")


@register("in_course", "user_id:i course_id:s mooc_completion_rate:d",
          "SELECT user_id, course_id, mooc_completion_rate FROM student_features WHERE course_id = 'MACHINERY'", "B1")
def q_b1(d):
    return R.in_course(d.student_features, "MACHINERY")


# --- B13 - B16 / K1 / I2 -----------------------------------------------------------------------

@register("training_frame", "user_id:i course_id:s label:i enrollment_mode:s mooc_completion_rate:d days_since_last_activity:i "
          "h5p_overall_percentage:d video_completion_rate:d", """
SELECT user_id, course_id, CASE WHEN f.mooc_is_passed THEN 0 ELSE 1 END AS label, ifnull(f.enrollment_mode, 'missing') AS enrollment_mode,
  ifnull(f.mooc_completion_rate, 0) AS mooc_completion_rate, ifnull(f.days_since_last_activity, 0) AS days_since_last_activity,
  ifnull(f.h5p_overall_percentage, 0) AS h5p_overall_percentage, ifnull(f.video_completion_rate, 0) AS video_completion_rate
FROM student_features f WHERE f.mooc_is_passed IS NOT NULL""", "K1 B14 B15 B16")
def q_k1(d):
    f = d.student_features.withColumn("is_passed", F.col("mooc_is_passed"))
    tf, cat, num = M.training_frame(f)
    assert "mooc_grade_percentage" not in num and "mooc_is_passed" not in cat + num  # B13: no leaking feature
    return tf
