"""Readers for landed platform JSON payloads (survey A1–A12, G1).

The reference pulls these over HTTP one user at a time.  Here the payloads
are files already landed under one root, laid out as

    <root>/<course_id>/<kind>/<name>.json     (kind: enrollments, course_info,
                                               h5p, video, combined, dashboard,
                                               grades, progress, discussions,
                                               stats_activity, stats_assessment,
                                               stats_progress)

and every reader takes all courses (and all users) in one scan with an
explicit schema — never schema inference.  Per-user payloads are named
``<user_id>.json``; enrollment pages ``page_<n>.json``.  Course and user ids
come from the file path (``_metadata.file_path``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.skew import attach, shard_of

L, D, S, B = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])


def _read(spark: SparkSession, root: str, kind: str, schema: T.StructType) -> DataFrame:
    path = f"{root.rstrip('/')}/*/{kind}/*.json"
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    fp = F.col("_metadata.file_path")
    return df.select("*", F.regexp_extract(fp, rf"/([^/]+)/{kind}/[^/]+$", 1).alias("course_id"),
                     F.regexp_extract(fp, r"/([^/]+)\.json$", 1).alias("_file"))


def _user_from_file() -> Column:
    return F.col("_file").try_cast("bigint")


def _z(c, t="bigint", default=0) -> Column:
    """``dict.get(k, default)``: missing/NULL -> default."""
    return F.coalesce(F.col(c).cast(t), F.lit(default).cast(t))


# --- A12 ---------------------------------------------------------------------------

_TS_RE = (r"^(\d{4})-(\d{2})-(\d{2})(?:[T ](\d{2}):(\d{2})(?::(\d{2})(\.\d+)?)?)?"
          r"(?:Z|[+-]\d{2}:?\d{2})?$")


def parse_ts(c) -> Column:
    """ISO datetimes with ``Z``, fractional seconds, an offset, or bare;
    the offset is cut, not applied (the reference strips the zone and keeps
    the wall clock); anything else is NULL."""
    s = F.trim(F.col(c) if isinstance(c, str) else c)
    ok = s.rlike(_TS_RE)

    def g(i):
        return F.regexp_extract(s, _TS_RE, i)

    sec = F.concat(F.when(g(6) == "", F.lit("0")).otherwise(g(6)), g(7)).cast("decimal(16,6)")
    hh = F.when(g(4) == "", F.lit("0")).otherwise(g(4)).cast("int")
    mi = F.when(g(5) == "", F.lit("0")).otherwise(g(5)).cast("int")
    ts = F.try_make_timestamp_ntz(g(1).cast("int"), g(2).cast("int"), g(3).cast("int"), hh, mi, sec) \
        if hasattr(F, "try_make_timestamp_ntz") else \
        F.make_timestamp_ntz(g(1).cast("int"), g(2).cast("int"), g(3).cast("int"), hh, mi, sec)
    return F.when(ok, ts)


# --- A1 / A2 / A3 / G1 ---------------------------------------------------------------

# Fixed values (here and below): the field names and types of the platform's payloads.
STUDENT_INFO = _struct(mssv=S, first_name=S, middle_name=S, last_name=S, full_name_vn=S,
                       class_code=S, department=S, faculty=S)
ENROLL_ITEM = _struct(user_id=L, id=L, username=S, email=S, full_name=S, enrollment_id=L, mode=S,
                      is_active=B, created=S, student_info=STUDENT_INFO, all_attributes=S)
# ``data`` is an object in one shape and a list in another, and lists may hold
# non-object items: read the candidates as raw JSON text and decode each
# element on its own (a non-object element decodes to NULL and is skipped).
ENROLL_PAGE = _struct(data=S, enrollments=S, results=S)


def _is_list(c: Column) -> Column:
    return F.ltrim(c).startswith("[")


def read_enrollment_pages(spark: SparkSession, root: str) -> DataFrame:
    """A1 + G1: one row per enrolment item of every landed page of every course."""
    return enrollment_items(_read(spark, root, "enrollments", ENROLL_PAGE))


def enrollment_items(df: DataFrame, *keep: str) -> DataFrame:
    """A1 on page rows (``ENROLL_PAGE`` columns, ``course_id``, ``_file``).

    The list is the first present of ``data.enrollments``, ``enrollments``,
    ``results``, ``data`` (as a list); non-object items are dropped.  (A short
    page tells a pager to stop fetching; pages that have landed all count.)
    ``user_key`` is ``user_id`` else ``id`` (for the user list)."""
    data, enr, res = F.col("data"), F.col("enrollments"), F.col("results")
    data_enr = F.get_json_object(data, "$.enrollments")
    text = (F.when(F.ltrim(data).startswith("{") & _is_list(data_enr), data_enr)
            .when(_is_list(enr), enr).when(_is_list(res), res).when(_is_list(data), data))
    elements = F.coalesce(F.from_json(text, T.ArrayType(S)), F.array().cast("array<string>"))
    page = F.regexp_extract("_file", r"(\d+)$", 1).try_cast("int")  # null for a name without digits
    pages = df.select("course_id", *keep, page.alias("page"), elements.alias("elements"))
    ex = pages.select("course_id", *keep, "page", F.posexplode("elements").alias("pos", "raw"))
    item = F.when(F.ltrim("raw").startswith("{"), F.from_json("raw", ENROLL_ITEM))
    return ex.select("course_id", *keep, "page", "pos", item.alias("item")).where(F.col("item").isNotNull()) \
        .select("course_id", *keep, "page", "pos", "item.*").withColumn("user_key", F.coalesce("user_id", "id"))


def flatten_enrollments(items: DataFrame, fetched_at: str, *keep: str) -> DataFrame:
    """A2: one ``enrollments`` row per item: student_info fields default '',
    mode 'audit', active true, attributes as JSON text (NULL when empty)."""
    si = "student_info"

    def info(k):
        return F.coalesce(F.col(f"{si}.{k}"), F.lit("")).alias(k)

    attrs = F.col("all_attributes")
    return items.select(
        "course_id", *keep, "user_id", F.coalesce("username", F.lit("")).alias("username"), "email", "full_name",
        "enrollment_id", F.coalesce("mode", F.lit("audit")).alias("mode"),
        F.coalesce("is_active", F.lit(True)).alias("is_active"), parse_ts("created").alias("created"),
        info("mssv"), info("first_name"), info("middle_name"), info("last_name"), info("full_name_vn"),
        info("class_code"), info("department"), info("faculty"),
        F.when(attrs.isNull() | attrs.isin("[]", "{}", "", "null"), F.lit(None).cast("string"))
         .otherwise(attrs).alias("all_attributes"),
        F.lit(fetched_at).cast("timestamp_ntz").alias("fetched_at"))


def attribute_rows(enroll: DataFrame) -> DataFrame:
    """Every field of every enrolment's ``all_attributes``, whatever its keys: (course_id, user_id, key, kind, text,
    number); elements of a list have their place as key.  Text that is no JSON is kept as one row of kind ``malformed``."""
    parsed = enroll.where(F.col("all_attributes").isNotNull()).select("course_id", "user_id", "all_attributes", F.try_parse_json("all_attributes").alias("_v"))
    each = parsed.where(F.col("_v").isNotNull()).lateralJoin(enroll.sparkSession.tvf.variant_explode(F.col("_v").outer()))
    value = F.col("value")
    kind = F.regexp_extract(F.schema_of_variant(value), r"^(\w+)", 1)
    plain = (F.when(kind == "VOID", "null").when(kind == "STRING", "text").when(kind == "BOOLEAN", "boolean")
             .when(kind.isin("OBJECT", "ARRAY"), F.lower(kind)).otherwise("number"))
    fields = each.select("course_id", "user_id", F.coalesce("key", F.col("pos").cast("string")).alias("key"), plain.alias("kind"),
                         F.when(plain.isin("object", "array"), F.to_json(value)).when(plain != "null", F.try_variant_get(value, "$", "string")).alias("text"),
                         F.when(plain.isin("number", "text"), F.try_variant_get(value, "$", "double")).alias("number"))
    bad = parsed.where(F.col("_v").isNull()).select("course_id", "user_id", F.lit(None).cast("string").alias("key"), F.lit("malformed").alias("kind"),
                                                     F.col("all_attributes").alias("text"), F.lit(None).cast("double").alias("number"))
    return fields.unionByName(bad)


COURSE_INFO = _struct(success=B, data=_struct(display_name=S, start=S, end=S))


def read_course_info(spark: SparkSession, root: str) -> DataFrame:
    return course_info_rows(_read(spark, root, "course_info", COURSE_INFO))


def course_info_rows(df: DataFrame, *keep: str) -> DataFrame:
    """A3 source: name, start and end from successful course payloads."""
    return df.where(F.col("success")).select("course_id", *keep, F.col("data.display_name").alias("course_name"),
                     parse_ts("data.start").alias("course_start"), parse_ts("data.end").alias("course_end"))


def apply_course_info(enroll: DataFrame, info: DataFrame) -> DataFrame:
    """A3: set name/start/end on every enrolment of the course (one info row
    per course; a course with a third of the enrolments meets it in parts)."""
    e = enroll.drop(*[c for c in ("course_name", "course_start", "course_end") if c in enroll.columns])
    return attach(e.withColumn("__shard", shard_of(enroll.sparkSession, F.col("user_id"))), info, "course_id").drop("__shard")


# --- A4 / A5 --------------------------------------------------------------------------

H5P_ITEM = _struct(content_id=L, content_title=S, score=L, max_score=L, percentage=D, opened=L, finished=L,
                   time=L, folder_id=L, folder_name=S)
H5P_SUMMARY = _struct(total_contents=L, completed_contents=L, total_score=L, total_max_score=L,
                      overall_percentage=D, total_time_spent=L)
H5P_PAYLOAD = _struct(scores=T.ArrayType(H5P_ITEM), summary=H5P_SUMMARY)


def _per_user(spark: SparkSession, root: str, kind: str, schema: T.StructType) -> DataFrame:
    """Payload rows of one kind with ``course_id`` and ``user_id`` (from the file name)."""
    return _read(spark, root, kind, schema).withColumn("user_id", _user_from_file())


def flatten_h5p(spark: SparkSession, root: str, fetched_at: str) -> tuple[DataFrame, DataFrame]:
    """A4 from landed files: (attempt rows, summary rows)."""
    df = _per_user(spark, root, "h5p", H5P_PAYLOAD)
    return h5p_attempts(df, fetched_at), h5p_summaries(df)


def h5p_attempts(df: DataFrame, fetched_at: str, *keep: str) -> DataFrame:
    """A4: one row per attempt of each user's payload (``time`` -> ``time_spent``)."""
    ex = df.select("course_id", "user_id", *keep, F.explode(F.coalesce("scores", F.array())).alias("s"))
    return ex.where(F.col("s").isNotNull()).select(
        "user_id", "course_id", *keep, F.col("s.content_id").alias("content_id"),
        F.col("s.content_title").alias("content_title"),
        _z("s.score").alias("score"), _z("s.max_score").alias("max_score"),
        F.coalesce(F.col("s.percentage"), F.lit(0.0)).cast("decimal(5,2)").alias("percentage"),
        _z("s.opened").alias("opened"), _z("s.finished").alias("finished"), _z("s.time").alias("time_spent"),
        F.col("s.folder_id").alias("folder_id"), F.col("s.folder_name").alias("folder_name"),
        F.lit(fetched_at).cast("timestamp_ntz").alias("fetched_at"))


def h5p_summaries(df: DataFrame, *keep: str) -> DataFrame:
    """A4: one summary row per user's payload (``keep``: further columns to carry)."""
    return df.select(
        "user_id", "course_id", *keep,
        *[_z(f"summary.{c}").alias(c) for c in ("total_contents", "completed_contents", "total_score",
                                                 "total_max_score")],
        F.coalesce(F.col("summary.overall_percentage"), F.lit(0.0)).cast("decimal(5,2)").alias("overall_percentage"),
        _z("summary.total_time_spent").alias("total_time_spent"))


VIDEO_ITEM = _struct(content_id=L, content_title=S, progress_percent=D, current_time=L, duration=L, status=S,
                     folder_id=L, folder_name=S)
VIDEO_SUMMARY = _struct(total_videos=L, completed_videos=L, in_progress_videos=L, not_started_videos=L,
                        total_duration=L, total_watched_time=L, overall_progress=D)
VIDEO_PAYLOAD = _struct(video_progress=T.ArrayType(VIDEO_ITEM), summary=VIDEO_SUMMARY)


def flatten_video(spark: SparkSession, root: str, fetched_at: str) -> tuple[DataFrame, DataFrame]:
    """A5 from landed files: (position rows, summary rows)."""
    df = _per_user(spark, root, "video", VIDEO_PAYLOAD)
    return video_positions(df, fetched_at), video_summaries(df)


def video_positions(df: DataFrame, fetched_at: str, *keep: str) -> DataFrame:
    """A5: one row per video of each user's payload."""
    ex = df.select("course_id", "user_id", *keep, F.explode(F.coalesce("video_progress", F.array())).alias("v"))
    return ex.where(F.col("v").isNotNull()).select(
        "user_id", "course_id", *keep, F.col("v.content_id").alias("content_id"),
        F.col("v.content_title").alias("content_title"),
        F.coalesce(F.col("v.progress_percent"), F.lit(0.0)).cast("decimal(5,2)").alias("progress_percent"),
        _z("v.current_time").alias("current_time"), _z("v.duration").alias("duration"),
        F.col("v.status").alias("status"), F.col("v.folder_id").alias("folder_id"),
        F.col("v.folder_name").alias("folder_name"), F.lit(fetched_at).cast("timestamp_ntz").alias("fetched_at"))


def video_summaries(df: DataFrame, *keep: str) -> DataFrame:
    """A5: one summary row per user's payload."""
    return df.select(
        "user_id", "course_id", *keep,
        *[_z(f"summary.{c}").alias(c) for c in ("total_videos", "completed_videos", "in_progress_videos",
                                                 "not_started_videos", "total_duration", "total_watched_time")],
        F.coalesce(F.col("summary.overall_progress"), F.lit(0.0)).cast("decimal(5,2)").alias("overall_progress"))


# --- A6 / A7 -----------------------------------------------------------------------------

COMBINED = _struct(
    overall=_struct(total_items=L, completed_items=L, overall_completion=D),
    scores=_struct(total_contents=L, completed_contents=L, total_score=L, total_max_score=L,
                   average_percentage=D, total_time_spent=L),
    video_progress=_struct(total_videos=L, completed_videos=L, in_progress_videos=L, average_progress=D))
DASHBOARD = _struct(
    overview=_struct(overall_completion=D, total_items=L, completed_items=L, items_to_complete=L),
    h5p_stats=_struct(total_contents=L, completed_contents=L, total_score=L, total_max_score=L,
                      average_percentage=D, total_time_spent=L),
    video_stats=_struct(total_videos=L, completed_videos=L, in_progress_videos=L, average_video_progress=D),
    folder_scores_stats=_struct(total_folders=L, completed_folders=L, average_folder_percentage=D))

DASH_COLS = ["user_id", "course_id", "overall_completion", "total_items", "completed_items", "items_to_complete",
             "h5p_total_contents", "h5p_completed_contents", "h5p_total_score", "h5p_total_max_score",
             "h5p_average_percentage", "h5p_total_time_spent", "video_total_videos", "video_completed_videos",
             "video_in_progress_videos", "video_average_progress", "folder_total_folders",
             "folder_completed_folders", "folder_average_percentage"]


def flatten_combined(spark: SparkSession, root: str) -> DataFrame:
    return combined_rows(_per_user(spark, root, "combined", COMBINED))


def combined_rows(df: DataFrame, *keep: str) -> DataFrame:
    """Combined-progress payload -> ``dashboard_summary``;
    items_to_complete = max(0, total - completed); folder stats 0."""
    tot, done = _z("overall.total_items"), _z("overall.completed_items")
    return df.select(
        "user_id", "course_id", *keep, F.coalesce(F.col("overall.overall_completion"), F.lit(0.0)).alias("overall_completion"),
        tot.alias("total_items"), done.alias("completed_items"),
        F.greatest(F.lit(0).cast("bigint"), tot - done).alias("items_to_complete"),
        _z("scores.total_contents").alias("h5p_total_contents"),
        _z("scores.completed_contents").alias("h5p_completed_contents"),
        _z("scores.total_score").alias("h5p_total_score"), _z("scores.total_max_score").alias("h5p_total_max_score"),
        _z("scores.average_percentage", "double").alias("h5p_average_percentage"),
        _z("scores.total_time_spent").alias("h5p_total_time_spent"),
        _z("video_progress.total_videos").alias("video_total_videos"),
        _z("video_progress.completed_videos").alias("video_completed_videos"),
        _z("video_progress.in_progress_videos").alias("video_in_progress_videos"),
        _z("video_progress.average_progress", "double").alias("video_average_progress"),
        F.lit(0).cast("bigint").alias("folder_total_folders"), F.lit(0).cast("bigint").alias("folder_completed_folders"),
        F.lit(0.0).alias("folder_average_percentage"))


def flatten_dashboard(spark: SparkSession, root: str) -> DataFrame:
    return dashboard_rows(_per_user(spark, root, "dashboard", DASHBOARD))


def dashboard_rows(df: DataFrame, *keep: str) -> DataFrame:
    """The older dashboard payload -> the same table."""
    return df.select(
        "user_id", "course_id", *keep, _z("overview.overall_completion", "double").alias("overall_completion"),
        _z("overview.total_items").alias("total_items"), _z("overview.completed_items").alias("completed_items"),
        _z("overview.items_to_complete").alias("items_to_complete"),
        _z("h5p_stats.total_contents").alias("h5p_total_contents"),
        _z("h5p_stats.completed_contents").alias("h5p_completed_contents"),
        _z("h5p_stats.total_score").alias("h5p_total_score"),
        _z("h5p_stats.total_max_score").alias("h5p_total_max_score"),
        _z("h5p_stats.average_percentage", "double").alias("h5p_average_percentage"),
        _z("h5p_stats.total_time_spent").alias("h5p_total_time_spent"),
        _z("video_stats.total_videos").alias("video_total_videos"),
        _z("video_stats.completed_videos").alias("video_completed_videos"),
        _z("video_stats.in_progress_videos").alias("video_in_progress_videos"),
        _z("video_stats.average_video_progress", "double").alias("video_average_progress"),
        _z("folder_scores_stats.total_folders").alias("folder_total_folders"),
        _z("folder_scores_stats.completed_folders").alias("folder_completed_folders"),
        _z("folder_scores_stats.average_folder_percentage", "double").alias("folder_average_percentage"))


def dashboard_summary(combined: DataFrame, older: DataFrame) -> DataFrame:
    """A6 first, A7 only for users without an A6 payload (the fallback)."""
    keys = ["user_id", "course_id"]
    return combined.select(*DASH_COLS).unionByName(older.join(combined.select(*keys), keys, "left_anti")
                                                   .select(*DASH_COLS))


# --- A8 / A9 / A10 ------------------------------------------------------------------------

GRADES = _struct(students=T.ArrayType(_struct(user_id=L, username=S, email=S, full_name=S, percent_grade=D,
                                               grade_percentage=D, is_passed=B)))
PROGRESS = _struct(students=T.ArrayType(_struct(user_id=L, current_chapter=S, current_section=S, current_unit=S,
                                                 completion_rate=D, last_activity=S)))
DISCUSSIONS = _struct(students=T.ArrayType(_struct(user_id=L, username=S, email=S, full_name=S, threads_count=L,
                                                    comments_count=L, total_interactions=L, questions_count=L,
                                                    total_upvotes=L)))


def students_of(df: DataFrame, *keep: str) -> DataFrame:
    """Explode a ``{students: [...]}`` payload frame (needs ``course_id``)."""
    return df.select("course_id", *keep, F.explode(F.coalesce("students", F.array())).alias("s")) \
        .where(F.col("s").isNotNull() & F.col("s.user_id").isNotNull()).select("course_id", *keep, "s.*")


def _students(spark, root, kind, schema):
    return students_of(_read(spark, root, kind, schema))


def grades_rows(s: DataFrame, *keep: str) -> DataFrame:
    passed = F.coalesce("is_passed", F.lit(False))
    return s.select("user_id", "course_id", *keep, "username", "email", "full_name",
                    _z("percent_grade", "double").cast("decimal(5,2)").alias("percent_grade"),
                    _z("grade_percentage", "double").cast("decimal(5,2)").alias("grade_percentage"),
                    F.when(passed, F.lit("Pass")).otherwise(F.lit("")).alias("letter_grade"),
                    passed.alias("is_passed"))


def progress_rows(s: DataFrame, *keep: str) -> DataFrame:
    return s.select("user_id", "course_id", *keep, "current_chapter", "current_section", "current_unit",
                    _z("completion_rate", "double").cast("decimal(5,2)").alias("completion_rate"),
                    parse_ts("last_activity").alias("last_activity"))


def discussion_rows(s: DataFrame, *keep: str) -> DataFrame:
    return s.select("user_id", "course_id", *keep, "username", "email", "full_name",
                    *[_z(c).alias(c) for c in ("threads_count", "comments_count", "total_interactions",
                                               "questions_count", "total_upvotes")])


def flatten_grades(spark: SparkSession, root: str) -> DataFrame:
    """``letter_grade = 'Pass' if is_passed else ''`` (missing flag = False)."""
    return grades_rows(_students(spark, root, "grades", GRADES))


def flatten_progress(spark: SparkSession, root: str) -> DataFrame:
    """Progress rows with ``last_activity`` parsed by A12."""
    return progress_rows(_students(spark, root, "progress", PROGRESS))


def flatten_discussions(spark: SparkSession, root: str) -> DataFrame:
    """A10: forum counts, missing counts 0."""
    return discussion_rows(_students(spark, root, "discussions", DISCUSSIONS))



# --- A11 ------------------------------------------------------------------------------------

STATS_ACT = _struct(success=B, summary=_struct(avg_score=D, total_activities=L, total_active_users=L))
STATS_ASMT = _struct(success=B, summary=_struct(avg_score=D, unique_students=L, total_attempts=L))
STATS_PROG = _struct(success=B, summary=_struct(avg_progress=D, completion_rate=D, total_students=L))


STATS = {"stats_activity": STATS_ACT, "stats_assessment": STATS_ASMT, "stats_progress": STATS_PROG}


def benchmarks_from_stats(spark: SparkSession, root: str) -> DataFrame:
    return stats_benchmarks(_read(spark, root, "stats_activity", STATS_ACT),
                            _read(spark, root, "stats_assessment", STATS_ASMT),
                            _read(spark, root, "stats_progress", STATS_PROG))


def stats_benchmarks(activity: DataFrame, assessment: DataFrame, progress: DataFrame) -> DataFrame:
    """Course benchmarks from the three stats payloads (full outer join
    on course); per-user averages rounded to 2 only when the denominator > 0;
    total students = max(assessment, progress).  Columns the payloads do not
    carry stay 0, as the reference stores them."""
    a = activity.where(F.col("success")).select(
        "course_id", _z("summary.avg_score", "double").alias("activity_avg_score"),
        _z("summary.total_activities").alias("activity_total_activities"),
        _z("summary.total_active_users").alias("active_students"))
    s = assessment.where(F.col("success")).select(
        "course_id", _z("summary.avg_score", "double").alias("assessment_avg_score"),
        _z("summary.unique_students").alias("asmt_students"), _z("summary.total_attempts").alias("total_attempts"))
    p = progress.where(F.col("success")).select(
        "course_id", _z("summary.avg_progress", "double").alias("progress_avg_completion"),
        _z("summary.completion_rate", "double").alias("progress_completion_rate"),
        _z("summary.total_students").alias("prog_students"))
    j = a.join(s, "course_id", "full_outer").join(p, "course_id", "full_outer")

    def r2(num, den):
        return F.when(den > 0, F.round(num.cast("decimal(20,0)") / den, 2)).otherwise(F.lit(0)).cast("double")

    active = F.coalesce("active_students", F.lit(0))
    asmt = F.coalesce("asmt_students", F.lit(0))
    zero = F.lit(0.0)
    return j.select(
        "course_id", F.coalesce("activity_avg_score", zero).alias("activity_avg_score"),
        F.coalesce("activity_total_activities", F.lit(0)).alias("activity_total_activities"),
        r2(F.coalesce("activity_total_activities", F.lit(0)), active).alias("activity_avg_per_user"),
        F.coalesce("assessment_avg_score", zero).alias("assessment_avg_score"),
        r2(F.coalesce("total_attempts", F.lit(0)), asmt).alias("assessment_avg_attempts"),
        zero.alias("assessment_pass_rate"),
        F.coalesce("progress_avg_completion", zero).alias("progress_avg_completion"),
        zero.alias("progress_median_completion"),
        F.coalesce("progress_completion_rate", zero).alias("progress_completion_rate"),
        zero.alias("video_avg_completion"), F.lit(0).cast("bigint").alias("video_avg_watch_time"),
        zero.alias("discussion_avg_interactions"), zero.alias("discussion_participation_rate"),
        F.greatest(asmt, F.coalesce("prog_students", F.lit(0))).alias("total_students"),
        active.alias("active_students"))


def distinct_users(enroll: DataFrame) -> DataFrame:
    """The user list the per-user fetch loops over."""
    return enroll.select("course_id", "user_id").where(F.col("user_id").isNotNull()).distinct()


def limit_users(users: DataFrame, n: int) -> DataFrame:
    """``max_users`` cap — the first ``n`` users per course in id order
    (a feature of the fetch CLI; plans as a per-course WindowGroupLimit)."""
    from pyspark.sql import Window
    w = Window.partitionBy("course_id").orderBy("user_id")
    return users.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
