"""Roster and student lookups (survey C1–C5, C12, B1–B7, B18, F1).

All joins are equi-joins on ``(user_id, course_id)``; Spark shuffles each
input once on that key and the three joins reuse the partitioning.  No side
is force-broadcast: feature, grade and prediction tables all grow with the
number of students; AQE turns a join into a broadcast only when a measured
side is below the threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import (completion_status, display_email, display_name,
                              display_score, nullif_blank, risk_level)

KEYS = ["user_id", "course_id"]

# Whitelisted sort keys of the roster route and their columns.
SORT_COLUMNS = {
    "risk_score": "raw_risk_score",
    "name": "full_name",
    "grade": "mooc_grade_percentage",
    "last_activity": "days_since_last_activity",
}


def latest_only(p: DataFrame) -> DataFrame:
    """``p.is_latest = TRUE`` written into the join condition."""
    return p.where(F.col("is_latest"))


def in_course(df: DataFrame, course_id: str | None) -> DataFrame:
    """B1: course predicate (pushed into the scans by Catalyst)."""
    return df if course_id is None else df.where(F.col("course_id") == course_id)


def risk_band(df: DataFrame, level: str | None, score_col: str = "raw_risk_score") -> DataFrame:
    """B2: filter on the *raw* score, so unscored students drop out (Q3)."""
    s = F.col(score_col)
    cond = {"HIGH": s >= 70, "MEDIUM": (s >= 40) & (s < 70), "LOW": s < 40}.get(level)
    return df if cond is None else df.where(cond)


def not_completed(df: DataFrame, passed: str = "mooc_is_passed") -> DataFrame:
    """``passed IS NULL OR passed = 0``."""
    return df.where(F.col(passed).isNull() | ~F.col(passed))


def completion_filter(df: DataFrame, mode: str = "not_completed",
                      status_col: str = "completion_status") -> DataFrame:
    """ALL / completed / not_completed (default not_completed)."""
    if mode == "completed":
        return df.where(F.col(status_col) == "completed")
    if mode == "not_completed":
        return df.where(F.col(status_col) != "completed")
    return df


#: Names compare as in the application's database: case, accents and trailing blanks don't count.
NAME_COLLATION = "UNICODE_CI_AI"


def search(df: DataFrame, q: str | None) -> DataFrame:
    """Substring of name or e-mail, blind to case and accents (Q12), or substring of the id."""
    if not q:
        return df
    wanted = F.collate(F.lit(q), NAME_COLLATION)

    def has(c):
        return F.contains(F.collate(F.coalesce(F.col(c), F.lit("")), NAME_COLLATION), wanted)
    return df.where(has("full_name") | has("email") | F.col("user_id").cast("string").contains(q))


def by_unit(df: DataFrame, department: str | None = None, class_code: str | None = None) -> DataFrame:
    """Department / class filter."""
    if department is not None:
        df = df.where(F.col("department") == department)
    if class_code is not None:
        df = df.where(F.col("class_code") == class_code)
    return df


def sort_roster(df: DataFrame, by: str = "risk_score", order: str = "desc") -> DataFrame:
    """Whitelisted key, fallback risk/desc; NULL first ascending and
    last descending (MySQL's order), ``user_id`` as the tie-break (Q20).  Names are
    ordered blind to case, accents and trailing blanks (Q12)."""
    c = F.col(SORT_COLUMNS.get(by, SORT_COLUMNS["risk_score"]))
    if by == "name":
        c = F.collate(c, f"{NAME_COLLATION}_RTRIM")
    o = c.desc_nulls_last() if order.lower() != "asc" else c.asc_nulls_first()
    return df.orderBy(o, F.col("course_id"), F.col("user_id"))


def roster(f: DataFrame, e: DataFrame, g: DataFrame, p: DataFrame,
           risk: str | None = None, how: str = "left") -> DataFrame:
    """C1 (and C12 with ``how='inner'``): one row per feature row, every course.

    ``fail_risk_score`` is ``COALESCE(score, 50)`` as the SQL returns it;
    ``risk_level`` uses ``score or 50`` (Q2), ``raw_risk_score`` keeps NULL
    for filters and sorting (Q3).
    """
    ee = e.select(*KEYS, "email", "full_name", "full_name_vn", "username", "mssv")
    gg = g.select(*KEYS, F.col("email").alias("g_email"), F.col("full_name").alias("g_full_name"))
    pp = latest_only(p).select(*KEYS, "fail_risk_score", "model_name", "predicted_at")
    ff = f.select(*KEYS, "mooc_grade_percentage", "mooc_completion_rate",
                  "days_since_last_activity", "mooc_is_passed")
    if how == "inner":
        j = ee.join(ff, KEYS, "inner")
    else:
        j = ff.join(ee, KEYS, "left")
    j = j.join(gg, KEYS, "left").join(pp, KEYS, "left")
    score = F.coalesce(F.col("fail_risk_score"), F.lit(50.0))
    out = j.select(
        *KEYS,
        display_email("email", "g_email").alias("email"),
        display_name("full_name_vn", "full_name", "g_full_name").alias("full_name"),
        "username", "mssv",
        score.alias("fail_risk_score"),
        F.col("fail_risk_score").alias("raw_risk_score"),
        "mooc_grade_percentage", "mooc_completion_rate", "days_since_last_activity",
        "mooc_is_passed", "model_name", "predicted_at",
        risk_level(display_score(score)).alias("risk_level"),
        completion_status("mooc_is_passed").alias("completion_status"),
    )
    return risk_band(out, risk)


def student_detail(f: DataFrame, e: DataFrame, g: DataFrame, p: DataFrame, disc: DataFrame | None = None,
                   on_demand: DataFrame | None = None) -> DataFrame:
    """C2 for every student: feature row + identity + latest prediction and the
    route's numeric normalisation.  A student without a prediction gets the score
    of ``on_demand`` (user_id, course_id, fail_risk_score: the scorer's output for
    such students), else 50/MEDIUM.  ``disc`` gives the forum interactions."""
    from .suggestions import suggestions

    ee = e.select(*KEYS, "email", "full_name", "full_name_vn", "username", "mssv")
    gg = g.select(*KEYS, F.col("email").alias("g_email"), F.col("full_name").alias("g_full_name"))
    pp = latest_only(p).select(*KEYS, F.col("fail_risk_score").alias("p_score"),
                               F.col("risk_level").alias("p_level"), "model_name", "predicted_at")
    j = f.join(ee, KEYS, "left").join(gg, KEYS, "left").join(pp, KEYS, "left")
    if on_demand is not None:
        now = on_demand.select(*KEYS, F.col("fail_risk_score").cast("double").alias("_now"))
        j = j.join(now, KEYS, "left").withColumns({
            "p_level": F.when(F.col("p_score").isNull(), risk_level("_now")).otherwise(F.col("p_level")),
            "p_score": F.coalesce("p_score", "_now")})
    if disc is not None:
        j = j.join(disc.select(*KEYS, F.col("total_interactions").alias("_forum")), KEYS, "left")
    else:
        j = j.withColumn("_forum", F.lit(0))
    score = display_score("p_score")
    base = j.select(
        *KEYS,
        display_name("full_name_vn", "full_name", "g_full_name").alias("full_name"),
        display_email("email", "g_email").alias("email"),
        "username", "mssv",
        score.alias("fail_risk_score"),
        F.when(F.col("p_score").isNull(), F.lit("MEDIUM"))
         .otherwise(F.coalesce(F.col("p_level"), F.lit("MEDIUM"))).alias("risk_level"),
        F.coalesce(F.col("mooc_grade_percentage").cast("double"), F.lit(0.0)).alias("mooc_grade_percentage"),
        F.coalesce(F.col("mooc_completion_rate").cast("double"), F.lit(0.0)).alias("mooc_completion_rate"),
        F.coalesce(F.col("days_since_last_activity"), F.lit(0)).cast("bigint").alias("days_since_last_activity"),
        F.coalesce(F.col("video_completion_rate").cast("double"), F.lit(0.0)).alias("video_completion_rate"),
        F.coalesce(F.col("quiz_avg_score").cast("double"), F.lit(0.0)).alias("quiz_avg_score"),
        F.coalesce(F.col("discussion_threads_count"), F.lit(0)).cast("bigint").alias("discussion_threads_count"),
        "model_name", "predicted_at", F.coalesce("_forum", F.lit(0)).alias("_forum"),
    )
    return base.withColumn("suggestions", suggestions(
        risk="risk_level", days="days_since_last_activity", grade="mooc_grade_percentage",
        completion="mooc_completion_rate", discussions="_forum",
        video="video_completion_rate", quiz="quiz_avg_score")).drop("_forum")


def at_risk_base(f: DataFrame, e: DataFrame, p: DataFrame) -> DataFrame:
    """Dashboard input — unfinished students with identity and latest score."""
    ee = e.select(*KEYS, "full_name_vn", "full_name", F.col("email").alias("e_email"))
    pp = latest_only(p).select(*KEYS, F.col("fail_risk_score").alias("p_score"),
                               F.col("risk_level").alias("p_level"), "predicted_at")
    ff = not_completed(f.select(*KEYS, "mooc_completion_rate", "days_since_last_activity",
                                "mooc_grade_percentage", "mooc_is_passed"))
    j = ff.join(ee, KEYS, "left").join(pp, KEYS, "left")
    # Fixed value: placeholder name of the dashboard query.
    placeholder = F.lit("Sinh viên")
    return j.select(
        *KEYS,
        F.coalesce(nullif_blank("full_name_vn"), nullif_blank("full_name"), placeholder).alias("full_name"),
        F.coalesce(nullif_blank("e_email"), F.lit("")).alias("email"),
        F.coalesce(F.col("p_score"), F.lit(50.0)).alias("fail_risk_score"),
        F.coalesce(F.col("p_score"), F.lit(0.0)).alias("order_score"),
        F.coalesce(F.col("p_level"), F.lit("MEDIUM")).alias("risk_level"),
        "mooc_completion_rate", "days_since_last_activity", "mooc_grade_percentage", "predicted_at",
    )


def scoring_input(raw: DataFrame, e: DataFrame) -> DataFrame:
    """Wide rows ⟕ enrollments (mode, active flag) for scoring."""
    ee = e.select(*KEYS, F.col("mode").alias("enrollment_mode"), F.col("is_active").alias("enrollment_active"))
    return raw.join(ee, KEYS, "left")


def student_features_lookup(f: DataFrame, user_id, course_id: str) -> DataFrame:
    """Features by key (a point lookup; pushed into the scan)."""
    return f.where((F.col("user_id") == F.lit(user_id)) & (F.col("course_id") == course_id))
