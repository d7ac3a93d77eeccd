"""Course-level aggregates (survey D1, D2, D11–D13, D17–D21, D25, D28).

Every aggregate is ``groupBy(...).agg`` with partial (map-side) aggregation,
so a course holding a third of all rows still only sends one partial row per
task across the shuffle.  Shares of a total are computed by joining a tiny
course-level aggregate back, never by a window over a whole course.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import attach, settle, shard_of
from ..functions.expr import LEVELS, display_score, risk_level
from .roster import KEYS, latest_only


def _cnt(cond):
    return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")


def course_list(f: DataFrame, approx: bool = False) -> DataFrame:
    """Courses with their distinct student count."""
    n = F.approx_count_distinct("user_id") if approx else F.countDistinct("user_id")
    return f.groupBy("course_id").agg(n.cast("bigint").alias("student_count"))


def course_stats(f: DataFrame, p: DataFrame, count_in_progress: bool = False) -> DataFrame:
    """D2 for all courses at once (features ⟕ latest predictions, C4).

    Literal reference semantics (Q4): ``passed != 1`` is NULL for in-progress
    students, so they are in no risk count; unscored students are in none
    either but weigh 50 in the average.  ``count_in_progress=True`` uses
    ``IS DISTINCT FROM 1`` as the docs intend.
    """
    pp = latest_only(p).select(*KEYS, "fail_risk_score")
    j = f.select(*KEYS, "mooc_grade_percentage", "mooc_completion_rate", "mooc_is_passed") \
        .join(pp, KEYS, "left")
    s, passed = F.col("fail_risk_score"), F.col("mooc_is_passed")
    open_ = passed.isNull() | ~passed if count_in_progress else ~passed
    return j.groupBy("course_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("total_students"),
        F.coalesce(F.avg(F.coalesce(s, F.lit(50.0))), F.lit(0.0)).alias("avg_risk_score"),
        F.coalesce(F.avg(F.col("mooc_grade_percentage").cast("double")), F.lit(0.0)).alias("avg_grade"),
        F.coalesce(F.avg(F.col("mooc_completion_rate").cast("double")), F.lit(0.0)).alias("avg_completion_rate"),
        _cnt((s >= 70) & open_).alias("high_risk_count"),
        _cnt((s >= 40) & (s < 70) & open_).alias("medium_risk_count"),
        _cnt((s < 40) & open_).alias("low_risk_count"),
        _cnt(passed).alias("completed_count"),
        _cnt(~passed).alias("not_passed_count"),
        _cnt(passed.isNull()).alias("in_progress_count"),
    )


def stat_cards(stats: DataFrame) -> DataFrame:
    """Shares shown by the cards and the donut, and the warning flags."""
    t = F.col("total_students")
    risk_total = F.col("high_risk_count") + F.col("medium_risk_count") + F.col("low_risk_count")

    def share(c, den):
        return F.coalesce(F.try_divide(F.col(c) * 100.0, F.nullif(den, F.lit(0))), F.lit(0.0))

    return stats.select(
        "course_id", "total_students",
        share("completed_count", t).cast("double").alias("completed_share"),
        share("not_passed_count", t).cast("double").alias("not_passed_share"),
        share("in_progress_count", t).cast("double").alias("in_progress_share"),
        share("high_risk_count", risk_total).cast("double").alias("high_share"),
        share("medium_risk_count", risk_total).cast("double").alias("medium_share"),
        share("low_risk_count", risk_total).cast("double").alias("low_share"),
        (F.col("avg_risk_score") > 50).alias("risk_warning"),
        (F.col("avg_grade") < 50).alias("grade_warning"),
        (F.col("avg_completion_rate") < 50).alias("completion_warning"),
    )


def risk_distribution(p: DataFrame, by_course: bool = True, latest: bool = True) -> DataFrame:
    """Count and percent per risk level; all three levels always present.

    Per-course totals are a groupBy joined back, not a window over a course.
    """
    src = latest_only(p) if latest else p
    src = src.withColumn("level", risk_level("fail_risk_score"))
    keys = ["course_id"] if by_course else []
    counts = src.groupBy(*keys, "level").agg(F.count(F.lit(1)).alias("n"))
    totals = src.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    # Three fixed levels per group, generated in place (no join needed).
    grid = totals.withColumn("level", F.explode(F.array(*[F.lit(x) for x in LEVELS])))
    out = grid.join(counts, keys + ["level"], "left")
    n = F.coalesce(F.col("n"), F.lit(0)).cast("bigint")
    return out.select(*keys, F.col("level").alias("risk_level"), n.alias("student_count"),
                      F.round(n * 100.0 / F.col("total"), 1).cast("double").alias("percent"))


def prediction_profile(p: DataFrame) -> DataFrame:
    """Count, min, max, avg and distinct scores of latest predictions."""
    return latest_only(p).groupBy("course_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("total"),
        F.min("fail_risk_score").alias("min_risk"),
        F.max("fail_risk_score").alias("max_risk"),
        F.avg("fail_risk_score").alias("avg_risk"),
        F.countDistinct("fail_risk_score").cast("bigint").alias("unique_scores"),
    )


def feature_health(f: DataFrame) -> DataFrame:
    """Rows, rows with exercises, average exercise score and weeks."""
    return f.groupBy("course_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("total"),
        _cnt(F.col("h5p_total_score") > 0).alias("with_h5p"),
        F.avg(F.col("h5p_total_score").cast("double")).alias("avg_h5p_score"),
        F.avg(F.col("weeks_since_enrollment").cast("double")).alias("avg_weeks"),
    )


def feature_stats(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """Mean and sample std of key features (one row per group)."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"{c}_mean"), F.stddev_samp(x).alias(f"{c}_std")]
    return df.groupBy(*(by or [])).agg(*aggs)


def grade_consistency(g: DataFrame) -> DataFrame:
    """D18 (+E5): count and percent of total per (course, passed, letter).

    The percent is of the course total: a course-level groupBy joined back
    instead of ``SUM(COUNT(*)) OVER ()`` over one partition.
    """
    c = g.groupBy("course_id", "is_passed", "letter_grade").agg(F.count(F.lit(1)).alias("cnt"))
    t = g.groupBy("course_id").agg(F.count(F.lit(1)).alias("course_total"))
    return c.join(t, "course_id").select(
        "course_id", "is_passed", "letter_grade", F.col("cnt").cast("bigint").alias("count"),
        F.concat(F.round(F.col("cnt") * 100.0 / F.col("course_total"), 2).cast("decimal(10,2)").cast("string"),
                 F.lit("%"))
         .alias("percentage"))


def grade_anomalies(g: DataFrame) -> DataFrame:
    """Passed without 'Pass', or failed with a non-blank letter.  The
    second branch is written ``NOT IN ('', NULL)`` in the reference and can
    never be true (Q9); kept literally."""
    passed, letter = F.col("is_passed"), F.col("letter_grade")
    first = passed & (letter.isNull() | (letter != "Pass"))
    second = (~passed) & ~(letter.isin(F.lit(""), F.lit(None).cast("string")))
    return g.where(first | second).select("user_id", "course_id", "is_passed", "letter_grade",
                                          "grade_percentage")


def missing_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """NULL count per column, per course."""
    return df.groupBy("course_id").agg(
        *[F.sum(F.col(c).isNull().cast("int")).cast("bigint").alias(f"{c}_missing") for c in cols])


def compare_models(p: DataFrame) -> DataFrame:
    """Per model — count, average score, HIGH count, first/last run."""
    return p.groupBy("model_name").agg(
        F.count(F.lit(1)).cast("bigint").alias("total_predictions"),
        F.avg("fail_risk_score").alias("avg_risk"),
        _cnt(F.col("risk_level") == "HIGH").alias("high_risk_count"),
        F.min("predicted_at").alias("first_prediction"),
        F.max("predicted_at").alias("last_prediction"),
    )


def prediction_freshness(p: DataFrame, as_of: str, stale_days: int = 7) -> DataFrame:
    """Last prediction per course and a stale flag (> 7 days)."""
    from ..functions.expr import floor_days
    last = latest_only(p).groupBy("course_id").agg(
        F.max("predicted_at").alias("last_prediction"),
        F.count(F.lit(1)).cast("bigint").alias("latest_rows"))
    age = floor_days("last_prediction", as_of)
    return last.select("*", age.alias("days_old"), (age > stale_days).alias("is_stale"))


def vs_class(f: DataFrame, metrics: list[str]) -> DataFrame:
    """Each student's metrics next to the class average and the gap.

    The rows are written once; the class average is a course-level groupBy
    (partial aggregation) that meets a big course's students in parts, so no
    task holds a course."""
    rows = settle(f.select(*KEYS, *metrics)).withColumn("__shard", shard_of(f.sparkSession, F.col("user_id")))
    avgs = rows.groupBy("course_id").agg(*[F.avg(F.col(m).cast("double")).alias(f"class_avg_{m}")
                                           for m in metrics])
    j = attach(rows, avgs, "course_id").drop("__shard")
    extra = [(F.col(m).cast("double") - F.col(f"class_avg_{m}")).alias(f"diff_{m}") for m in metrics]
    return j.select("*", *extra)


def quick_level_counts(base: DataFrame) -> DataFrame:
    """Per-course count of each display level (score or 50, Q2)."""
    lv = risk_level(display_score("fail_risk_score"))
    return base.groupBy("course_id").agg(*[_cnt(lv == x).alias(f"{x.lower()}_count") for x in LEVELS])
