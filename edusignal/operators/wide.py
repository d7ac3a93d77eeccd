"""The wide feature row per (user, course) and its inputs
(survey C6, C7, I21–I34, D22).

The reference builds this row with about eleven queries per user inside a
Python loop.  Here it is one plan: the enrolment spine left-joined to each
rollup on ``(user_id, course_id)`` — Spark shuffles every input once on that
key and the chain of joins reuses the partitioning — plus one join on
``course_id`` to the course benchmarks, done in parts on the spine (a course may
hold a third of the students).

Python ``round(float, n)`` is done half-up on decimals (documented choice;
both oracle and engine agree on it).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import as_of_lit, floor_days, whole_weeks
from .skew import attach, shard_of
from .exercises import (SUMMARY_COLS, attempts_by_student, decimal_avg, h5p_rollup, h5p_user_rollup, video_views,
                        videos_by_student)

KEYS = ["user_id", "course_id"]


def r2(c, n: int = 2) -> F.Column:
    """round(x, n) half up on the decimal value, as double."""
    return F.round(c.cast("decimal(38,10)"), n).cast("double")


def ratio_pct(num, den) -> F.Column:
    """round(num / den * 100, 2), 0 when den is 0 or missing."""
    n, d = F.coalesce(num, F.lit(0)), F.coalesce(den, F.lit(0))
    return F.when(d > 0, F.round(n.cast("decimal(38,0)") * F.lit(100).cast("decimal(3,0)")
                                 / d.cast("decimal(38,0)"), 2).cast("double")).otherwise(F.lit(0.0))


# --- C6 ------------------------------------------------------------------------------

def populate_features(e: DataFrame, g: DataFrame, h: DataFrame, as_of: str) -> DataFrame:
    """Enrolments ⟕ grades ⟕ per-user exercise aggregate (D8), with the
    populate job's defaults (pass flag NULL -> 0, weeks by truncation)."""
    agg = h5p_rollup(h)
    gg = g.select(*KEYS, "grade_percentage", "letter_grade", "is_passed")
    j = e.select(*KEYS, "mode", "is_active", "created").join(gg, KEYS, "left").join(agg, KEYS, "left")
    stamp = F.date_format(as_of_lit(as_of), "yyyyMMdd_HHmmss")
    return j.select(
        *KEYS, F.col("mode").alias("enrollment_mode"), "is_active",
        whole_weeks("created", as_of).alias("weeks_since_enrollment"),
        F.coalesce(F.col("grade_percentage").cast("double"), F.lit(0.0)).alias("mooc_grade_percentage"),
        F.col("letter_grade").alias("mooc_letter_grade"),
        F.coalesce(F.col("is_passed"), F.lit(False)).alias("mooc_is_passed"),
        F.coalesce("total_contents", F.lit(0)).cast("bigint").alias("h5p_total_contents"),
        F.coalesce("completed_contents", F.lit(0)).cast("bigint").alias("h5p_completed_contents"),
        F.coalesce("total_score", F.lit(0)).cast("bigint").alias("h5p_total_score"),
        F.coalesce("total_max_score", F.lit(0)).cast("bigint").alias("h5p_total_max_score"),
        F.coalesce("avg_percentage", F.lit(0.0)).alias("h5p_overall_percentage"),
        F.coalesce("total_time_spent", F.lit(0)).cast("bigint").alias("h5p_total_time_spent"),
        F.when(F.col("total_contents") > 0, F.col("completed_contents") * 100.0 / F.col("total_contents"))
         .otherwise(F.lit(0)).cast("double").alias("h5p_completion_rate"),
        F.concat(F.lit("populate_"), stamp).alias("extraction_batch_id"),
        as_of_lit(as_of).alias("updated_at"),
    )


# --- D22 --------------------------------------------------------------------------------

def benchmarks_from_tables(e: DataFrame, h: DataFrame, prog: DataFrame, vsum: DataFrame,
                           disc: DataFrame, g: DataFrame) -> DataFrame:
    """The benchmark columns computed from our own tables, one row per
    course (each source aggregated by course, then full-outer joined)."""
    ex = attempts_by_student(h).groupBy("course_id").agg(
        F.round(decimal_avg(F.sum("cents"), F.sum("n_pct")), 2).cast("double").alias("activity_avg_score"),
        F.sum("n_rows").alias("activity_total_activities"),
        F.when(F.sum("n_fin") > 0, F.round(decimal_avg(F.sum("fin_cents"), F.sum("n_fin")), 2))
         .cast("double").alias("assessment_avg_score"),
        F.count(F.lit(1)).alias("_ex_students"))
    en = e.groupBy("course_id").agg(
        F.count(F.lit(1)).alias("total_students"),
        F.sum(F.col("is_active").cast("int")).alias("active_students"))
    pr = prog.groupBy("course_id").agg(
        F.round(F.avg("completion_rate"), 2).cast("double").alias("progress_avg_completion"),
        F.round(F.median(F.col("completion_rate").cast("double")).cast("decimal(38,10)"), 2).cast("double")
         .alias("progress_median_completion"),
        F.round(F.avg((F.col("completion_rate") >= 100).cast("int").cast("decimal(10,0)")) * 100, 2)
         .cast("double").alias("progress_completion_rate"))
    user_rate = F.when(F.col("total_videos") > 0, F.round(
        F.col("completed_videos").cast("decimal(20,0)") * 100 / F.col("total_videos").cast("decimal(20,0)"), 2))
    vi = vsum.groupBy("course_id").agg(
        F.round(F.avg(user_rate), 2).cast("double").alias("video_avg_completion"),
        F.avg("total_watched_time").cast("bigint").alias("video_avg_watch_time"))
    di = disc.groupBy("course_id").agg(
        F.round(F.avg(F.col("total_interactions").cast("decimal(20,0)")), 2).cast("double")
         .alias("discussion_avg_interactions"),
        F.sum((F.col("total_interactions") > 0).cast("int")).alias("_disc_active"))
    gr = g.where(F.col("is_passed").isNotNull()).groupBy("course_id").agg(
        F.round(F.avg(F.col("is_passed").cast("int").cast("decimal(10,0)")) * 100, 2).cast("double")
         .alias("assessment_pass_rate"))
    j = (en.join(ex, "course_id", "full_outer").join(pr, "course_id", "full_outer")
           .join(vi, "course_id", "full_outer").join(di, "course_id", "full_outer")
           .join(gr, "course_id", "full_outer"))
    active = F.col("active_students")
    return j.select(
        "course_id",
        "activity_avg_score",
        F.coalesce("activity_total_activities", F.lit(0)).cast("bigint").alias("activity_total_activities"),
        F.when(active > 0, F.round(F.col("activity_total_activities").cast("decimal(20,0)") / active, 2))
         .otherwise(F.lit(0)).cast("double").alias("activity_avg_per_user"),
        "assessment_avg_score",
        F.when(F.col("_ex_students") > 0,
               F.round(F.col("activity_total_activities").cast("decimal(20,0)") / F.col("_ex_students"), 2))
         .otherwise(F.lit(0)).cast("double").alias("assessment_avg_attempts"),
        "assessment_pass_rate", "progress_avg_completion", "progress_median_completion",
        "progress_completion_rate", "video_avg_completion", "video_avg_watch_time",
        "discussion_avg_interactions",
        F.when(F.col("total_students") > 0,
               F.round(F.coalesce("_disc_active", F.lit(0)).cast("decimal(20,0)") * 100
                       / F.col("total_students"), 2)).otherwise(F.lit(0)).cast("double")
         .alias("discussion_participation_rate"),
        F.coalesce("total_students", F.lit(0)).cast("bigint").alias("total_students"),
        F.coalesce("active_students", F.lit(0)).cast("bigint").alias("active_students"),
    )


# --- C7 -----------------------------------------------------------------------------------

def comparative(user_problem, user_completion, user_video, user_discussion,
                c_problem, c_completion, c_video, c_discussion, has_bench) -> list[F.Column]:
    """Relative-to-course values, percentile bucket and flags."""
    cp = F.coalesce(c_problem, F.lit(0.0))
    cc = F.coalesce(c_completion, F.lit(0.0))
    cv = F.when(F.coalesce(c_video, F.lit(0.0)) != 0, c_video).otherwise(user_video)
    cd = F.coalesce(c_discussion, F.lit(0.0))
    rel_p = F.when(cp > 0, r2(user_problem - cp)).otherwise(F.lit(0.0))
    rel_c = F.when(cc > 0, r2(user_completion - cc)).otherwise(F.lit(0.0))
    rel_v = r2(user_video - cv)
    diff_d = user_discussion - cd
    rel_d = F.when(diff_d >= 0, F.floor(diff_d)).otherwise(F.ceil(diff_d)).cast("bigint")
    us = (user_completion * 0.4 + user_problem * 0.3
          + (user_video + F.least(user_discussion * 2, F.lit(100.0))) / 2 * 0.3)
    cs = cc * 0.4 + cp * 0.3 + cv * 0.3
    dev = (us - cs) / cs
    # Deviations from the course and their percentile buckets.
    pctl = (F.when(cs <= 0, F.lit(50)).when(dev > 0.5, F.lit(90)).when(dev > 0.25, F.lit(75))
            .when(dev > 0, F.lit(60)).when(dev > -0.25, F.lit(40)).when(dev > -0.5, F.lit(25))
            .otherwise(F.lit(10)))
    below = (us < cs).cast("int")
    cols = {
        "relative_to_course_problem_score": rel_p, "relative_to_course_completion": rel_c,
        "relative_to_course_video_completion": rel_v, "relative_to_course_discussion": rel_d,
        "performance_percentile": pctl, "is_below_course_average": below,
        "is_top_performer": (pctl >= 75).cast("int"), "is_bottom_performer": (pctl <= 25).cast("int"),
    }
    defaults = {"relative_to_course_problem_score": F.lit(0.0), "relative_to_course_completion": F.lit(0.0),
                "relative_to_course_video_completion": F.lit(0.0),
                "relative_to_course_discussion": F.lit(0).cast("bigint"), "performance_percentile": F.lit(50),
                "is_below_course_average": F.lit(0), "is_top_performer": F.lit(0), "is_bottom_performer": F.lit(0)}
    return [F.when(has_bench, v).otherwise(defaults[k]).alias(k) for k, v in cols.items()]


#: Where a student is in the course.
PLACE = ["current_chapter", "current_section", "current_unit"]


def build_raw(e: DataFrame, h: DataFrame, v: DataFrame, g: DataFrame, prog: DataFrame,
              disc: DataFrame, bench: DataFrame | None, as_of: str,
              dash: DataFrame | None = None, h5p_sums: DataFrame | None = None,
              video_sums: DataFrame | None = None) -> DataFrame:
    """One wide row per distinct enrolled (user, course), every course at once.

    Exercise and video totals come from the stored summary tables where given
    (``h5p_sums``, ``video_sums``), else they are summed from the detail rows;
    attempt metrics always come from the attempts.  Of several enrolments of a
    student in a course, the newest gives mode and state, the oldest the start."""
    newest = F.max(F.struct("created", "enrollment_id", "mode", "is_active"))
    spine = e.groupBy(*KEYS).agg(newest["mode"].alias("enrollment_mode"), newest["is_active"].alias("e_active"),
                                 F.min("created").alias("created"))
    if bench is not None:
        b = bench.select("course_id", F.col("assessment_avg_score").alias("b_problem"),
                         F.col("progress_avg_completion").alias("b_completion"),
                         F.col("video_avg_completion").alias("b_video"),
                         F.col("discussion_avg_interactions").alias("b_discussion"),
                         F.lit(True).alias("b_present"))
        # a course with a third of the students meets its row in parts, before the wide joins
        spine = attach(spine.withColumn("__shard", shard_of(e.sparkSession, F.col("user_id"))), b, "course_id").drop("__shard")
    else:
        spine = spine.withColumns({"b_problem": F.lit(None).cast("double"), "b_completion": F.lit(None).cast("double"),
                                   "b_video": F.lit(None).cast("double"), "b_discussion": F.lit(None).cast("double"),
                                   "b_present": F.lit(None).cast("boolean")})
    # exercise summary (D23) and attempt metrics (D9) from one pass over attempts
    rollup = h5p_user_rollup(h)
    if h5p_sums is not None:
        rollup = rollup.drop(*SUMMARY_COLS).join(h5p_sums.select(*KEYS, *SUMMARY_COLS), KEYS, "full_outer")
    hs = rollup.select(
        *KEYS, *[F.col(c).alias(f"hs_{c}") for c in SUMMARY_COLS],
        F.col("finished_count").alias("m_finished"), F.col("avg_finished_score").alias("m_avg_fin"),
        F.col("success_count").alias("m_success"), F.col("struggling_count").alias("m_struggling"),
        F.col("assessment_attempts_avg").alias("m_opened"))
    # video totals (D23) and views (D10): one table and one join, unless the totals are stored
    views = F.col("video_views").alias("m_views")
    vs = (videos_by_student(v) if video_sums is None else video_sums).select(*KEYS, *[F.col(c).alias(f"vs_{c}") for c in (
        "total_videos", "completed_videos", "in_progress_videos", "total_duration", "total_watched_time")],
        *([views] if video_sums is None else []))
    gd = g.select(*KEYS, F.col("grade_percentage").alias("g_grade"), F.col("letter_grade").alias("g_letter"),
                  F.col("is_passed").alias("g_passed"))
    place = [F.col(c) if c in prog.columns else F.lit(None).cast("string").alias(c) for c in PLACE]
    pd_ = prog.select(*KEYS, F.col("completion_rate").alias("p_rate"), F.col("last_activity").alias("p_last"), *place)
    dd = disc.select(*KEYS, *[F.col(c).alias(f"d_{c}") for c in (
        "threads_count", "comments_count", "total_interactions", "questions_count", "total_upvotes")])
    j = (spine.join(hs, KEYS, "left").join(vs, KEYS, "left").join(gd, KEYS, "left")
              .join(pd_, KEYS, "left").join(dd, KEYS, "left"))
    if video_sums is not None:
        j = j.join(video_views(v).select(*KEYS, views), KEYS, "left")
    if dash is not None:
        j = j.join(dash.select(*KEYS, F.col("overall_completion").alias("db_completion"),
                               F.col("completed_items").alias("db_completed"),
                               F.col("total_items").alias("db_total")), KEYS, "left")
    else:
        j = j.withColumns({"db_completion": F.lit(None).cast("double"), "db_completed": F.lit(None).cast("bigint"),
                           "db_total": F.lit(None).cast("bigint")})
    def z(c, t="bigint"):
        return F.coalesce(F.col(c), F.lit(0)).cast(t)

    is_active = F.coalesce(F.col("e_active"), F.lit(True))
    weeks = F.when(F.col("created").isNull(), F.lit(0.0)).otherwise(
        r2(floor_days("created", as_of).cast("double") / 7.0))
    days = F.when(F.col("p_last").isNull(), F.lit(999).cast("bigint")).otherwise(floor_days("p_last", as_of))
    h_total, h_done = z("hs_total_contents"), z("hs_completed_contents")
    v_total, v_done = z("vs_total_videos"), z("vs_completed_videos")
    use_dash = F.coalesce(F.col("db_completion"), F.lit(0)) != 0
    blocks_done = F.when(use_dash, z("db_completed")).otherwise(h_done + v_done)
    blocks_total = F.when(use_dash, z("db_total")).otherwise(h_total + v_total)
    overall = F.when(use_dash, F.col("db_completion").cast("double")).otherwise(ratio_pct(h_done + v_done,
                                                                                          h_total + v_total))
    h_rate = ratio_pct(h_done, h_total)
    v_rate = ratio_pct(v_done, v_total)
    comp = z("p_rate", "double")
    attempts = z("m_finished")
    success_rate = r2(z("m_success", "double") / F.greatest(attempts, F.lit(1)))
    items = attempts + z("m_views")
    active_days = F.when(items > 0, F.greatest(F.lit(1).cast("bigint"), F.floor(items / 4).cast("bigint"))) \
        .otherwise(F.lit(0).cast("bigint"))
    wk1 = F.greatest(weeks, F.lit(1.0))
    velocity = F.least(r2(comp / wk1), F.lit(999.99))
    dropout = (F.when(~is_active & (days > 30), F.lit(True))
               .when(is_active | (days < 7), F.lit(False)))
    quiz_avg = z("hs_overall_percentage", "double")
    disc_total = z("d_total_interactions")
    base = j.select(
        *KEYS, "enrollment_mode", is_active.alias("is_active"), weeks.alias("weeks_since_enrollment"),
        overall.alias("progress_percent"), overall.alias("overall_completion"),
        blocks_done.alias("completed_blocks"), blocks_total.alias("total_blocks"),
        h_total.alias("h5p_total_contents"), h_done.alias("h5p_completed_contents"),
        z("hs_total_score").alias("h5p_total_score"), z("hs_total_max_score").alias("h5p_total_max_score"),
        quiz_avg.alias("h5p_overall_percentage"), z("hs_total_time_spent").alias("h5p_total_time_spent"),
        h_rate.alias("h5p_completion_rate"),
        v_total.alias("video_total_videos"), v_done.alias("video_completed_videos"),
        z("vs_in_progress_videos").alias("video_in_progress_videos"),
        z("vs_total_duration").alias("video_total_duration"),
        z("vs_total_watched_time").alias("video_total_watched_time"),
        v_rate.alias("video_completion_rate"),
        ratio_pct(z("vs_total_watched_time"), z("vs_total_duration")).alias("video_watch_rate"),
        z("g_grade", "double").alias("mooc_grade_percentage"),
        F.coalesce(F.col("g_letter"), F.lit("")).alias("mooc_letter_grade"),
        F.col("g_passed").alias("mooc_is_passed"),
        comp.alias("mooc_completion_rate"), *[F.col(c) for c in PLACE], F.col("p_last").alias("last_activity"),
        days.alias("days_since_last_activity"),
        z("d_threads_count").alias("discussion_threads_count"),
        z("d_comments_count").alias("discussion_comments_count"),
        disc_total.alias("discussion_total_interactions"),
        z("d_questions_count").alias("discussion_questions_count"),
        z("d_total_upvotes").alias("discussion_total_upvotes"),
        h_done.alias("quiz_attempts"), quiz_avg.alias("quiz_avg_score"), h_rate.alias("quiz_completion_rate"),
        attempts.alias("problem_attempts"),
        r2(z("m_avg_fin", "double")).alias("problem_avg_score"),
        success_rate.alias("problem_success_rate"),
        F.least(r2(z("m_opened", "double")), F.lit(999.99)).alias("assessment_attempts_avg"),
        z("m_struggling").alias("struggling_assessments_count"),
        z("m_views").alias("video_views"),
        active_days.alias("active_days"),
        r2(active_days / wk1).alias("access_frequency"),
        F.when(days < 999, days).otherwise(F.lit(0).cast("bigint")).alias("max_inactive_gap_days"),
        velocity.alias("progress_velocity"),
        F.lit(0.0).alias("progress_acceleration"),
        F.when(velocity > 0, F.least(r2((100 - comp) / F.greatest(velocity, F.lit(0.01))), F.lit(999.99)))
         .alias("weeks_to_complete_estimate"),
        success_rate.alias("first_attempt_success_rate"),
        F.lit(0.0).alias("assessment_improvement_rate"),
        F.lit(0.0).alias("late_night_ratio"), F.lit(0.0).alias("weekend_ratio"),
        F.col("g_passed").alias("is_passed"), dropout.alias("is_dropout"),
        F.lit(None).cast("double").alias("fail_risk_score"),
        *comparative(quiz_avg, comp, v_rate, disc_total.cast("double"), F.col("b_problem").cast("double"),
                     F.col("b_completion").cast("double"), F.col("b_video").cast("double"),
                     F.col("b_discussion").cast("double"), F.coalesce(F.col("b_present"), F.lit(False))),
        as_of_lit(as_of).alias("extracted_at"),
    )
    return base


def refreshed(changed: DataFrame, e: DataFrame, h: DataFrame, v: DataFrame, g: DataFrame, prog: DataFrame, disc: DataFrame,
              bench: DataFrame | None, as_of: str, **stored: DataFrame) -> DataFrame:
    """C7 for the students of ``changed`` (user_id, course_id) alone: every detail table is cut to them by a semi join before
    anything is summed or joined.  Upserted into the stored rows (:func:`..sources.buckets.upsert_buckets`) this gives what a
    full rebuild with the same benchmarks gives."""
    keys = changed.select(*KEYS).distinct()

    def only(df: DataFrame | None) -> DataFrame | None:
        return None if df is None else df.join(keys, KEYS, "left_semi")
    return build_raw(*(only(x) for x in (e, h, v, g, prog, disc)), bench, as_of, **{k: only(x) for k, x in stored.items()})
