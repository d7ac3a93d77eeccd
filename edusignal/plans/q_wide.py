"""Wide-row queries: populate (C6), benchmarks (D22), the wide row."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import wide as W
from ..operators.exercises import attempts_by_student, h5p_rollup, video_summary, videos_by_student
from ..operators.skew import settle
from ..session import ensure_checkpoint_dir
from ..sources import payloads as PL
from ..sources.buckets import read_buckets, upsert_buckets
from .contract import hdiv
from .base import AS_OF, avg_round, hround, register


def _bench(d, attempts=None, videos=None):
    return W.benchmarks_from_tables(d.enrollments, d.h5p_scores if attempts is None else attempts, d.mooc_progress,
                                    video_summary(d.video_progress if videos is None else videos), d.mooc_discussions, d.mooc_grades)


def wide_rows(d, bench: bool = True, **stored):
    """C7 for every student; the attempts and positions are summed by student once, for totals, metrics and benchmarks."""
    attempts, videos = settle(attempts_by_student(d.h5p_scores)), d.video_progress
    if bench:
        videos = settle(videos_by_student(videos))
    return W.build_raw(d.enrollments, attempts, videos, d.mooc_grades, d.mooc_progress,
                       d.mooc_discussions, _bench(d, attempts, videos) if bench else None, d.as_of, **stored)


@register("populate_features",
          "user_id:i course_id:s enrollment_mode:s is_active:b weeks_since_enrollment:i mooc_grade_percentage:d "
          "mooc_letter_grade:s mooc_is_passed:b h5p_total_contents:i h5p_completed_contents:i h5p_total_score:i "
          "h5p_total_max_score:i h5p_overall_percentage:d h5p_total_time_spent:i h5p_completion_rate:d "
          "extraction_batch_id:s updated_at:t", f"""
SELECT e.user_id, e.course_id, e.mode AS enrollment_mode, e.is_active,
  CASE WHEN e.created IS NULL THEN NULL ELSE
    GREATEST(0, CAST(FLOOR((epoch({AS_OF}) - epoch(e.created)) / 604800) AS BIGINT)) END AS weeks_since_enrollment,
  COALESCE(CAST(g.grade_percentage AS DOUBLE), 0) AS mooc_grade_percentage, g.letter_grade AS mooc_letter_grade,
  COALESCE(g.is_passed, FALSE) AS mooc_is_passed,
  COALESCE(h.total_contents, 0) AS h5p_total_contents, COALESCE(h.completed_contents, 0) AS h5p_completed_contents,
  COALESCE(h.total_score, 0) AS h5p_total_score, COALESCE(h.total_max_score, 0) AS h5p_total_max_score,
  COALESCE(h.avg_percentage, 0) AS h5p_overall_percentage, COALESCE(h.total_time_spent, 0) AS h5p_total_time_spent,
  CASE WHEN h.total_contents > 0 THEN h.completed_contents * 100.0 / h.total_contents ELSE 0 END AS h5p_completion_rate,
  'populate_' || strftime({AS_OF}, '%Y%m%d_%H%M%S') AS extraction_batch_id, {AS_OF} AS updated_at
FROM enrollments e
LEFT JOIN mooc_grades g ON e.user_id = g.user_id AND e.course_id = g.course_id
LEFT JOIN h5p_rollup h ON e.user_id = h.user_id AND e.course_id = h.course_id""", "C6 D8 Q22")
def q_populate(d):
    return W.populate_features(d.enrollments, d.mooc_grades, d.h5p_scores, d.as_of)


_FC = "CASE WHEN finished > 0 THEN CAST(percentage * 100 AS BIGINT) END"

_BENCH_SQL = f"""
SELECT en.course_id,
  ex.activity_avg_score, COALESCE(ex.n, 0) AS activity_total_activities,
  CASE WHEN en.active > 0 THEN {hround('ex.n', 'en.active', 2)} ELSE 0 END AS activity_avg_per_user,
  ex.assessment_avg_score,
  CASE WHEN ex.students > 0 THEN {hround('ex.n', 'ex.students', 2)} ELSE 0 END AS assessment_avg_attempts,
  gr.assessment_pass_rate, pr.progress_avg_completion, pr.progress_median_completion,
  pr.progress_completion_rate, vi.video_avg_completion, vi.video_avg_watch_time, di.discussion_avg_interactions,
  CASE WHEN en.total > 0 THEN {hround('COALESCE(di.active, 0) * 100', 'en.total', 2)} ELSE 0 END
    AS discussion_participation_rate,
  COALESCE(en.total, 0) AS total_students, COALESCE(en.active, 0) AS active_students
FROM (SELECT course_id, COUNT(*) AS total, SUM(CASE WHEN is_active THEN 1 ELSE 0 END) AS active
      FROM enrollments GROUP BY 1) en
FULL OUTER JOIN (SELECT course_id, COUNT(*) AS n, COUNT(DISTINCT user_id) AS students,
        {avg_round('SUM(CAST(percentage * 100 AS BIGINT))', 'COUNT(percentage)', 2, 2)} AS activity_avg_score,
        CASE WHEN COUNT({_FC}) > 0 THEN {avg_round(f'SUM({_FC})', f'COUNT({_FC})', 2, 2)} END AS assessment_avg_score
      FROM h5p_scores GROUP BY 1) ex ON ex.course_id = en.course_id
FULL OUTER JOIN (SELECT course_id,
        {avg_round('SUM(CAST(completion_rate * 100 AS BIGINT))', 'COUNT(completion_rate)', 2, 2)} AS progress_avg_completion,
        ROUND(MEDIAN(CAST(completion_rate AS DOUBLE)), 2) AS progress_median_completion,
        {hdiv('SUM(CASE WHEN completion_rate >= 100 THEN 1 ELSE 0 END) * 10000', 'COUNT(*)')} / 100.0
          AS progress_completion_rate
      FROM mooc_progress GROUP BY 1) pr ON pr.course_id = en.course_id
FULL OUTER JOIN (SELECT course_id,
        CASE WHEN COUNT(rc) > 0 THEN {avg_round('SUM(rc)', 'COUNT(rc)', 2, 2)} END AS video_avg_completion,
        CAST(TRUNC(AVG(watched)) AS BIGINT) AS video_avg_watch_time
      FROM (SELECT course_id, SUM(watched) AS watched,
              CASE WHEN COUNT(*) > 0 THEN {hdiv('SUM(CASE WHEN best >= 100 THEN 1 ELSE 0 END) * 10000', 'COUNT(*)')} END
                AS rc
            FROM (SELECT user_id, course_id, content_id, MAX(progress_percent) AS best,
                         MAX("current_time") AS watched FROM video_progress GROUP BY 1, 2, 3) x
            GROUP BY user_id, course_id) y GROUP BY 1) vi ON vi.course_id = en.course_id
FULL OUTER JOIN (SELECT course_id, {avg_round('SUM(total_interactions)', 'COUNT(total_interactions)', 0, 2)}
                   AS discussion_avg_interactions,
                 SUM(CASE WHEN total_interactions > 0 THEN 1 ELSE 0 END) AS active
      FROM mooc_discussions GROUP BY 1) di ON di.course_id = en.course_id
FULL OUTER JOIN (SELECT course_id,
        {hdiv('SUM(CASE WHEN is_passed THEN 1 ELSE 0 END) * 10000', 'COUNT(*)')} / 100.0 AS assessment_pass_rate
      FROM mooc_grades WHERE is_passed IS NOT NULL GROUP BY 1) gr ON gr.course_id = en.course_id"""

BENCH_COLS = ("course_id:s activity_avg_score:d activity_total_activities:i activity_avg_per_user:d "
              "assessment_avg_score:d assessment_avg_attempts:d assessment_pass_rate:d progress_avg_completion:d "
              "progress_median_completion:d progress_completion_rate:d video_avg_completion:d "
              "video_avg_watch_time:i discussion_avg_interactions:d discussion_participation_rate:d "
              "total_students:i active_students:i")


@register("benchmarks_from_tables", BENCH_COLS, _BENCH_SQL, "D22")
def q_bench(d):
    return _bench(d)


WIDE_COLS = (
    "user_id:i course_id:s enrollment_mode:s is_active:b weeks_since_enrollment:d progress_percent:d "
    "overall_completion:d completed_blocks:i total_blocks:i h5p_total_contents:i h5p_completed_contents:i "
    "h5p_total_score:i h5p_total_max_score:i h5p_overall_percentage:d h5p_total_time_spent:i "
    "h5p_completion_rate:d video_total_videos:i video_completed_videos:i video_in_progress_videos:i "
    "video_total_duration:i video_total_watched_time:i video_completion_rate:d video_watch_rate:d "
    "mooc_grade_percentage:d mooc_letter_grade:s mooc_is_passed:b mooc_completion_rate:d last_activity:t "
    "days_since_last_activity:i discussion_threads_count:i discussion_comments_count:i "
    "discussion_total_interactions:i discussion_questions_count:i discussion_total_upvotes:i quiz_attempts:i "
    "quiz_avg_score:d quiz_completion_rate:d problem_attempts:i problem_avg_score:d problem_success_rate:d "
    "assessment_attempts_avg:d struggling_assessments_count:i video_views:i active_days:i access_frequency:d "
    "max_inactive_gap_days:i progress_velocity:d progress_acceleration:d weeks_to_complete_estimate:d "
    "first_attempt_success_rate:d assessment_improvement_rate:d late_night_ratio:d weekend_ratio:d "
    "is_passed:b is_dropout:b fail_risk_score:d relative_to_course_problem_score:d "
    "relative_to_course_completion:d relative_to_course_video_completion:d relative_to_course_discussion:i "
    "performance_percentile:i is_below_course_average:i is_top_performer:i is_bottom_performer:i extracted_at:t")

_WIDE_SQL = f"""
WITH bench AS ({_BENCH_SQL}),
spine AS (SELECT user_id, course_id, FIRST(mode) AS enrollment_mode, FIRST(is_active) AS e_active,
                 MIN(created) AS created FROM enrollments GROUP BY 1, 2),
hs AS (SELECT user_id, course_id, COUNT(*) AS total_contents, SUM(done) AS completed_contents,
         SUM(s) AS total_score, SUM(m) AS total_max_score,
         CASE WHEN SUM(m) > 0 THEN {hround('SUM(s) * 100', 'SUM(m)', 2)} END AS overall_percentage,
         SUM(t) AS total_time_spent
       FROM (SELECT user_id, course_id, content_id, MAX(CASE WHEN finished > 0 THEN 1 ELSE 0 END) AS done,
                    SUM(score) AS s, SUM(max_score) AS m, SUM(time_spent) AS t
             FROM h5p_scores GROUP BY 1, 2, 3) x GROUP BY 1, 2),
vs AS (SELECT user_id, course_id, COUNT(*) AS total_videos, SUM(CASE WHEN best >= 100 THEN 1 ELSE 0 END) AS completed_videos,
         SUM(CASE WHEN best > 0 AND best < 100 THEN 1 ELSE 0 END) AS in_progress_videos,
         SUM(duration) AS total_duration, SUM(watched) AS total_watched_time
       FROM (SELECT user_id, course_id, content_id, MAX(progress_percent) AS best, MAX(duration) AS duration,
                    MAX("current_time") AS watched FROM video_progress GROUP BY 1, 2, 3) x GROUP BY 1, 2),
dm AS (SELECT user_id, course_id, SUM(CASE WHEN finished > 0 THEN 1 ELSE 0 END) AS finished_count,
         SUM({_FC}) AS fin_cents, COUNT({_FC}) AS fin_n,
         SUM(CASE WHEN finished > 0 AND percentage >= 60 THEN 1 ELSE 0 END) AS success_count,
         SUM(CASE WHEN finished > 0 AND percentage < 60 THEN 1 ELSE 0 END) AS struggling_count,
         AVG(CAST(opened AS DOUBLE)) AS avg_opened
       FROM h5p_scores GROUP BY 1, 2),
vv AS (SELECT user_id, course_id, COUNT(*) AS views FROM video_progress WHERE progress_percent > 0 GROUP BY 1, 2),
j AS (
  SELECT s.user_id, s.course_id, s.enrollment_mode, COALESCE(s.e_active, TRUE) AS is_active,
    CASE WHEN s.created IS NULL THEN 0.0 ELSE
      {hround('CAST(FLOOR((epoch(' + AS_OF + ') - epoch(s.created)) / 86400) AS BIGINT)', '7', 2)} END AS weeks,
    COALESCE(hs.total_contents, 0) AS h_total, COALESCE(hs.completed_contents, 0) AS h_done,
    COALESCE(hs.total_score, 0) AS h_score, COALESCE(hs.total_max_score, 0) AS h_max,
    COALESCE(hs.overall_percentage, 0.0) AS quiz_avg, COALESCE(hs.total_time_spent, 0) AS h_time,
    COALESCE(vs.total_videos, 0) AS v_total, COALESCE(vs.completed_videos, 0) AS v_done,
    COALESCE(vs.in_progress_videos, 0) AS v_prog, COALESCE(vs.total_duration, 0) AS v_dur,
    COALESCE(vs.total_watched_time, 0) AS v_watch,
    COALESCE(CAST(g.grade_percentage AS DOUBLE), 0.0) AS grade, COALESCE(g.letter_grade, '') AS letter,
    g.is_passed AS passed,
    COALESCE(CAST(p.completion_rate AS DOUBLE), 0.0) AS comp, p.last_activity,
    CASE WHEN p.last_activity IS NULL THEN 999
         ELSE CAST(FLOOR((epoch({AS_OF}) - epoch(p.last_activity)) / 86400) AS BIGINT) END AS days,
    COALESCE(d.threads_count, 0) AS d_threads, COALESCE(d.comments_count, 0) AS d_comments,
    COALESCE(d.total_interactions, 0) AS d_total, COALESCE(d.questions_count, 0) AS d_questions,
    COALESCE(d.total_upvotes, 0) AS d_upvotes,
    COALESCE(dm.finished_count, 0) AS attempts, dm.fin_cents, dm.fin_n,
    COALESCE(dm.success_count, 0) AS success, COALESCE(dm.struggling_count, 0) AS struggling,
    COALESCE(dm.avg_opened, 0.0) AS avg_opened, COALESCE(vv.views, 0) AS views,
    b.assessment_avg_score AS b_problem, b.progress_avg_completion AS b_completion,
    b.video_avg_completion AS b_video, b.discussion_avg_interactions AS b_discussion,
    b.course_id IS NOT NULL AS b_present
  FROM spine s
  LEFT JOIN hs ON hs.user_id = s.user_id AND hs.course_id = s.course_id
  LEFT JOIN vs ON vs.user_id = s.user_id AND vs.course_id = s.course_id
  LEFT JOIN mooc_grades g ON g.user_id = s.user_id AND g.course_id = s.course_id
  LEFT JOIN mooc_progress p ON p.user_id = s.user_id AND p.course_id = s.course_id
  LEFT JOIN mooc_discussions d ON d.user_id = s.user_id AND d.course_id = s.course_id
  LEFT JOIN dm ON dm.user_id = s.user_id AND dm.course_id = s.course_id
  LEFT JOIN vv ON vv.user_id = s.user_id AND vv.course_id = s.course_id
  LEFT JOIN bench b ON b.course_id = s.course_id),
k AS (
  SELECT j.*,
    CASE WHEN h_total > 0 THEN {hround('h_done * 100', 'h_total', 2)} ELSE 0.0 END AS h_rate,
    CASE WHEN v_total > 0 THEN {hround('v_done * 100', 'v_total', 2)} ELSE 0.0 END AS v_rate,
    CASE WHEN h_total + v_total > 0 THEN {hround('(h_done + v_done) * 100', 'h_total + v_total', 2)} ELSE 0.0 END
      AS overall,
    {hround('success', 'GREATEST(attempts, 1)', 2)} AS success_rate,
    CASE WHEN attempts + views > 0 THEN GREATEST(1, (attempts + views) // 4) ELSE 0 END AS active_days,
    CAST(ROUND(GREATEST(weeks, 1.0) * 100) AS BIGINT) AS wk_cents,
    CAST(ROUND(comp * 100) AS BIGINT) AS comp_cents,
    COALESCE(b_problem, 0.0) AS cp, COALESCE(b_completion, 0.0) AS cc, COALESCE(b_discussion, 0.0) AS cd
  FROM j),
l AS (
  SELECT k.*, LEAST({hround('comp_cents', 'wk_cents', 2)}, 999.99) AS velocity,
    CASE WHEN COALESCE(b_video, 0.0) <> 0 THEN b_video ELSE v_rate END AS cv
  FROM k),
m AS (
  SELECT l.*,
    comp * 0.4 + quiz_avg * 0.3 + (v_rate + LEAST(CAST(d_total AS DOUBLE) * 2, 100.0)) / 2 * 0.3 AS us,
    cc * 0.4 + cp * 0.3 + cv * 0.3 AS cs
  FROM l),
n AS (
  SELECT m.*,
    CASE WHEN cs <= 0 THEN 50 WHEN (us - cs) / cs > 0.5 THEN 90 WHEN (us - cs) / cs > 0.25 THEN 75
         WHEN (us - cs) / cs > 0 THEN 60 WHEN (us - cs) / cs > -0.25 THEN 40 WHEN (us - cs) / cs > -0.5 THEN 25
         ELSE 10 END AS pctl
  FROM m)
SELECT user_id, course_id, enrollment_mode, is_active, weeks AS weeks_since_enrollment,
  overall AS progress_percent, overall AS overall_completion, h_done + v_done AS completed_blocks,
  h_total + v_total AS total_blocks, h_total AS h5p_total_contents, h_done AS h5p_completed_contents,
  h_score AS h5p_total_score, h_max AS h5p_total_max_score, quiz_avg AS h5p_overall_percentage,
  h_time AS h5p_total_time_spent, h_rate AS h5p_completion_rate, v_total AS video_total_videos,
  v_done AS video_completed_videos, v_prog AS video_in_progress_videos, v_dur AS video_total_duration,
  v_watch AS video_total_watched_time, v_rate AS video_completion_rate,
  CASE WHEN v_dur > 0 THEN {hround('v_watch * 100', 'v_dur', 2)} ELSE 0.0 END AS video_watch_rate,
  grade AS mooc_grade_percentage, letter AS mooc_letter_grade, passed AS mooc_is_passed,
  comp AS mooc_completion_rate, last_activity, days AS days_since_last_activity,
  d_threads AS discussion_threads_count, d_comments AS discussion_comments_count,
  d_total AS discussion_total_interactions, d_questions AS discussion_questions_count,
  d_upvotes AS discussion_total_upvotes, h_done AS quiz_attempts, quiz_avg AS quiz_avg_score,
  h_rate AS quiz_completion_rate, attempts AS problem_attempts,
  CASE WHEN fin_n > 0 THEN {avg_round('fin_cents', 'fin_n', 2, 2)} ELSE 0.0 END AS problem_avg_score,
  success_rate AS problem_success_rate,
  LEAST(ROUND(avg_opened, 2), 999.99) AS assessment_attempts_avg, struggling AS struggling_assessments_count,
  views AS video_views, active_days, {hround('active_days * 100', 'wk_cents', 2)} AS access_frequency,
  CASE WHEN days < 999 THEN days ELSE 0 END AS max_inactive_gap_days,
  velocity AS progress_velocity, 0.0 AS progress_acceleration,
  CASE WHEN velocity > 0 THEN LEAST({hround('10000 - comp_cents', 'GREATEST(CAST(ROUND(velocity * 100) AS BIGINT), 1)', 2)},
                                    999.99) END AS weeks_to_complete_estimate,
  success_rate AS first_attempt_success_rate, 0.0 AS assessment_improvement_rate,
  0.0 AS late_night_ratio, 0.0 AS weekend_ratio, passed AS is_passed,
  CASE WHEN NOT is_active AND days > 30 THEN TRUE WHEN is_active OR days < 7 THEN FALSE END AS is_dropout,
  CAST(NULL AS DOUBLE) AS fail_risk_score,
  CASE WHEN NOT b_present THEN 0.0 WHEN cp > 0 THEN ROUND(quiz_avg - cp, 2) ELSE 0.0 END
    AS relative_to_course_problem_score,
  CASE WHEN NOT b_present THEN 0.0 WHEN cc > 0 THEN ROUND(comp - cc, 2) ELSE 0.0 END
    AS relative_to_course_completion,
  CASE WHEN NOT b_present THEN 0.0 ELSE ROUND(v_rate - cv, 2) END AS relative_to_course_video_completion,
  CASE WHEN NOT b_present THEN 0 ELSE CAST(TRUNC(d_total - cd) AS BIGINT) END AS relative_to_course_discussion,
  CASE WHEN NOT b_present THEN 50 ELSE pctl END AS performance_percentile,
  CASE WHEN NOT b_present THEN 0 WHEN us < cs THEN 1 ELSE 0 END AS is_below_course_average,
  CASE WHEN NOT b_present THEN 0 WHEN pctl >= 75 THEN 1 ELSE 0 END AS is_top_performer,
  CASE WHEN NOT b_present THEN 0 WHEN pctl <= 25 THEN 1 ELSE 0 END AS is_bottom_performer,
  {AS_OF} AS extracted_at
FROM n"""


@register("wide_row", WIDE_COLS, _WIDE_SQL, "C7 I21-I34 D9 D10 D23 D22")
def q_wide(d):
    return wide_rows(d)


@register("wide_row_no_benchmarks", WIDE_COLS, _WIDE_SQL.replace(
    "LEFT JOIN bench b ON b.course_id = s.course_id", "LEFT JOIN bench b ON FALSE"), "C7 I33 defaults")
def q_wide_nb(d):
    return wide_rows(d, bench=False)


# Wide rows fed by stored tables: the exercise summary as the populate job's rollup has it (its numbers
# differ from sums over the attempts), and dashboard rows of the students with progress.
_HS = _WIDE_SQL[_WIDE_SQL.index("hs AS ("):_WIDE_SQL.index("vs AS (")]
_STORED_SQL = _WIDE_SQL.replace(_HS, """hs AS (SELECT user_id, course_id, total_contents, completed_contents, total_score, total_max_score,
  floor(avg_percentage) AS overall_percentage, total_time_spent FROM h5p_rollup),
""")


def _stored(d):
    return h5p_rollup(d.h5p_scores).withColumn("overall_percentage", F.floor("avg_percentage").cast("double"))


@register("wide_row_stored_summaries", WIDE_COLS, _STORED_SQL, "C7 I22 with summary tables")
def q_wide_stored(d):
    return wide_rows(d, h5p_sums=_stored(d), video_sums=video_summary(d.video_progress))


_DASH_SQL = (_WIDE_SQL
             .replace("overall AS progress_percent, overall AS overall_completion, h_done + v_done AS completed_blocks,\n"
                      "  h_total + v_total AS total_blocks,",
                      "CASE WHEN db > 0 THEN db ELSE overall END AS progress_percent, CASE WHEN db > 0 THEN db ELSE overall END "
                      "AS overall_completion, CASE WHEN db > 0 THEN db_done ELSE h_done + v_done END AS completed_blocks, "
                      "CASE WHEN db > 0 THEN db_total ELSE h_total + v_total END AS total_blocks,")
             .replace("COALESCE(vv.views, 0) AS views,", "COALESCE(vv.views, 0) AS views, CAST(p.completion_rate AS DOUBLE) AS db, "
                      "p.completed_blocks AS db_done, p.total_blocks AS db_total,"))


@register("wide_row_dashboard", WIDE_COLS, _DASH_SQL, "C7 I22 with dashboard rows")
def q_wide_dashboard(d):
    dash = d.mooc_progress.select("user_id", "course_id", "completion_rate", "completed_blocks", "total_blocks").toDF(
        "user_id", "course_id", "overall_completion", "completed_items", "total_items")
    return wide_rows(d, dash=dash)


@register("wide_row_place", "user_id:i course_id:s current_chapter:s current_section:s current_unit:s", """
SELECT e.user_id, e.course_id, 'chapter ' || (p.user_id % 9) AS current_chapter,
  CASE WHEN p.user_id % 4 <> 0 THEN 'section ' || (p.user_id % 7) END AS current_section, 'unit ' || (p.user_id % 11) AS current_unit
FROM (SELECT DISTINCT user_id, course_id FROM enrollments) e LEFT JOIN mooc_progress p USING (user_id, course_id)""", "C7 A9")
def q_wide_place(d):
    """Chapter, section and unit of landed progress payloads in the wide row."""
    def text(name, n):
        return F.concat(F.lit(f"{name} "), (F.col("user_id") % n).cast("string"))
    student = F.struct("user_id", text("chapter", 9).alias("current_chapter"), F.when(F.col("user_id") % 4 != 0, text("section", 7)).alias("current_section"),
                       text("unit", 11).alias("current_unit"), F.col("completion_rate").cast("double").alias("completion_rate"))
    landed = d.mooc_progress.select("course_id", F.from_json(F.to_json(F.struct(F.array(student).alias("students"))), PL.PROGRESS).alias("p"))
    progress = PL.progress_rows(PL.students_of(landed.select("course_id", "p.*")))
    return W.build_raw(d.enrollments, d.h5p_scores, d.video_progress, d.mooc_grades, progress, d.mooc_discussions, None, d.as_of)


@register("wide_row_refreshed", WIDE_COLS, _WIDE_SQL, "C7 A17 refresh of changed students")
def q_wide_refreshed(d):
    """Stored wide rows from before a fifth of the students changed, and those students' rows made anew and upserted."""
    base = f"{ensure_checkpoint_dir(d.spark).rstrip('/')}/tables/{uuid.uuid4()}"
    # the rows by student serve the benchmarks, the stored rows and the changed ones: each is made once
    attempts, videos = settle(attempts_by_student(d.h5p_scores)), settle(videos_by_student(d.video_progress))
    enrolled = settle(d.enrollments.select("user_id", "course_id", "enrollment_id", "mode", "is_active", "created"))
    progress, discussions = settle(d.mooc_progress), settle(d.mooc_discussions.drop("username"))
    bench = settle(W.benchmarks_from_tables(enrolled, attempts, progress, video_summary(videos), discussions, d.mooc_grades))
    later = F.col("user_id") % 5 == 0
    before = W.build_raw(enrolled, attempts.where(~later), videos.where(~later), d.mooc_grades.where(~later), progress, discussions, bench,
                         d.as_of)
    upsert_buckets(d.spark, base, before, ["user_id", "course_id"], "extracted_at", buckets=16)
    rows = W.refreshed(enrolled.where(later), enrolled, attempts, videos, d.mooc_grades, progress, discussions, bench, d.as_of)
    upsert_buckets(d.spark, base, rows, ["user_id", "course_id"], "extracted_at")
    return read_buckets(d.spark, base)
