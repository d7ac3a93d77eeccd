"""Event-log queries (M1–M4, and the batch twin of N2)."""

from __future__ import annotations

from ..operators import events as EVT
from ..operators.skew import settle
from .contract import hround
from .q_wide import _WIDE_SQL, WIDE_COLS, wide_rows
from .base import avg_round, register

_PROB = "action IN ('problem_attempt', 'problem_correct')"

_M1_SQL = f"""
WITH ev AS (
  SELECT user_id, course_id,
    SUM(CASE WHEN action = 'problem_attempt' THEN 1 ELSE 0 END) AS problem_total_attempts,
    SUM(CASE WHEN action = 'problem_correct' THEN 1 ELSE 0 END) AS problem_total_correct,
    CASE WHEN COUNT(CASE WHEN {_PROB} THEN score END) > 0 THEN
      {avg_round(f'SUM(CASE WHEN {_PROB} THEN CAST(ROUND(score * 100) AS BIGINT) END)',
                 f'COUNT(CASE WHEN {_PROB} THEN score END)', 2, 2)} END AS problem_avg_score,
    COUNT(DISTINCT CASE WHEN {_PROB} THEN item END) AS problem_unique_problems,
    SUM(CASE WHEN action = 'video_view' THEN 1 ELSE 0 END) AS video_total_views,
    COUNT(DISTINCT CASE WHEN action = 'video_view' THEN item END) AS video_unique_videos,
    CASE WHEN COUNT(CASE WHEN action = 'video_view' THEN score END) > 0 THEN
      CAST(FLOOR(SUM(CASE WHEN action = 'video_view' THEN CAST(ROUND(score * 100) AS BIGINT) END)
                 / (COUNT(CASE WHEN action = 'video_view' THEN score END) * 100)) AS BIGINT) END
      AS video_avg_watch_time,
    SUM(CASE WHEN action = 'discussion_post' THEN 1 ELSE 0 END) AS discussion_posts_count,
    SUM(CASE WHEN action = 'discussion_reply' THEN 1 ELSE 0 END) AS discussion_replies_count,
    SUM(CASE WHEN hour(ts) >= 22 THEN 1 ELSE 0 END) AS late_night_activities,
    SUM(CASE WHEN dayofweek(ts) IN (0, 6) THEN 1 ELSE 0 END) AS weekend_activities,
    COUNT(*) AS total_activities, MIN(ts) AS first_activity_date, MAX(ts) AS last_activity_date
  FROM activity GROUP BY 1, 2),
days AS (SELECT user_id, course_id, CAST(ts AS DATE) AS day, COUNT(*) AS events FROM activity GROUP BY 1, 2, 3),
d2 AS (SELECT *, date_diff('day', LAG(day) OVER w, day) - 1 AS gap,
              day - CAST(ROW_NUMBER() OVER w AS INTEGER) AS island
       FROM days WINDOW w AS (PARTITION BY user_id, course_id ORDER BY day)),
isl AS (SELECT user_id, course_id, island, COUNT(*) AS len, MAX(day) AS "end" FROM d2 GROUP BY 1, 2, 3),
streak AS (SELECT user_id, course_id, MAX(len) AS longest_streak, arg_max(len, "end") AS current_streak
           FROM isl GROUP BY 1, 2),
pd AS (SELECT user_id, course_id, COUNT(*) AS active_days_count, COALESCE(MAX(gap), 0) AS max_gap_days,
         {hround('COUNT(*) * SUM(events * events) - SUM(events) * SUM(events)', 'COUNT(*) * COUNT(*)', 2)}
           AS activity_variance
       FROM d2 GROUP BY 1, 2)
SELECT ev.*, pd.active_days_count, pd.max_gap_days, pd.activity_variance, streak.longest_streak,
       streak.current_streak
FROM ev JOIN pd USING (user_id, course_id) JOIN streak USING (user_id, course_id)"""

M1_COLS = ("user_id:i course_id:s problem_total_attempts:i problem_total_correct:i problem_avg_score:d "
           "problem_unique_problems:i video_total_views:i video_unique_videos:i video_avg_watch_time:i "
           "discussion_posts_count:i discussion_replies_count:i late_night_activities:i weekend_activities:i "
           "total_activities:i first_activity_date:t last_activity_date:t active_days_count:i max_gap_days:i "
           "activity_variance:d longest_streak:i current_streak:i")


@register("activity_stats", M1_COLS, _M1_SQL, "M1 E11")
def q_m1(d):
    return EVT.activity_stats(settle(EVT.activity_rollup(d.activity)))


@register("daily_activity", "user_id:i course_id:s day:dt events:i",
          "SELECT user_id, course_id, CAST(ts AS DATE) AS day, COUNT(*) AS events FROM activity GROUP BY 1, 2, 3",
          "M1 pre-aggregate, N2 batch twin")
def q_daily(d):
    return EVT.daily_counts(d.activity)


_M2_SQL = f"""
SELECT user_id, course_id, content_id, COUNT(*) AS total_attempts,
  CAST(first(percentage ORDER BY opened, finished, time_spent, percentage) AS DOUBLE) AS first_attempt_score,
  CAST(MAX(percentage) AS DOUBLE) AS best_score,
  CAST(first(percentage ORDER BY opened DESC, finished DESC, time_spent DESC, percentage DESC) AS DOUBLE)
    AS latest_score,
  MIN(CASE WHEN percentage >= 60 THEN rn END) AS attempts_to_pass,
  SUM(time_spent) AS total_time_spent, CAST(FLOOR(AVG(time_spent)) AS BIGINT) AS avg_time_per_attempt,
  make_timestamp(MIN(opened) * 1000000) AS first_attempt_date,
  make_timestamp(MAX(opened) * 1000000) AS last_attempt_date,
  CASE WHEN first(percentage ORDER BY opened, finished, time_spent, percentage) > 0 THEN
    {hround('(CAST(MAX(percentage) * 100 AS BIGINT) - CAST(first(percentage ORDER BY opened, finished, time_spent, percentage) * 100 AS BIGINT)) * 100',
            'CAST(first(percentage ORDER BY opened, finished, time_spent, percentage) * 100 AS BIGINT)', 2)}
    ELSE 0.0 END AS improvement_rate,
  'quiz' AS assessment_type
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, course_id, content_id
                                   ORDER BY opened, finished, time_spent, percentage) AS rn FROM h5p_scores) h
GROUP BY 1, 2, 3"""

M2_COLS = ("user_id:i course_id:s content_id:i total_attempts:i first_attempt_score:d best_score:d "
           "latest_score:d attempts_to_pass:i total_time_spent:i avg_time_per_attempt:i first_attempt_date:t "
           "last_attempt_date:t improvement_rate:d assessment_type:s")


@register("assessment_details", M2_COLS, _M2_SQL, "M2")
def q_m2(d):
    return EVT.assessment_details(d.h5p_scores)


_M3_SQL = f"""
WITH done AS (SELECT * FROM activity WHERE action IN ('problem_correct', 'video_view') AND item IS NOT NULL),
st AS (SELECT course_id, CAST(MIN(ts) AS DATE) AS course_start FROM activity GROUP BY 1),
tot AS (SELECT course_id, COUNT(DISTINCT action || ':' || CAST(item AS VARCHAR)) AS total_blocks FROM done GROUP BY 1),
fb AS (SELECT user_id, course_id, action, item, MIN(ts) AS first_ts FROM done GROUP BY 1, 2, 3, 4),
wk AS (SELECT fb.*, CAST(FLOOR(date_diff('day', st.course_start, CAST(fb.first_ts AS DATE)) / 7) AS INTEGER) + 1
              AS week FROM fb JOIN st USING (course_id)),
weekly AS (SELECT user_id, course_id, week, COUNT(*) AS new_blocks FROM wk GROUP BY 1, 2, 3),
span AS (SELECT user_id, course_id, MAX(week) AS last_week FROM weekly GROUP BY 1, 2),
grid AS (SELECT user_id, course_id, UNNEST(range(1, last_week + 1)) AS week FROM span),
j AS (SELECT g.user_id, g.course_id, g.week, COALESCE(w.new_blocks, 0) AS new_blocks, t.total_blocks, s.course_start
      FROM grid g LEFT JOIN weekly w ON w.user_id = g.user_id AND w.course_id = g.course_id AND w.week = g.week
      JOIN tot t ON t.course_id = g.course_id JOIN st s ON s.course_id = g.course_id),
r AS (SELECT j.*, SUM(new_blocks) OVER (PARTITION BY user_id, course_id ORDER BY week
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS completed_blocks FROM j),
v AS (SELECT r.*, {hround('completed_blocks * 100', 'total_blocks', 2)} AS completion_percent,
             {hround('completed_blocks', 'week', 2)} AS velocity FROM r),
x AS (SELECT v.*, LAG(velocity) OVER (PARTITION BY user_id, course_id ORDER BY week) AS prev FROM v)
SELECT user_id, course_id, week AS tracked_week, completion_percent, completed_blocks, total_blocks,
  new_blocks AS blocks_completed_this_week, velocity, velocity - prev AS acceleration,
  CASE WHEN prev IS NULL THEN 'stable' WHEN velocity > prev * (1 + 0.1) THEN 'improving'
       WHEN velocity < prev * (1 - 0.1) THEN 'declining' ELSE 'stable' END AS velocity_trend,
  completion_percent >= week * 100.0 / 16 AS is_on_track,
  course_start + CAST((week - 1) * 7 AS INTEGER) AS week_start_date,
  course_start + CAST(week * 7 - 1 AS INTEGER) AS week_end_date
FROM x"""

M3_COLS = ("user_id:i course_id:s tracked_week:i completion_percent:d completed_blocks:i total_blocks:i "
           "blocks_completed_this_week:i velocity:d acceleration:d velocity_trend:s is_on_track:b "
           "week_start_date:dt week_end_date:dt")


@register("progress_weekly", M3_COLS, _M3_SQL, "M3 E10")
def q_m3(d):
    return EVT.progress_weekly(settle(EVT.activity_rollup(d.activity)))


def _strip_with(sql: str) -> str:
    s = sql.lstrip()
    return s[5:] if s[:5].upper() == "WITH " else s


_M4_SQL = f"""
WITH wide AS ({_WIDE_SQL}),
m1 AS ({_M1_SQL}),
m2 AS ({_M2_SQL}),
m3 AS ({_M3_SQL}),
a AS (SELECT user_id, course_id, late_night_activities * 1.0 / NULLIF(total_activities, 0) AS late,
             weekend_activities * 1.0 / NULLIF(total_activities, 0) AS weekend, max_gap_days AS gap FROM m1),
b AS (SELECT user_id, course_id,
        {avg_round('SUM(CAST(ROUND(improvement_rate * 100) AS BIGINT))', 'COUNT(improvement_rate)', 2, 6)}
          AS improve FROM m2 GROUP BY 1, 2),
c AS (SELECT user_id, course_id, arg_max(acceleration, tracked_week) AS accel FROM m3 GROUP BY 1, 2)
SELECT w.user_id, w.course_id, COALESCE(a.late, 0.0) AS late_night_ratio, COALESCE(a.weekend, 0.0) AS weekend_ratio,
  COALESCE(a.gap, w.max_inactive_gap_days) AS max_inactive_gap_days,
  COALESCE(b.improve, 0.0) AS assessment_improvement_rate, COALESCE(c.accel, 0.0) AS progress_acceleration
FROM wide w LEFT JOIN a ON a.user_id = w.user_id AND a.course_id = w.course_id
LEFT JOIN b ON b.user_id = w.user_id AND b.course_id = w.course_id
LEFT JOIN c ON c.user_id = w.user_id AND c.course_id = w.course_id"""


@register("enrich_raw",
          "user_id:i course_id:s late_night_ratio:d weekend_ratio:d max_inactive_gap_days:i "
          "assessment_improvement_rate:d progress_acceleration:d", _M4_SQL, "M4")
def q_m4(d):
    act = settle(EVT.activity_rollup(d.activity))  # the log is read once, for M1 and M3
    out = EVT.enrich_raw(wide_rows(d), EVT.activity_stats(act), EVT.assessment_details(d.h5p_scores),
                         EVT.progress_weekly(act))
    return out.select("user_id", "course_id", "late_night_ratio", "weekend_ratio", "max_inactive_gap_days",
                      "assessment_improvement_rate", "progress_acceleration")


assert WIDE_COLS  # the wide-row contract this query extends
