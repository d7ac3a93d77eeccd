"""Feature-engineering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as FE
from .base import register

KEYS = ["user_id", "course_id"]


def features_input(d):
    """Wide-row stand-in: feature rows plus the forum interaction count."""
    disc = d.mooc_discussions.select(*KEYS, F.col("total_interactions").cast("double")
                                     .alias("discussion_total_interactions"))
    return d.student_features.join(disc, KEYS, "left")


_INPUT = """
base AS (SELECT f.*, CAST(d.total_interactions AS DOUBLE) AS discussion_total_interactions
         FROM student_features f LEFT JOIN mooc_discussions d
           ON f.user_id = d.user_id AND f.course_id = d.course_id),
agg AS (SELECT course_id, MAX(discussion_total_interactions) AS dmax, AVG(discussion_total_interactions) AS dmean,
               AVG(mooc_completion_rate) AS cmean FROM base GROUP BY course_id)"""

_ROWSTD = """
  CASE WHEN ((mooc_completion_rate IS NOT NULL)::INT + (video_completion_rate IS NOT NULL)::INT
             + (h5p_completion_rate IS NOT NULL)::INT) >= 2 THEN sqrt((
      COALESCE((mooc_completion_rate - m3) * (mooc_completion_rate - m3), 0)
    + COALESCE((video_completion_rate - m3) * (video_completion_rate - m3), 0)
    + COALESCE((h5p_completion_rate - m3) * (h5p_completion_rate - m3), 0)) / (n3 - 1)) END"""

_STD_PREP = """
  ((mooc_completion_rate IS NOT NULL)::INT + (video_completion_rate IS NOT NULL)::INT
   + (h5p_completion_rate IS NOT NULL)::INT) AS n3,
  (COALESCE(mooc_completion_rate, 0) + COALESCE(video_completion_rate, 0) + COALESCE(h5p_completion_rate, 0))
   / NULLIF((mooc_completion_rate IS NOT NULL)::INT + (video_completion_rate IS NOT NULL)::INT
   + (h5p_completion_rate IS NOT NULL)::INT, 0) AS m3"""

ALL_COLS = ("user_id:i course_id:s mooc_completion_rate:d discussion_score:d video_score:d h5p_score:d quiz_score:d engagement_score:d "
            "activity_recency:d activity_consistency:d is_inactive:i is_highly_inactive:i "
            "relative_completion:d is_struggling:i is_at_risk:i completion_consistency:d "
            "discussion_engagement_rate:d has_no_discussion:i video_engagement_rate:d h5p_engagement_rate:d "
            "interaction_score:d enrollment_phase:s weeks_remaining:d progress_rate:d")


@register("all_features", ALL_COLS, f"""
WITH {_INPUT},
x AS (SELECT b.*, a.dmax, a.dmean, a.cmean,
        b.discussion_total_interactions / CASE WHEN a.dmax = 0 THEN 1.0 ELSE a.dmax END * 100 AS discussion_score,
        {_STD_PREP}
      FROM base b LEFT JOIN agg a ON a.course_id = b.course_id),
y AS (SELECT x.*,
        COALESCE(discussion_score * 0.25 + video_completion_rate * 0.25 + h5p_completion_rate * 0.25
                 + quiz_avg_score * 0.25, 0.0) AS engagement_score,
        100 - CASE WHEN days_since_last_activity IS NULL THEN NULL ELSE LEAST(GREATEST(days_since_last_activity / 30 * 100, 0.0), 100.0) END AS activity_recency,
        discussion_total_interactions / CASE WHEN dmean = 0 THEN 1.0 ELSE dmean END AS discussion_engagement_rate
      FROM x)
SELECT user_id, course_id, COALESCE(mooc_completion_rate, 0) AS mooc_completion_rate,
  COALESCE(discussion_score, 0) AS discussion_score, ifnull(video_completion_rate, 0) AS video_score,
  ifnull(h5p_completion_rate, 0) AS h5p_score, ifnull(quiz_avg_score, 0) AS quiz_score, engagement_score,
  COALESCE(activity_recency, 0) AS activity_recency,
  COALESCE((engagement_score + activity_recency) / 2, 0) AS activity_consistency,
  COALESCE(days_since_last_activity > 7, FALSE)::INT AS is_inactive,
  COALESCE(days_since_last_activity > 14, FALSE)::INT AS is_highly_inactive,
  COALESCE(mooc_completion_rate - cmean, 0) AS relative_completion,
  COALESCE(mooc_completion_rate < 50 OR video_completion_rate < 50 OR h5p_completion_rate < 50, FALSE)::INT
    AS is_struggling,
  COALESCE(mooc_completion_rate < 40, FALSE)::INT AS is_at_risk,
  COALESCE({_ROWSTD}, 0) AS completion_consistency,
  COALESCE(discussion_engagement_rate, 0) AS discussion_engagement_rate,
  COALESCE(discussion_total_interactions = 0, FALSE)::INT AS has_no_discussion,
  COALESCE(video_completion_rate / 100, 0) AS video_engagement_rate,
  COALESCE(h5p_completion_rate / 100, 0) AS h5p_engagement_rate,
  COALESCE((discussion_engagement_rate * 0.4 + video_completion_rate / 100 * 0.3
            + h5p_completion_rate / 100 * 0.3) * 100, 0) AS interaction_score,
  CASE WHEN weeks_since_enrollment <= 0 THEN NULL WHEN weeks_since_enrollment <= 2 THEN 'very_early'
       WHEN weeks_since_enrollment <= 4 THEN 'early' WHEN weeks_since_enrollment <= 8 THEN 'mid'
       WHEN weeks_since_enrollment <= 12 THEN 'late' WHEN weeks_since_enrollment > 12 THEN 'very_late' END
    AS enrollment_phase,
  COALESCE(CASE WHEN weeks_since_enrollment IS NULL THEN NULL ELSE LEAST(GREATEST(16 - weeks_since_enrollment, 0.0), 16.0) END, 0) AS weeks_remaining,
  COALESCE(mooc_completion_rate / CASE WHEN weeks_since_enrollment = 0 THEN 1.0
                                        ELSE weeks_since_enrollment END, 0) AS progress_rate
FROM y""", "I1-I19 E1 E2 E3")
def q_all_features(d):
    return FE.all_features(features_input(d))


FB_COLS = ("user_id:i course_id:s engagement_score:d activity_recency:d activity_consistency:d is_inactive:i "
           "is_struggling:i relative_completion:d completion_consistency:d discussion_engagement_rate:d "
           "interaction_score:d progress_rate:d weeks_remaining:d enrollment_phase:s is_highly_inactive:i is_at_risk:i "
           "has_no_discussion:i video_engagement_rate:d h5p_engagement_rate:d")


@register("fallback_features", FB_COLS, f"""
WITH {_INPUT},
x AS (SELECT b.*, a.cmean, {_STD_PREP},
        (mooc_completion_rate + video_completion_rate + h5p_overall_percentage) / 3 AS engagement_score,
        100 - CASE WHEN days_since_last_activity IS NULL THEN NULL ELSE LEAST(GREATEST(days_since_last_activity / 30 * 100, 0.0), 100.0) END AS activity_recency
      FROM base b LEFT JOIN agg a ON a.course_id = b.course_id)
SELECT user_id, course_id, engagement_score, activity_recency,
  (engagement_score + activity_recency) / 2 AS activity_consistency,
  COALESCE(days_since_last_activity > 7, FALSE)::INT AS is_inactive,
  COALESCE(mooc_completion_rate < 50 OR video_completion_rate < 50, FALSE)::INT AS is_struggling,
  mooc_completion_rate - cmean AS relative_completion,
  COALESCE({_ROWSTD}, 0) AS completion_consistency,
  discussion_total_interactions AS discussion_engagement_rate,
  (discussion_total_interactions * 0.4 + video_completion_rate / 100 * 0.3 + h5p_completion_rate / 100 * 0.3) * 100
    AS interaction_score,
  mooc_completion_rate / CASE WHEN weeks_since_enrollment = 0 THEN 1.0 ELSE weeks_since_enrollment END
    AS progress_rate,
  CASE WHEN weeks_since_enrollment IS NULL THEN NULL ELSE LEAST(GREATEST(16 - weeks_since_enrollment, 0.0), 16.0) END AS weeks_remaining,
  'mid' AS enrollment_phase, ifnull(days_since_last_activity > 14, FALSE)::INT AS is_highly_inactive,
  ifnull(mooc_completion_rate < 40, FALSE)::INT AS is_at_risk, ifnull(discussion_total_interactions = 0, FALSE)::INT AS has_no_discussion,
  video_completion_rate / 100 AS video_engagement_rate, h5p_completion_rate / 100 AS h5p_engagement_rate
FROM x""", "I20")
def q_fallback(d):
    return FE.fallback_features(features_input(d))
