"""Remaining operator queries: top-N risk (F5), plain suggestions (J2),
scoring input (C5), coercion (B8, B11) and legacy-column drops (B12)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators import roster as R
from ..operators.exercises import order_attempts
from ..operators.ranking import with_position
from ..operators.suggestions import suggestion_text
from .base import register
from .q_marts import ROSTER_COLS, ROSTER_SQL

KEYS = ["user_id", "course_id"]


def top_risk(p, n: int):
    """the ``n`` highest latest scores per course (user id breaks ties);
    ``row_number() <= n`` is planned with a partial WindowGroupLimit."""
    w = Window.partitionBy("course_id").orderBy(F.col("fail_risk_score").desc(), F.col("user_id").asc())
    return (R.latest_only(p).withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= n).select("course_id", "rank", "user_id", "fail_risk_score", "risk_level"))


@register("top_risk_5", "course_id:s rank:i user_id:i fail_risk_score:d risk_level:s", """
SELECT course_id, rank, user_id, fail_risk_score, risk_level FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY course_id ORDER BY fail_risk_score DESC, user_id) AS rank
  FROM predictions WHERE is_latest) t WHERE rank <= 5""", "F5")
def q_top5(d):
    return top_risk(d.predictions, 5)


@register("top_risk_10", "course_id:s rank:i user_id:i fail_risk_score:d risk_level:s", """
SELECT course_id, rank, user_id, fail_risk_score, risk_level FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY course_id ORDER BY fail_risk_score DESC, user_id) AS rank
  FROM predictions WHERE is_latest) t WHERE rank <= 10""", "F5")
def q_top10(d):
    return top_risk(d.predictions, 10)


# The plain suggestions and when they are made.
_PARTS = [
    ("f.days_since_last_activity > 7", "📧 Gửi email nhắc nhở sinh viên quay lại học"),
    ("f.days_since_last_activity > 14", "📞 Liên hệ trực tiếp qua điện thoại hoặc tin nhắn"),
    ("f.mooc_grade_percentage < 40", "👨‍🏫 Tổ chức buổi ôn tập hoặc tư vấn 1-1"),
    ("f.mooc_grade_percentage < 40", "📚 Cung cấp tài liệu học tập bổ sung"),
    ("f.mooc_completion_rate < 30", "⏰ Nhắc nhở về deadline và lộ trình học tập"),
    ("COALESCE(d.total_interactions, 1) = 0", "💬 Khuyến khích tham gia thảo luận forum"),
    ("COALESCE(d.total_interactions, 1) = 0", "👥 Ghép nhóm học tập với sinh viên khác"),
    ("f.video_completion_rate < 30", "🎥 Kiểm tra xem video có vấn đề kỹ thuật không"),
    ("f.video_completion_rate < 30", "📝 Cung cấp transcript hoặc tài liệu thay thế"),
    ("f.quiz_avg_score < 50", "✍️ Tổ chức buổi giải đáp thắc mắc về quiz"),
    ("f.quiz_avg_score < 50", "📖 Cung cấp bài tập luyện tập thêm"),
    ("p.fail_risk_score >= 70", "🚨 Ưu tiên can thiệp ngay - Nguy cơ rất cao"),
    ("p.fail_risk_score >= 70", "📊 Lập kế hoạch học tập cá nhân hóa"),
]
_J2_SQL = ("SELECT f.user_id, f.course_id, COALESCE(NULLIF(concat_ws('; ', "
           + ", ".join(f"CASE WHEN {c} THEN '{t}' END" for c, t in _PARTS)
           + "), ''), '✅ Sinh viên đang học tốt, tiếp tục theo dõi') AS suggestions "
           "FROM student_features f "
           "LEFT JOIN mooc_discussions d ON d.user_id = f.user_id AND d.course_id = f.course_id "
           "LEFT JOIN predictions p ON p.user_id = f.user_id AND p.course_id = f.course_id AND p.is_latest")


@register("plain_suggestions", "user_id:i course_id:s suggestions:s", _J2_SQL, "J2")
def q_j2(d):
    disc = d.mooc_discussions.select(*KEYS, F.col("total_interactions").alias("discussion_total_interactions"))
    p = R.latest_only(d.predictions).select(*KEYS, "fail_risk_score")
    j = d.student_features.join(disc, KEYS, "left").join(p, KEYS, "left")
    # missing keys take the CLI's defaults: interactions 1 (no forum row), score 0
    j = j.withColumn("discussion_total_interactions", F.coalesce("discussion_total_interactions", F.lit(1)))
    return j.select(*KEYS, suggestion_text().alias("suggestions"))


@register("scoring_input", "user_id:i course_id:s enrollment_mode:s enrollment_active:b mooc_completion_rate:d", """
SELECT f.user_id, f.course_id, e.mode AS enrollment_mode, e.is_active AS enrollment_active, f.mooc_completion_rate
FROM student_features f LEFT JOIN enrollments e ON e.user_id = f.user_id AND e.course_id = f.course_id""", "C5")
def q_c5(d):
    return R.scoring_input(d.student_features.select(*KEYS, "mooc_completion_rate"), d.enrollments)


@register("coerced_numbers",
          "user_id:i course_id:s grade_number:d grade_int:i completion_number:d letter_number:d", """
SELECT f.user_id, f.course_id,
  COALESCE(TRY_CAST(CAST(f.mooc_grade_percentage AS VARCHAR) AS DOUBLE), 0.0) AS grade_number,
  CAST(TRUNC(COALESCE(TRY_CAST(CAST(f.mooc_grade_percentage AS VARCHAR) AS DOUBLE), 0.0)) AS BIGINT) AS grade_int,
  COALESCE(TRY_CAST(CAST(f.mooc_completion_rate AS VARCHAR) AS DOUBLE), 0.0) AS completion_number,
  COALESCE(TRY_CAST(f.mooc_letter_grade AS DOUBLE), 0.0) AS letter_number
FROM student_features f""", "B8 B11")
def q_b8(d):
    f = d.student_features
    return f.select(*KEYS, E.to_number("mooc_grade_percentage").alias("grade_number"),
                    E.to_int("mooc_grade_percentage").alias("grade_int"),
                    E.to_number("mooc_completion_rate").alias("completion_number"),
                    E.to_number("mooc_letter_grade").alias("letter_number"))


# The early-exercise metrics the migrations removed, each for a
# 2- and a 3-week window, plus the single columns dropped with them.
EARLY_METRICS = ["attempts", "avg_score", "max_score", "min_score", "pass_rate", "fail_rate", "time_spent",
                 "unique_content", "activity_frequency", "completion_rate"]
LEGACY_COLUMNS = ([f"h5p_early_{m}_{w}weeks" for w in (2, 3) for m in EARLY_METRICS]
                  + ["h5p_first_activity_date", "h5p_activity_consistency_early",
                     "h5p_max_inactive_gap_days_early", "enrollment_date"])


def drop_legacy(df):
    """Drop the legacy columns that are present (a no-op otherwise)."""
    return df.drop(*[c for c in LEGACY_COLUMNS if c in df.columns])


@register("drop_legacy", "user_id:i course_id:s weeks_since_enrollment:i", """
SELECT user_id, course_id, weeks_since_enrollment FROM student_features""", "B12")
def q_b12(d):
    f = d.student_features.withColumn("enrollment_date", F.lit(None).cast("timestamp"))
    out = drop_legacy(f)
    assert "enrollment_date" not in out.columns
    return out.select(*KEYS, "weeks_since_enrollment")


def _roster_order(by: str, order: str, sql_order: str):
    """The roster in the route's order, with each row's place in it."""
    @register(f"roster_sorted_by_{by}_{order}", ROSTER_COLS + " position:i",
              f"SELECT r.*, ROW_NUMBER() OVER (ORDER BY {sql_order}, course_id, user_id) AS position FROM ({ROSTER_SQL}) r", "F1 B6")
    def q_f1(d):
        r = R.roster(d.student_features, d.enrollments, d.mooc_grades, d.predictions)
        return with_position(R.sort_roster(r, by, order))


_roster_order("name", "asc", "full_name ASC NULLS FIRST")
_roster_order("risk_score", "desc", "raw_risk_score DESC NULLS LAST")
_roster_order("last_activity", "asc", "days_since_last_activity ASC NULLS FIRST")


# Names with accents, mixed case and trailing blanks in place of the fixture's plain ones.
_NAMES = ["Nguyễn Ánh ", "NGUYEN ANH ", "élodie ", "Zoë", "ELODIE"]
_NAMES_SQL = "CASE user_id % 6 " + " ".join(f"WHEN {i} THEN '{n}' || CASE WHEN user_id % 4 = 0 THEN '' ELSE (user_id % 40)::VARCHAR END || CASE WHEN user_id % 3 = 0 THEN '  ' ELSE '' END"
                                            for i, n in enumerate(_NAMES)) + " END"
_PLAIN_SQL = "strip_accents(lower(rtrim(full_name)))"


def _named_roster(d):
    name = F.lit(None).cast("string")
    for i, n in enumerate(_NAMES):
        number = F.when(F.col("user_id") % 4 == 0, "").otherwise((F.col("user_id") % 40).cast("string"))
        name = F.when(F.col("user_id") % 6 == i, F.concat(F.lit(n), number, F.when(F.col("user_id") % 3 == 0, "  ").otherwise(""))).otherwise(name)
    return R.roster(d.student_features, d.enrollments, d.mooc_grades, d.predictions).withColumn("full_name", name)


@register("roster_search_accents", ROSTER_COLS, f"""
SELECT * FROM (SELECT r.* REPLACE ({_NAMES_SQL} AS full_name) FROM ({ROSTER_SQL}) r)
WHERE contains({_PLAIN_SQL}, 'nguyen anh') OR contains(lower(email), 'nguyen anh') OR contains(user_id::VARCHAR, 'nguyễn ANH')""", "B5 Q12")
def q_search_accents(d):
    return R.search(_named_roster(d), "nguyễn ANH")


@register("roster_sorted_by_name_accents", ROSTER_COLS + " position:i", f"""
SELECT *, ROW_NUMBER() OVER (ORDER BY {_PLAIN_SQL} ASC NULLS FIRST, course_id, user_id) AS position
FROM (SELECT r.* REPLACE ({_NAMES_SQL} AS full_name) FROM ({ROSTER_SQL}) r)""", "F1 B6 Q12")
def q_sorted_accents(d):
    return with_position(R.sort_roster(_named_roster(d), "name", "asc"))


def _attempt_order(by: str, sql_order: str):
    """attempts in the order of the content page or the student page, with their place."""
    @register(f"{by}_attempts_ordered",
              "course_id:s content_id:i user_id:i percentage:d finished:i opened:i time_spent:i position:i",
              "SELECT course_id, content_id, user_id, CAST(percentage AS DOUBLE) AS percentage, finished, opened, time_spent, "
              f"ROW_NUMBER() OVER (ORDER BY {sql_order}, course_id, content_id, user_id, finished, opened, time_spent, percentage) "
              "AS position FROM h5p_scores", "F4")
    def q_f4(d):
        h = d.h5p_scores.select("course_id", "content_id", "user_id", "percentage", "finished", "opened", "time_spent")
        return with_position(order_attempts(h, by=by))


_attempt_order("student", "percentage ASC, content_id")
_attempt_order("content", "percentage DESC, finished DESC, user_id")
