"""Roster, statistics and prediction-summary queries (C1–C5, C12, D1–D2,
D11–D13, D17–D21, D25, D28, B2–B5, B7, B9, B10, B17, B18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import roster as R
from ..operators import stats as S
from ..operators.suggestions import suggestion_titles
from .base import AS_OF, hround, register

_LATEST_P = "(SELECT * FROM predictions WHERE is_latest)"

ROSTER_COLS = ("user_id:i course_id:s email:s full_name:s username:s mssv:s fail_risk_score:d "
               "raw_risk_score:d mooc_grade_percentage:d mooc_completion_rate:d "
               "days_since_last_activity:i mooc_is_passed:b model_name:s predicted_at:t "
               "risk_level:s completion_status:s")

# Every feature row with its names and newest score.
ROSTER_SQL = """
SELECT user_id, course_id, ifnull(n.enrolled_mail, n.sheet_mail) AS email, n.shown_name AS full_name, n.username, n.mssv,
       ifnull(l.score, 50) AS fail_risk_score, l.score AS raw_risk_score, f.mooc_grade_percentage, f.mooc_completion_rate,
       f.days_since_last_activity, f.mooc_is_passed, l.model_name, l.predicted_at, l.band AS risk_level,
       CASE f.mooc_is_passed WHEN TRUE THEN 'completed' WHEN FALSE THEN 'not_passed' ELSE 'in_progress' END AS completion_status
FROM student_features f JOIN student_names n USING (user_id, course_id) JOIN latest_scores l USING (user_id, course_id)
"""


def _roster_where(cond: str) -> str:
    return f"SELECT * FROM ({ROSTER_SQL}) r WHERE {cond}"


@register("roster", ROSTER_COLS, ROSTER_SQL, "C1 B7 B9 B10 Q2 Q3")
def q_roster(d):
    return R.roster(d.student_features, d.enrollments, d.mooc_grades, d.predictions)


for _lvl, _cond in (("high", "raw_risk_score >= 70"), ("medium", "raw_risk_score >= 40 AND raw_risk_score < 70"),
                    ("low", "raw_risk_score < 40")):
    register(f"roster_{_lvl}", ROSTER_COLS, _roster_where(_cond), "C1 B2 Q3")(
        (lambda lv: lambda d: R.roster(d.student_features, d.enrollments, d.mooc_grades,
                                       d.predictions, risk=lv.upper()))(_lvl))


@register("roster_inner", ROSTER_COLS,
          _roster_where("EXISTS (SELECT 1 FROM enrollments x WHERE x.user_id = r.user_id AND x.course_id = r.course_id)"),
          "C12")
def q_roster_inner(d):
    return R.roster(d.student_features, d.enrollments, d.mooc_grades, d.predictions, how="inner")


@register("roster_not_completed_search",
          ROSTER_COLS,
          _roster_where("completion_status <> 'completed' AND (contains(lower(full_name), 'customer#0000001') "
                        "OR contains(lower(email), 'customer#0000001') OR contains(user_id::VARCHAR, 'Customer#0000001'))"),
          "B4 B5")
def q_roster_search(d):
    r = R.roster(d.student_features, d.enrollments, d.mooc_grades, d.predictions)
    return R.search(R.completion_filter(r, "not_completed"), "Customer#0000001")


@register("roster_by_unit", ROSTER_COLS + " department:s class_code:s",
          f"SELECT r.*, u.department, u.class_code FROM ({ROSTER_SQL}) r "
          "JOIN enrollments u USING (user_id, course_id) WHERE u.department = 'dept_7'",
          "B18")
def q_roster_by_unit(d):
    r = R.roster(d.student_features, d.enrollments, d.mooc_grades, d.predictions)
    u = d.enrollments.select("user_id", "course_id", "department", "class_code")
    return R.by_unit(r.join(u, ["user_id", "course_id"]), department="dept_7")


# The suggestion rules in order: condition, title, description ({} is the number), priority.
_RULES = (
    (("risk_level = 'HIGH'", "Can thiệp khẩn cấp", "Sinh viên có nguy cơ bỏ học/rớt môn rất cao. Cần liên hệ ngay.", "high", ""),),
    (("days > 14", "Liên hệ trực tiếp", "Sinh viên không hoạt động {} ngày. Hãy gọi điện hoặc nhắn tin.", "high", "days"),
     ("days > 7", "Gửi email nhắc nhở", "Sinh viên không hoạt động {} ngày. Gửi email khuyến khích quay lại.", "medium", "days")),
    (("grade < 40", "Hỗ trợ học tập", "Điểm trung bình thấp ({}%). Cung cấp tài liệu bổ sung hoặc buổi phụ đạo.", "high", "grade"),
     ("grade < 60", "Kiểm tra tiến độ", "Điểm trung bình khá thấp ({}%). Theo dõi sát sao và gợi ý tài liệu.", "medium", "grade")),
    (("completion < 30", "Nhắc nhở lộ trình",
      "Tiến độ hoàn thành khóa học rất chậm ({}%). Nhắc nhở về deadline và kế hoạch học.", "high", "completion"),
     ("completion < 50", "Đánh giá lại mục tiêu",
      "Tiến độ hoàn thành khóa học chậm ({}%). Giúp sinh viên đặt mục tiêu thực tế hơn.", "medium", "completion")),
    (("interactions = 0 AND risk_level <> 'LOW'", "Khuyến khích tương tác",
      "Sinh viên không tham gia thảo luận. Khuyến khích đặt câu hỏi hoặc tham gia forum.", "medium", ""),),
    (("video < 50 AND risk_level <> 'LOW'", "Kiểm tra việc học video",
      "Tỷ lệ hoàn thành video thấp ({}%). Có thể sinh viên gặp khó khăn với nội dung video.", "medium", "video"),),
    (("quiz < 50 AND risk_level <> 'LOW'", "Hỗ trợ làm bài tập/quiz",
      "Điểm quiz trung bình thấp ({}%). Cung cấp thêm bài tập hoặc giải đáp thắc mắc.", "medium", "quiz"),),
)
_KEEP_ON = ("Tiếp tục theo dõi", "Sinh viên đang có tiến độ tốt. Tiếp tục duy trì và khuyến khích.", "low")


def _rule_case(rules, pos: int) -> str:
    """CASE of one rule group that yields a struct of position, title, description and priority."""
    arms = []
    for cond, title, text, priority, number in rules:
        shown = f"replace('{text}', '{{}}', CAST({number} AS VARCHAR))" if number else f"'{text}'"
        arms.append(f"WHEN {cond} THEN {{'pos': {pos}, 'title': '{title}', 'description': {shown}, 'priority': '{priority}'}}")
    return "CASE " + " ".join(arms) + " END"


_DETAIL_SQL = f"""
SELECT d.*, CASE WHEN len(fired) = 0 THEN [{{'pos': 0, 'title': '{_KEEP_ON[0]}', 'description': '{_KEEP_ON[1]}',
                                             'priority': '{_KEEP_ON[2]}'}}] ELSE fired END AS items
FROM (SELECT b.*, list_filter([{", ".join(_rule_case(r, i) for i, r in enumerate(_RULES))}], lambda x: x IS NOT NULL) AS fired
      FROM (SELECT user_id, course_id, n.shown_name AS full_name, ifnull(n.enrolled_mail, n.sheet_mail) AS email, n.username, n.mssv,
              l.shown AS fail_risk_score, CASE WHEN l.score IS NULL THEN 'MEDIUM' ELSE l.level END AS risk_level,
              ifnull(f.mooc_grade_percentage, 0.0) AS grade, ifnull(f.mooc_completion_rate, 0.0) AS completion,
              ifnull(f.days_since_last_activity, 0) AS days, ifnull(f.video_completion_rate, 0.0) AS video,
              ifnull(f.quiz_avg_score, 0.0) AS quiz, ifnull(f.discussion_threads_count, 0) AS threads,
              ifnull(t.total_interactions, 0) AS interactions, l.model_name, l.predicted_at
            FROM student_features f JOIN student_names n USING (user_id, course_id) JOIN latest_scores l USING (user_id, course_id)
            LEFT JOIN mooc_discussions t USING (user_id, course_id)) b) d"""


def _detail(d, features=None):
    return R.student_detail(d.student_features if features is None else features, d.enrollments, d.mooc_grades, d.predictions, d.mooc_discussions)


@register("student_detail",
          "user_id:i course_id:s full_name:s email:s username:s mssv:s fail_risk_score:d risk_level:s "
          "mooc_grade_percentage:d mooc_completion_rate:d days_since_last_activity:i "
          "video_completion_rate:d quiz_avg_score:d discussion_threads_count:i model_name:s "
          "predicted_at:t n_suggestions:i suggestion_titles:s",
          f"""
SELECT user_id, course_id, full_name, email, username, mssv, fail_risk_score, risk_level, grade AS mooc_grade_percentage,
  completion AS mooc_completion_rate, days AS days_since_last_activity, video AS video_completion_rate, quiz AS quiz_avg_score,
  threads AS discussion_threads_count, model_name, predicted_at, len(items) AS n_suggestions,
  array_to_string(list_transform(items, lambda x: x.title), ' | ') AS suggestion_titles
FROM ({_DETAIL_SQL}) x""",
          "C2 J1 L6")
def q_student_detail(d):
    df = _detail(d)
    return df.select("*", F.size("suggestions").alias("n_suggestions"),
                     suggestion_titles(F.col("suggestions")).alias("suggestion_titles"))


@register("suggestion_items", "user_id:i course_id:s position:i title:s description:s priority:s",
          f"""
SELECT user_id, course_id, generate_subscripts(items, 1) AS position, unnest(items).title AS title,
  unnest(items).description AS description, unnest(items).priority AS priority
FROM ({_DETAIL_SQL.replace("ifnull(f.quiz_avg_score, 0.0) AS quiz", "round(ifnull(f.quiz_avg_score, 0.0), 2) AS quiz")}) x""",
          "J1 texts and priorities")
def q_suggestion_items(d):
    """The average quiz score to two places, as its last digits depend on the order of adding."""
    f = d.student_features.withColumn("quiz_avg_score", F.round("quiz_avg_score", 2))
    return (_detail(d, f).select("user_id", "course_id", F.posexplode("suggestions").alias("pos", "s"))
            .select("user_id", "course_id", (F.col("pos") + 1).alias("position"), "s.title", "s.description", "s.priority"))


STATS_COLS = ("course_id:s total_students:i avg_risk_score:d avg_grade:d avg_completion_rate:d "
              "high_risk_count:i medium_risk_count:i low_risk_count:i completed_count:i "
              "not_passed_count:i in_progress_count:i")

# ``{open}`` says which students count by risk.
_STATS_SQL = """
SELECT course_id, count(*) AS total_students, avg(ifnull(l.score, 50)) AS avg_risk_score,
  ifnull(avg(f.mooc_grade_percentage), 0) AS avg_grade, ifnull(avg(f.mooc_completion_rate), 0) AS avg_completion_rate,
  count(*) FILTER (l.score >= 70 AND {open}) AS high_risk_count,
  count(*) FILTER (l.score BETWEEN 40 AND 69.999999 AND {open}) AS medium_risk_count,
  count(*) FILTER (l.score < 40 AND {open}) AS low_risk_count,
  count(*) FILTER (f.mooc_is_passed) AS completed_count, count(*) FILTER (NOT f.mooc_is_passed) AS not_passed_count,
  count(*) - count(f.mooc_is_passed) AS in_progress_count
FROM student_features f JOIN latest_scores l USING (user_id, course_id) GROUP BY course_id"""


@register("course_stats", STATS_COLS, _STATS_SQL.format(open="NOT f.mooc_is_passed"), "D2 C4 Q4")
def q_course_stats(d):
    return S.course_stats(d.student_features, d.predictions)


@register("course_stats_docs", STATS_COLS, _STATS_SQL.format(open="ifnull(NOT f.mooc_is_passed, TRUE)"), "D2 Q4-option")
def q_course_stats_docs(d):
    return S.course_stats(d.student_features, d.predictions, count_in_progress=True)


@register("course_list", "course_id:s student_count:i",
          "SELECT course_id, COUNT(DISTINCT user_id) AS student_count FROM student_features GROUP BY course_id",
          "D1 G2")
def q_course_list(d):
    return S.course_list(d.student_features)


@register("stat_cards",
          "course_id:s total_students:i completed_share:d not_passed_share:d in_progress_share:d "
          "high_share:d medium_share:d low_share:d risk_warning:b grade_warning:b completion_warning:b",
          "SELECT course_id, total_students, "
          "COALESCE(completed_count * 100.0 / NULLIF(total_students, 0), 0) AS completed_share, "
          "COALESCE(not_passed_count * 100.0 / NULLIF(total_students, 0), 0) AS not_passed_share, "
          "COALESCE(in_progress_count * 100.0 / NULLIF(total_students, 0), 0) AS in_progress_share, "
          "COALESCE(high_risk_count * 100.0 / NULLIF(high_risk_count + medium_risk_count + low_risk_count, 0), 0) AS high_share, "
          "COALESCE(medium_risk_count * 100.0 / NULLIF(high_risk_count + medium_risk_count + low_risk_count, 0), 0) AS medium_share, "
          "COALESCE(low_risk_count * 100.0 / NULLIF(high_risk_count + medium_risk_count + low_risk_count, 0), 0) AS low_share, "
          "avg_risk_score > 50 AS risk_warning, avg_grade < 50 AS grade_warning, "
          "avg_completion_rate < 50 AS completion_warning FROM (" + _STATS_SQL.format(open="NOT f.mooc_is_passed") + ") s",
          "D25")
def q_stat_cards(d):
    return S.stat_cards(S.course_stats(d.student_features, d.predictions))


@register("risk_distribution", "course_id:s risk_level:s student_count:i percent:d",
          f"""
SELECT t.course_id, l.level AS risk_level, COALESCE(c.n, 0) AS student_count,
       {hround('COALESCE(c.n, 0) * 100', 't.total', 1)} AS percent
FROM (SELECT course_id, COUNT(*) AS total FROM {_LATEST_P} GROUP BY course_id) t
CROSS JOIN (VALUES ('HIGH'), ('MEDIUM'), ('LOW')) l(level)
LEFT JOIN (SELECT course_id, risk_level, COUNT(*) AS n FROM {_LATEST_P} GROUP BY 1, 2) c
  ON c.course_id = t.course_id AND c.risk_level = l.level""",
          "D11")
def q_risk_distribution(d):
    return S.risk_distribution(d.predictions)


@register("prediction_profile",
          "course_id:s total:i min_risk:d max_risk:d avg_risk:d unique_scores:i",
          f"SELECT course_id, COUNT(*) AS total, MIN(fail_risk_score) AS min_risk, MAX(fail_risk_score) AS max_risk, "
          f"AVG(fail_risk_score) AS avg_risk, COUNT(DISTINCT fail_risk_score) AS unique_scores "
          f"FROM {_LATEST_P} GROUP BY course_id",
          "D12")
def q_prediction_profile(d):
    return S.prediction_profile(d.predictions)


@register("feature_health", "course_id:s total:i with_h5p:i avg_h5p_score:d avg_weeks:d",
          "SELECT course_id, COUNT(*) AS total, COUNT(CASE WHEN h5p_total_score > 0 THEN 1 END) AS with_h5p, "
          "AVG(h5p_total_score) AS avg_h5p_score, AVG(weeks_since_enrollment) AS avg_weeks "
          "FROM student_features GROUP BY course_id",
          "D13")
def q_feature_health(d):
    return S.feature_health(d.student_features)


_FS = ["mooc_grade_percentage", "mooc_completion_rate", "h5p_overall_percentage", "days_since_last_activity"]


@register("feature_stats", "course_id:s " + " ".join(f"{c}_mean:d {c}_std:d" for c in _FS),
          "SELECT course_id, " + ", ".join(f"AVG({c}) AS {c}_mean, STDDEV_SAMP({c}) AS {c}_std" for c in _FS)
          + " FROM student_features GROUP BY course_id",
          "D17")
def q_feature_stats(d):
    return S.feature_stats(d.student_features, _FS, by=["course_id"])


@register("grade_consistency", "course_id:s is_passed:b letter_grade:s count:i percentage:s",
          f"""
SELECT c.course_id, c.is_passed, c.letter_grade, c.cnt AS count,
       CAST(CAST({hround('c.cnt * 100', 't.total', 2)} AS DECIMAL(10,2)) AS VARCHAR) || '%' AS percentage
FROM (SELECT course_id, is_passed, letter_grade, COUNT(*) AS cnt FROM mooc_grades GROUP BY 1, 2, 3) c
JOIN (SELECT course_id, COUNT(*) AS total FROM mooc_grades GROUP BY 1) t ON c.course_id = t.course_id""",
          "D18 E5")
def q_grade_consistency(d):
    return S.grade_consistency(d.mooc_grades)


@register("grade_anomalies", "user_id:i course_id:s is_passed:b letter_grade:s grade_percentage:d",
          "SELECT user_id, course_id, is_passed, letter_grade, grade_percentage FROM mooc_grades "
          "WHERE (is_passed = TRUE AND (letter_grade IS NULL OR letter_grade <> 'Pass')) "
          "OR (is_passed = FALSE AND letter_grade NOT IN ('', NULL))",
          "B17 Q9")
def q_grade_anomalies(d):
    return S.grade_anomalies(d.mooc_grades)


_MC = ["mooc_grade_percentage", "mooc_letter_grade", "mooc_is_passed", "mooc_completion_rate"]


@register("missing_counts", "course_id:s " + " ".join(f"{c}_missing:i" for c in _MC),
          "SELECT course_id, " + ", ".join(f"SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS {c}_missing"
                                           for c in _MC) + " FROM student_features GROUP BY course_id",
          "D19")
def q_missing_counts(d):
    return S.missing_counts(d.student_features, _MC)


@register("compare_models",
          "model_name:s total_predictions:i avg_risk:d high_risk_count:i first_prediction:t last_prediction:t",
          "SELECT model_name, COUNT(*) AS total_predictions, AVG(fail_risk_score) AS avg_risk, "
          "SUM(CASE WHEN risk_level = 'HIGH' THEN 1 ELSE 0 END) AS high_risk_count, "
          "MIN(predicted_at) AS first_prediction, MAX(predicted_at) AS last_prediction "
          "FROM predictions GROUP BY model_name",
          "D20")
def q_compare_models(d):
    return S.compare_models(d.predictions)


@register("prediction_freshness", "course_id:s last_prediction:t latest_rows:i days_old:i is_stale:b",
          f"SELECT course_id, last_prediction, latest_rows, "
          f"CAST(FLOOR((epoch({AS_OF}) - epoch(last_prediction)) / 86400) AS BIGINT) AS days_old, "
          f"FLOOR((epoch({AS_OF}) - epoch(last_prediction)) / 86400) > 7 AS is_stale "
          f"FROM (SELECT course_id, MAX(predicted_at) AS last_prediction, COUNT(*) AS latest_rows "
          f"FROM {_LATEST_P} GROUP BY course_id) x",
          "D21")
def q_prediction_freshness(d):
    return S.prediction_freshness(d.predictions, d.as_of)


_VS = ["mooc_grade_percentage", "mooc_completion_rate", "h5p_overall_percentage"]


@register("vs_class", "user_id:i course_id:s " + " ".join(f"{m}:d class_avg_{m}:d diff_{m}:d" for m in _VS),
          "SELECT f.user_id, f.course_id, " + ", ".join(
              f"f.{m}, a.class_avg_{m}, f.{m} - a.class_avg_{m} AS diff_{m}" for m in _VS)
          + " FROM student_features f JOIN (SELECT course_id, "
          + ", ".join(f"AVG({m}) AS class_avg_{m}" for m in _VS)
          + " FROM student_features GROUP BY course_id) a ON f.course_id = a.course_id",
          "D28")
def q_vs_class(d):
    return S.vs_class(d.student_features, _VS)


# Students who haven't passed (yet), with the dashboard's defaults.
AT_RISK_SQL = """
SELECT user_id, course_id, ifnull(n.enrolled_name, 'Sinh viên') AS full_name, ifnull(n.enrolled_mail, '') AS email,
  ifnull(l.score, 50) AS fail_risk_score, ifnull(l.score, 0) AS order_score, ifnull(l.level, 'MEDIUM') AS risk_level,
  f.mooc_completion_rate, f.days_since_last_activity, f.mooc_grade_percentage, l.predicted_at
FROM student_features f JOIN student_names n USING (user_id, course_id) JOIN latest_scores l USING (user_id, course_id)
WHERE f.mooc_is_passed IS DISTINCT FROM TRUE"""


@register("at_risk_base",
          "user_id:i course_id:s full_name:s email:s fail_risk_score:d order_score:d risk_level:s "
          "mooc_completion_rate:d days_since_last_activity:i mooc_grade_percentage:d predicted_at:t",
          AT_RISK_SQL, "C3 B3")
def q_at_risk_base(d):
    return R.at_risk_base(d.student_features, d.enrollments, d.predictions)
