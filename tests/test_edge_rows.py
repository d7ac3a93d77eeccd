"""Hand-made edge rows (FIXTURES.md §3) for the NULL/zero/boundary quirks."""

from datetime import datetime

from pyspark.sql import functions as F

from edusignal.functions import expr as E
from edusignal.operators import dashboard as DB
from edusignal.operators import exercises as X
from edusignal.operators import features as FE
from edusignal.operators import roster as R
from edusignal.operators import stats as S
from edusignal.operators.suggestions import suggestion_text, suggestions


def test_risk_level_boundaries_and_zero_as_missing(spark):
    df = spark.createDataFrame([(0.0,), (39.99,), (40.0,), (69.99,), (70.0,), (None,)], "s double")
    rows = df.select(E.risk_level(E.display_score("s")).alias("lv"), E.risk_level("s").alias("raw")).collect()
    assert [r.lv for r in rows] == ["MEDIUM", "LOW", "MEDIUM", "MEDIUM", "HIGH", "MEDIUM"]  # Q2: 0 and NULL -> 50
    assert [r.raw for r in rows] == ["LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH", None]


def test_completion_status_accepts_bool_int_text(spark):
    df = spark.createDataFrame([("true",), ("false",), (None,), ("1",), ("0",), ("x",)], "p string")
    got = [r.s for r in df.select(E.completion_status("p").alias("s")).collect()]
    assert got == ["completed", "not_passed", "in_progress", "completed", "not_passed", "in_progress"]


def _students(spark):
    rows = [(1, "C", 0.0, True), (2, "C", 39.99, False), (3, "C", 40.0, None), (4, "C", 69.99, False),
            (5, "C", 70.0, None), (6, "C", None, False)]
    f = spark.createDataFrame([(u, c, 50.0, 50.0, 3, p) for u, c, _, p in rows],
                              "user_id long, course_id string, mooc_grade_percentage double, "
                              "mooc_completion_rate double, days_since_last_activity long, mooc_is_passed boolean")
    p = spark.createDataFrame([(u, c, s, True, "m", None) for u, c, s, _ in rows if s is not None],
                              "user_id long, course_id string, fail_risk_score double, is_latest boolean, "
                              "model_name string, predicted_at timestamp")
    return f, p


def test_course_stats_literal_null_semantics(spark):
    f, p = _students(spark)
    r = S.course_stats(f, p).collect()[0]
    # Q4: in-progress (NULL) students are in no risk count; unscored student weighs 50
    assert (r.high_risk_count, r.medium_risk_count, r.low_risk_count) == (0, 1, 1)
    assert (r.completed_count, r.not_passed_count, r.in_progress_count) == (1, 3, 2)
    assert abs(r.avg_risk_score - (0 + 39.99 + 40 + 69.99 + 70 + 50) / 6) < 1e-9
    r2 = S.course_stats(f, p, count_in_progress=True).collect()[0]
    assert (r2.high_risk_count, r2.medium_risk_count, r2.low_risk_count) == (1, 2, 1)


def test_roster_risk_filter_drops_unscored(spark):
    f, p = _students(spark)
    e = spark.createDataFrame([], "user_id long, course_id string, email string, full_name string, "
                                  "full_name_vn string, username string, mssv string")
    g = spark.createDataFrame([], "user_id long, course_id string, email string, full_name string")
    all_rows = R.roster(f, e, g, p)
    assert all_rows.count() == 6
    med = {r.user_id for r in R.roster(f, e, g, p, risk="MEDIUM").collect()}
    assert med == {3, 4}  # user 6 shows MEDIUM (score 50) but vanishes under the filter (Q3)
    lv = {r.user_id: r.risk_level for r in all_rows.collect()}
    assert lv[1] == "MEDIUM" and lv[6] == "MEDIUM"


def test_inactivity_and_alert_boundaries(spark):
    days = [6, 7, 8, 14, 15, 30, 31, 999, None]
    base = spark.createDataFrame(
        [(i, "C", "n", "", 50.0, 50.0, "MEDIUM", 0.0 if d is None else 10.0, d, 0.0, None)
         for i, d in enumerate(days)],
        "user_id long, course_id string, full_name string, email string, fail_risk_score double, "
        "order_score double, risk_level string, mooc_completion_rate double, days_since_last_activity long, "
        "mooc_grade_percentage double, predicted_at timestamp")
    al = DB.explode_alerts(base, "2001-12-01 00:00:00")
    inactive = {r.user_id for r in al.where("alert_type = 'inactive'").collect()}
    assert inactive == {1, 2, 3, 4, 5, 6, 7}
    low = {r.user_id for r in al.where("alert_type = 'low_progress'").collect()}
    assert low == set(range(8))  # completion 10 in (0, 30); NULL days row has completion 0
    q = DB.quick_stats(base).collect()[0]
    assert q.inactive_students_count == 7 and q.new_high_risk_count == 0


def test_suggestion_rules(spark):
    df = spark.createDataFrame([("HIGH", 15, 35.0, 20.0, 40.0, 40.0), ("LOW", 0, 90.0, 90.0, 90.0, 90.0)],
                               "r string, d long, g double, c double, v double, q double")
    rows = df.select(suggestions("r", "d", "g", "c", None, "v", "q").alias("s"),
                     suggestion_text("d", "g", "c", None, "v", "q", None).alias("t")).collect()
    titles = [x.title for x in rows[0].s]
    assert titles[0] == "Can thiệp khẩn cấp" and len(titles) == 7
    assert "15" in rows[0].s[1].description
    assert [x.title for x in rows[1].s] == ["Tiếp tục theo dõi"]
    assert rows[1].t.startswith("✅")


def test_exercise_zero_finished_quirk(spark):
    h = spark.createDataFrame(
        [(1, "C", 1, 0.0, 0), (1, "C", 2, 50.0, 0), (1, "C", 3, 95.0, 0), (1, "C", 4, 0.0, 10),
         (1, "C", 5, 50.0, 10), (1, "C", 6, 80.0, 10), (1, "C", 7, 90.0, 10), (1, "C", 8, 100.0, 10)],
        "user_id long, course_id string, content_id long, p double, finished long") \
        .withColumn("percentage", F.col("p").cast("decimal(5,2)"))
    lit = X.h5p_student_stats(h).collect()[0]
    assert lit.total_in_progress == 0 and lit.total_attempted == 8  # Q6: epoch 0 is a date
    doc = X.h5p_student_stats(h, zero_finished="in_progress").collect()[0]
    assert doc.total_in_progress == 3 and doc.total_attempted == 5
    bands = {r.content_id: r.band for r in X.performance_bands(h).collect()}
    assert bands[3] == "not_attempted" and bands[6] == "high_performers" and bands[4] == "low_performers"


def test_course_window_features_zero_max_and_single_student(spark):
    df = spark.createDataFrame(
        [(1, "A", 0.0, 50.0, 50.0, 50.0, 50.0, 3.0, 4.0), (2, "A", 0.0, 60.0, 60.0, None, 60.0, 40.0, 0.0),
         (3, "B", 5.0, 10.0, 20.0, 30.0, 40.0, None, -1.0)],
        "user_id long, course_id string, discussion_total_interactions double, mooc_completion_rate double, "
        "video_completion_rate double, h5p_completion_rate double, quiz_avg_score double, "
        "days_since_last_activity double, weeks_since_enrollment double")
    out = {r.user_id: r for r in FE.all_features(df).collect()}
    assert out[1].discussion_score == 0.0                       # course max 0 counts as 1
    assert out[3].discussion_score == 100.0                     # single student is the max
    assert out[2].engagement_score == 0.0                       # any NULL part -> 0
    assert out[3].relative_completion == 0.0
    assert out[1].enrollment_phase == "early" and out[3].enrollment_phase is None
    assert out[2].progress_rate == 60.0                         # weeks 0 -> 1
    assert out[3].activity_recency == 0.0                       # NULL days -> filled 0


def test_initials_and_course_parts(spark):
    df = spark.createDataFrame([("Nguyen Van An", "course-v1:ORG+CS101+2024"), (None, "PLAIN"),
                                ("Solo", "x:A++")], "n string, c string")
    rows = df.select(E.initials("n").alias("i"), *E.course_parts("c")).collect()
    assert [r.i for r in rows] == ["VA", "SV", "S"]
    assert (rows[0].org, rows[0].code, rows[0].term) == ("ORG", "CS101", "2024")
    assert (rows[1].org, rows[1].code, rows[1].term) == ("Unknown", "PLAIN", "Unknown")
    assert (rows[2].org, rows[2].code, rows[2].term) == ("A", "Unknown", "Unknown")


def test_results_do_not_depend_on_session_time_zone(spark):
    from edusignal.plans.registry import REGISTRY
    from .conftest import SMALL
    names = ["content_students", "assessment_details", "roster", "activity_stats"]
    utc = {n: sorted(REGISTRY[n].run(spark, SMALL).collect()) for n in names}
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        for n in names:
            assert sorted(REGISTRY[n].run(spark, SMALL).collect()) == utc[n], n
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_floor_days_counts_whole_24h_units(spark):
    df = spark.createDataFrame([(datetime(2001, 11, 30, 0, 0, 1),), (datetime(2001, 11, 24, 0, 0, 0),)], "t timestamp")
    got = [r.d for r in df.select(E.floor_days(F.col("t").cast("timestamp_ntz")).alias("d")).collect()]
    assert got == [0, 7]
