"""Landed-payload readers (A1–A12), sinks (A15, A17 versions, A18, A19) and
the two streams (N1, N2), on hand-written payloads in a scratch folder."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from edusignal.operators.events import daily_counts
from edusignal.sources import payloads as PL
from edusignal.sources import buckets as BK
from edusignal.sources import sinks as SK
from edusignal.sources.buckets import manifest, read_buckets, upsert_buckets
from edusignal.streaming import jobs as SJ

from .conftest import SMALL

ASOF = "2001-12-01 00:00:00"


def _put(root, course, kind, name, obj):
    d = os.path.join(root, course, kind)
    os.makedirs(d, exist_ok=True)
    with open(os.path.join(d, f"{name}.json"), "w") as fh:
        json.dump(obj, fh)


@pytest.fixture(scope="module")
def landing():
    root = tempfile.mkdtemp(prefix="edusignal-landing-")
    item = lambda uid, **kw: {"user_id": uid, "username": f"u{uid}", "email": f"u{uid}@x", **kw}
    # course A: three shapes over pages, the later ones short; every landed page counts
    _put(root, "A", "enrollments", "page_1", {"data": {"enrollments": [item(1), item(2, mode="verified")]}})
    _put(root, "A", "enrollments", "page_2", {"results": [item(3, student_info={"mssv": "S3"}), "junk"]})
    _put(root, "A", "enrollments", "page_3", {"enrollments": [item(4)]})
    # course B: data as a list; id instead of user_id
    _put(root, "B", "enrollments", "page_1", {"data": [{"id": 7, "created": "2024-01-02T03:04:05.5+07:00"}]})
    _put(root, "A", "course_info", "info", {"success": True, "data": {"display_name": "Course A",
                                                                     "start": "2024-01-01T00:00:00Z"}})
    _put(root, "A", "h5p", "1", {"scores": [{"content_id": 10, "score": 4, "max_score": 5, "percentage": 80,
                                             "opened": 100, "finished": 200, "time": 33}],
                                 "summary": {"total_contents": 10, "completed_contents": 1}})
    _put(root, "A", "video", "1", {"video_progress": [{"content_id": 5, "progress_percent": 100, "duration": 60}]})
    _put(root, "A", "combined", "1", {"overall": {"total_items": 4, "completed_items": 6, "overall_completion": 40}})
    _put(root, "A", "dashboard", "1", {"overview": {"overall_completion": 10}})
    _put(root, "A", "dashboard", "2", {"overview": {"overall_completion": 20, "total_items": 5}})
    _put(root, "A", "grades", "g", {"students": [{"user_id": 1, "grade_percentage": 70, "is_passed": True},
                                                 {"user_id": 2, "grade_percentage": 30}]})
    _put(root, "A", "progress", "p", {"students": [{"user_id": 1, "completion_rate": 55.5,
                                                    "last_activity": "2024-02-03T10:00:00Z"}]})
    _put(root, "A", "discussions", "d", {"students": [{"user_id": 1, "threads_count": 2}]})
    _put(root, "A", "stats_activity", "s", {"success": True, "summary": {"avg_score": 70, "total_activities": 10,
                                                                         "total_active_users": 4}})
    _put(root, "A", "stats_assessment", "s", {"success": True, "summary": {"avg_score": 60, "unique_students": 3,
                                                                           "total_attempts": 10}})
    _put(root, "A", "stats_progress", "s", {"success": True, "summary": {"avg_progress": 50, "total_students": 5}})
    return root


def test_enrollment_pages_shapes_and_all_pages(spark, landing):
    items = PL.read_enrollment_pages(spark, landing)
    got = sorted((r.course_id, r.user_key) for r in items.collect())
    assert got == [("A", 1), ("A", 2), ("A", 3), ("A", 4), ("B", 7)]
    flat = {(r.course_id, r.user_id): r for r in PL.flatten_enrollments(items, ASOF).collect()}
    assert flat[("A", 1)].mode == "audit" and flat[("A", 2)].mode == "verified"
    assert flat[("A", 3)].mssv == "S3" and flat[("A", 1)].mssv == "" and flat[("A", 1)].is_active is True
    assert str(flat[("B", None)].created) == "2024-01-02 03:04:05.500000"  # wall clock kept, offset cut


def test_parse_ts_formats(spark):
    df = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("2024-01-02T03:04:05.25+00:00",),
                                ("2024-01-02T03:04:05",), ("2024-01-02",), ("nonsense",), (None,)], "s string")
    got = [None if r.t is None else str(r.t) for r in df.select(PL.parse_ts("s").alias("t")).collect()]
    assert got == ["2024-01-02 03:04:05", "2024-01-02 03:04:05.250000", "2024-01-02 03:04:05",
                   "2024-01-02 00:00:00", None, None]


def test_per_user_payloads(spark, landing):
    detail, summary = PL.flatten_h5p(spark, landing, ASOF)
    r = detail.collect()[0]
    assert (r.user_id, r.course_id, r.time_spent, float(r.percentage)) == (1, "A", 33, 80.0)
    assert summary.collect()[0].total_score == 0
    vd, vs = PL.flatten_video(spark, landing, ASOF)
    assert vd.collect()[0].current_time == 0
    comb = PL.flatten_combined(spark, landing).collect()[0]
    assert comb.items_to_complete == 0  # max(0, 4 - 6)
    dash = PL.dashboard_summary(PL.flatten_combined(spark, landing), PL.flatten_dashboard(spark, landing))
    assert sorted(r.user_id for r in dash.collect()) == [1, 2]  # user 1 from A6, user 2 falls back to A7
    g = {r.user_id: r for r in PL.flatten_grades(spark, landing).collect()}
    assert g[1].letter_grade == "Pass" and g[2].letter_grade == "" and g[2].is_passed is False
    p = PL.flatten_progress(spark, landing).collect()[0]
    assert str(p.last_activity) == "2024-02-03 10:00:00"
    d = PL.flatten_discussions(spark, landing).collect()[0]
    assert d.threads_count == 2 and d.comments_count == 0
    info = PL.read_course_info(spark, landing).collect()[0]
    assert info.course_name == "Course A"


def test_benchmarks_from_stats(spark, landing):
    b = PL.benchmarks_from_stats(spark, landing).collect()[0]
    assert b.activity_avg_per_user == 2.5 and b.assessment_avg_attempts == 3.33
    assert b.total_students == 5  # max(assessment 3, progress 5)


def test_versioned_writes_and_export(spark):
    base = tempfile.mkdtemp(prefix="edusignal-tbl-")
    df = spark.createDataFrame([(1, "A", 1.0)], "user_id long, course_id string, x double")
    SK.write_version(df, base + "/t")
    SK.write_version(df.withColumn("x", F.lit(2.0)), base + "/t")
    assert SK.list_versions(spark, base + "/t") == [1, 2]
    assert SK.read_latest(spark, base + "/t").collect()[0].x == 2.0
    roster = spark.createDataFrame([(1, "c:1", 'A "q", b', None, "HIGH", 80.0, 1.0, 2.0, 3)],
                                   "user_id long, course_id string, full_name string, email string, risk_level string,"
                                   " fail_risk_score double, mooc_grade_percentage double, mooc_completion_rate double,"
                                   " days_since_last_activity long")
    SK.export_roster(roster, base + "/export")
    text = spark.read.text(base + "/export").collect()
    assert any('"A ""q"", b"' in r.value for r in text)
    assert SK.export_name("course-v1:ORG+X/Y", ASOF) == "early_warning_course-v1_ORG_X_Y_20011201.csv"
    posts = spark.createDataFrame([(1, "A", None, "email", "n"), (1, "A", "call", None, None)],
                                  SK.INTERVENTION_SCHEMA)
    out = SK.append_interventions(spark, posts, base + "/iv", ASOF)
    rows = sorted(r.intervention_type for r in out.collect())
    assert rows == ["call", "email"] and out.select("id").distinct().count() == 2


def _weeks(ev, src, weeks):
    """Weekly event files, landed in the given order."""
    week = F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 7)
    for w in weeks:
        ev.where(week == w).coalesce(1).write.mode("append").parquet(src)


@pytest.mark.parametrize("weeks,step", [((0, 1, 2, 3, 4, 5), 1), ((3, 0, 5, 1, 4, 2), None)])
def test_streaming_daily_counts_equal_batch(spark, weeks, step):
    """Ordered files one a trigger, and unordered files in one run, give the batch result."""
    scratch = tempfile.mkdtemp(prefix="edusignal-stream-")
    ev = spark.read.parquet(f"{SMALL}/events.parquet")
    src, out = os.path.join(scratch, "events"), os.path.join(scratch, "daily")
    _weeks(ev, src, weeks)
    assert SJ.daily_activity_stream(spark, src, out, name=f"n2-{os.path.basename(scratch)}", files_per_trigger=step) == 0
    streamed = SJ.streamed_with_open_days(spark, src, out)
    batch = ev.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).cast("bigint").alias("events"))
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0


def test_streaming_reports_what_came_too_late(spark):
    scratch = tempfile.mkdtemp(prefix="edusignal-stream-")
    ev = spark.read.parquet(f"{SMALL}/events.parquet")
    src, out, name = os.path.join(scratch, "events"), os.path.join(scratch, "daily"), f"n2-{os.path.basename(scratch)}"
    _weeks(ev, src, (2, 3))
    assert SJ.daily_activity_stream(spark, src, out, name=name) == 0
    _weeks(ev, src, (0,))
    assert SJ.daily_activity_stream(spark, src, out, name=name) > 0


def test_late_rows_are_kept_over_many_batches(spark):
    """More than a hundred micro-batches in no order, one of them replayed after a crash: the batch's counts."""
    scratch = tempfile.mkdtemp(prefix="edusignal-stream-")
    ev = spark.read.parquet(f"{SMALL}/events.parquet")
    src, base, name = os.path.join(scratch, "events"), os.path.join(scratch, "daily"), f"n2-{os.path.basename(scratch)}"
    rows = ev.limit(2000)
    rows.repartition(104, F.xxhash64("event_id")).write.parquet(src)
    courses = ev.select("user_id").distinct().select("user_id", F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("course_id"))

    def die(batch_id):
        if batch_id == 3:
            raise RuntimeError("killed")
    with pytest.raises(Exception, match="killed"):
        SJ.daily_counts_stream(spark, src, base, courses, name, 1, committed=die)
    SJ.daily_counts_stream(spark, src, base, courses, name, 1)
    assert manifest(spark, base)["version"] > 100
    got = read_buckets(spark, base).select("user_id", "course_id", "day", "events")
    want = (spark.read.parquet(src).join(courses, "user_id").groupBy("user_id", "course_id", F.to_date("ts").alias("day"))
            .agg(F.count(F.lit(1)).alias("events")))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def _stream(spark, landing, kind, **k):
    base = tempfile.mkdtemp(prefix="edusignal-n1-") + f"/{kind}"
    name = f"n1-{os.path.basename(os.path.dirname(base))}"
    SJ.payload_stream(spark, landing, base, kind, name=name, **k)
    return base, name


def test_streaming_payload_upsert(spark, landing):
    base, _ = _stream(spark, landing, "grades")
    t = {r.user_id: r for r in read_buckets(spark, base).collect()}
    assert set(t) == {1, 2} and t[1].letter_grade == "Pass"


@pytest.mark.parametrize("kind,n", [("enrollments", 5), ("h5p", 1), ("h5p_attempts", 1), ("video", 1), ("video_positions", 1), ("combined", 1),
                                    ("dashboard", 2), ("progress", 1), ("discussions", 1), ("course_info", 1),
                                    ("stats_activity", 1), ("stats_assessment", 1), ("stats_progress", 1)])
def test_streaming_payloads_of_every_kind(spark, landing, kind, n):
    base, _ = _stream(spark, landing, kind)
    assert read_buckets(spark, base).count() == n


def test_streamed_tables_are_the_batch_tables(spark, landing):
    """Attempts, positions and the benchmarks made from streamed statistics equal what a batch reads."""
    detail, _ = PL.flatten_h5p(spark, landing, ASOF)
    got = read_buckets(spark, _stream(spark, landing, "h5p_attempts", as_of=ASOF)[0]).select(detail.columns)
    assert got.exceptAll(detail).count() == 0 and detail.exceptAll(got).count() == 0
    stats = [read_buckets(spark, _stream(spark, landing, k)[0]) for k in ("stats_activity", "stats_assessment", "stats_progress")]
    assert PL.stats_benchmarks(*stats).collect() == PL.benchmarks_from_stats(spark, landing).collect()


def test_streaming_payload_landed_last_counts(spark):
    root = tempfile.mkdtemp(prefix="edusignal-landing-")
    for k, grade in enumerate((10, 90)):
        _put(root, "A", "grades", f"g{k}", {"students": [{"user_id": 1, "grade_percentage": grade}]})
        os.utime(os.path.join(root, "A", "grades", f"g{k}.json"), (1_000_000 + 100 * k,) * 2)
    base, _ = _stream(spark, root, "grades")
    assert [float(r.grade_percentage) for r in read_buckets(spark, base).collect()] == [90.0]


def test_a_batch_killed_after_its_commit_is_not_applied_twice(spark):
    root = tempfile.mkdtemp(prefix="edusignal-landing-")
    _put(root, "A", "h5p", "1", {"scores": [{"content_id": 5, "score": 4, "max_score": 5}]})
    base = tempfile.mkdtemp(prefix="edusignal-n1-") + "/attempts"
    name = f"n1-{os.path.basename(os.path.dirname(base))}"

    def die(batch_id):
        raise RuntimeError("killed")
    with pytest.raises(Exception, match="killed"):
        SJ.payload_stream(spark, root, base, "h5p_attempts", name=name, committed=die)
    before = manifest(spark, base)
    assert before["version"] == 1 and before["batches"] == {name: 0}
    SJ.payload_stream(spark, root, base, "h5p_attempts", name=name)  # replays batch 0
    assert manifest(spark, base) == before and read_buckets(spark, base).count() == 1
    _put(root, "A", "h5p", "2", {"scores": [{"content_id": 6, "score": 4, "max_score": 5}]})
    SJ.payload_stream(spark, root, base, "h5p_attempts", name=name)
    assert manifest(spark, base)["batches"][name] == 1 and read_buckets(spark, base).count() == 2


# --- bucketed tables

def _grades(spark, rows):
    return spark.createDataFrame(rows, "user_id long, course_id string, grade double, at int")


def test_an_upsert_leaves_other_buckets_alone(spark):
    base = tempfile.mkdtemp(prefix="edusignal-buckets-") + "/t"
    first = upsert_buckets(spark, base, _grades(spark, [(i, "A", 1.0, 0) for i in range(500)]), ["user_id", "course_id"], "at", buckets=16)
    second = upsert_buckets(spark, base, _grades(spark, [(7, "A", 9.0, 1), (7, "A", 8.0, 0), (1000, None, 2.0, 1)]), ["user_id", "course_id"], "at")
    kept = [b for b in first["files"] if first["files"][b] == second["files"].get(b)]
    assert second["version"] == 2 and second["buckets"] == 16 and 13 <= len(kept) <= 15
    got = {(r["user_id"], r["course_id"]): r["grade"] for r in read_buckets(spark, base).collect()}
    assert len(got) == 501 and got[7, "A"] == 9.0 and got[8, "A"] == 1.0 and got[1000, None] == 2.0
    assert upsert_buckets(spark, base, _grades(spark, []), ["user_id", "course_id"], "at") == second


def test_of_two_writers_one_fails_cleanly(spark, monkeypatch):
    base = tempfile.mkdtemp(prefix="edusignal-buckets-") + "/t"
    keys = ["user_id", "course_id"]
    upsert_buckets(spark, base, _grades(spark, [(1, "A", 1.0, 0)]), keys, "at")
    real, turn = BK._commit, []

    def late(*args):
        if not turn:  # another writer commits while this one is about to
            turn.append(1)
            upsert_buckets(spark, base, _grades(spark, [(2, "A", 2.0, 0)]), keys, "at")
        real(*args)
    monkeypatch.setattr(BK, "_commit", late)
    with pytest.raises(BK.VersionTaken):
        upsert_buckets(spark, base, _grades(spark, [(1, "A", 5.0, 0)]), keys, "at")
    assert sorted((r["user_id"], r["grade"]) for r in read_buckets(spark, base).collect()) == [(1, 1.0), (2, 2.0)]
    assert manifest(spark, base)["version"] == 2
    upsert_buckets(spark, base, _grades(spark, [(1, "A", 5.0, 0)]), keys, "at")  # tried again, it goes through
    assert sorted((r["user_id"], r["grade"]) for r in read_buckets(spark, base).collect()) == [(1, 5.0), (2, 2.0)]


def test_export_names_of_long_courses_differ():
    a, b = ("c" * 90 + x for x in "ab")
    assert SK.export_name(a, ASOF) != SK.export_name(b, ASOF)


def test_daily_counts_match_streaming_batch_twin(spark):
    from edusignal.sources.fixtures import Domain
    d = Domain(spark, SMALL)
    assert daily_counts(d.activity).count() > 0
