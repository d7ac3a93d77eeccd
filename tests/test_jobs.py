"""End-to-end jobs: retrain (K16) -> daily prediction (K15), and the ETL (L-1)."""

import os
import tempfile

from pyspark.sql import functions as F

from edusignal.operators import wide as W
from edusignal.plans import jobs as J
from edusignal.plans.q_wide import _bench
from edusignal.sources.fixtures import Domain
from edusignal.sources.sinks import read_latest

from .conftest import SMALL
from .test_sources_streaming import landing  # noqa: F401  (fixture)

ASOF = "2001-12-01 00:00:00"


def _raw(spark):
    d = Domain(spark, SMALL)
    return W.build_raw(d.enrollments, d.h5p_scores, d.video_progress, d.mooc_grades, d.mooc_progress,
                       d.mooc_discussions, _bench(d), d.as_of)


def test_retrain_then_daily_prediction(spark):
    scratch = tempfile.mkdtemp(prefix="edusignal-jobs-")
    raw = _raw(spark)
    metrics = J.retrain(spark, raw, os.path.join(scratch, "model")).collect()[0]
    assert 0.0 <= metrics.accuracy <= 1.0
    dist = J.daily_prediction(spark, raw, os.path.join(scratch, "model"), os.path.join(scratch, "predictions"),
                              os.path.join(scratch, "csv"), ASOF)
    assert {r.risk_level for r in dist.collect()} == {"HIGH", "MEDIUM", "LOW"}
    preds = read_latest(spark, os.path.join(scratch, "predictions"))
    assert preds.count() == raw.count()
    assert preds.where((F.col("fail_risk_score") < 0) | (F.col("fail_risk_score") > 100)).count() == 0
    # a second run replaces each student's row (L1): still one latest row per key
    J.daily_prediction(spark, raw, os.path.join(scratch, "model"), os.path.join(scratch, "predictions"),
                       os.path.join(scratch, "csv"), ASOF)
    again = read_latest(spark, os.path.join(scratch, "predictions"))
    assert again.groupBy("user_id", "course_id").count().where("count <> 1").count() == 0
    csv = spark.read.option("header", True).csv(os.path.join(scratch, "csv"))
    assert csv.count() == raw.count()  # the second run replaced the day's files


def test_etl_builds_wide_rows(spark, landing):  # noqa: F811
    wh = tempfile.mkdtemp(prefix="edusignal-wh-")
    out = J.etl(spark, landing, wh, ASOF)
    raw = spark.read.parquet(out["raw_data"])
    assert raw.select("course_id", "user_id").distinct().count() == raw.count()
    row = raw.where("course_id = 'A' AND user_id = 1").collect()[0]
    assert row.mooc_completion_rate == 55.5 and row.discussion_threads_count == 2
    # re-running with the same landing is an idempotent upsert for keyed tables
    out2 = J.etl(spark, landing, wh, ASOF)
    for name in out:
        once, twice = spark.read.parquet(out[name]), spark.read.parquet(out2[name])
        assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0, name
    # totals come from the stored summary (10 contents there, 1 in the attempts)
    assert row.h5p_total_contents == 10 and row.h5p_completed_contents == 1
