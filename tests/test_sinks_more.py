"""CSV readers/sinks (A14, A15, A16, A21), describe (A20), user cap (A22), scan."""

import os
import tempfile

from pyspark.sql import functions as F

from edusignal.sources import payloads as PL
from edusignal.sources import sinks as SK

ASOF = "2001-12-01 00:00:00"


def test_csv_roundtrip_and_partitioned_predictions(spark):
    d = tempfile.mkdtemp(prefix="edusignal-csv-")
    df = spark.createDataFrame([(1, "A", 12.5), (2, "B", 80.0)], "user_id long, course_id string, fail_risk_score double")
    SK.write_features(df, os.path.join(d, "features"))
    back = SK.read_features_csv(spark, os.path.join(d, "features"), "user_id long, course_id string, fail_risk_score double")
    assert sorted(back.collect()) == sorted(df.collect())
    SK.write_predictions(df, os.path.join(d, "pred"), ASOF)
    assert os.path.isdir(os.path.join(d, "pred", "course_id=A", "day=20011201"))


def test_scan_prunes_course_partitions(spark):
    d = tempfile.mkdtemp(prefix="edusignal-scan-")
    df = spark.createDataFrame([(1, "A"), (2, "B")], "user_id long, course_id string")
    df.write.partitionBy("course_id").parquet(os.path.join(d, "t"))
    one = SK.scan(spark, os.path.join(d, "t"), "A")
    assert [r.user_id for r in one.collect()] == [1]
    assert "PartitionFilters: [isnotnull(course_id" in one._jdf.queryExecution().executedPlan().toString()


def test_eval_sink_feature_list_and_describe(spark):
    d = tempfile.mkdtemp(prefix="edusignal-eval-")
    folds = spark.createDataFrame([("m", 0, 0.9), ("m", 1, 0.8)], "model string, fold int, auc_roc double")
    summary = folds.groupBy("model").agg(F.avg("auc_roc").alias("auc_mean"))
    SK.write_eval(folds, summary, d)
    assert abs(spark.read.json(os.path.join(d, "summary_json")).collect()[0].auc_mean - 0.85) < 1e-12
    with open(os.path.join(d, "imp.csv"), "w") as fh:
        fh.write("feature,importance\nmooc_completion_rate,5.1\nvideo_completion_rate,3.2\n")
    names = [r.feature for r in SK.read_feature_list(spark, os.path.join(d, "imp.csv")).collect()]
    assert names == ["mooc_completion_rate", "video_completion_rate"]
    rep = SK.describe_table(folds, 1)
    assert rep["columns"][0][0] == "model" and len(rep["sample"]) == 1


def test_limit_users_per_course(spark):
    users = spark.createDataFrame([(u, c) for c in "AB" for u in range(5)], "user_id long, course_id string")
    got = sorted((r.course_id, r.user_id) for r in PL.limit_users(users, 2).collect())
    assert got == [("A", 0), ("A", 1), ("B", 0), ("B", 1)]
    assert PL.distinct_users(users.unionByName(users)).count() == 10
