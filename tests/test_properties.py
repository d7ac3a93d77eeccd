"""Property checks: upsert idempotence, one latest prediction per key, folds
disjoint/complete/balanced, rank AUC = MLlib's, daily sums = event counts."""

import random

from pyspark.sql import functions as F

from edusignal.operators import evaluation as EV
from edusignal.operators import events as EVT
from edusignal.operators import predictions as P
from edusignal.operators.ranking import hex_bucket, md5_key, positions
from edusignal.operators.upsert import upsert
from edusignal.sources.fixtures import Domain

from .conftest import SMALL


def test_upsert_cases_and_idempotence(spark):
    t = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k long, v string, n long")
    s = spark.createDataFrame([(2, None, 99), (3, "c", 30)], "k long, v string, n long")
    once = upsert(t, s, ["k"], ["v"], "n")
    rows = {r.k: (r.v, r.n) for r in once.collect()}
    assert rows == {1: ("a", 10), 2: (None, 20), 3: ("c", 30)}  # only-target, matched NULL src, insert
    twice = upsert(once, s, ["k"], ["v"], "n")
    assert sorted(twice.collect()) == sorted(once.collect())


def test_save_predictions_leaves_one_latest_per_key(spark):
    d = Domain(spark, SMALL)
    new = d.predictions.where("model_name = 'model_0'").select(
        F.lit(None).cast("bigint").alias("id"), "user_id", "course_id", F.lit("m").alias("model_name"),
        F.lit("v").alias("model_version"), "fail_risk_score", "risk_level", "snapshot_grade",
        "snapshot_completion_rate", "snapshot_days_inactive", "predicted_at")
    for hist in (False, True):
        out = P.save_predictions(d.predictions, new, keep_history=hist)
        per_key = out.where("is_latest").groupBy("user_id", "course_id").count()
        assert per_key.where("count <> 1").count() == 0
        assert out.select("id").distinct().count() == out.count()


def test_positions_equal_one_task_window(spark):
    random.seed(7)
    rows = [(i, random.randint(0, 1)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, g int").withColumn("key", md5_key(1, "k"))
    a = positions(df, ["g"], "key", hex_bucket("key"), out="pos")
    from pyspark.sql import Window
    b = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("key")))
    j = a.join(b, ["k"]).where("pos <> rn")
    assert j.count() == 0


def test_folds_disjoint_complete_balanced(spark):
    d = Domain(spark, SMALL)
    lab = d.student_features.where("mooc_is_passed IS NOT NULL").select(
        "user_id", "course_id", (~F.col("mooc_is_passed")).cast("int").alias("label"))
    f = EV.stratified_folds(lab, "label", ["user_id", "course_id"], k=10)
    assert f.count() == lab.count()
    assert f.select("user_id", "course_id").distinct().count() == lab.count()
    spread = f.groupBy("label", "fold").count().groupBy("label").agg(
        (F.max("count") - F.min("count")).alias("spread")).collect()
    assert all(r.spread <= 1 for r in spread)


def test_rank_auc_matches_mllib(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    random.seed(3)
    rows = [(random.choice([0.1, 0.2, 0.5, 0.5, 0.9, random.random()]), random.randint(0, 1)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "score double, label int")
    ours = EV.auc_roc(df, "score", "label").collect()[0].auc_roc
    mllib = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label",
                                          metricName="areaUnderROC").evaluate(df.withColumn("label", F.col("label").cast("double")))
    assert abs(ours - mllib) < 1e-9


def test_daily_counts_sum_to_events(spark):
    d = Domain(spark, SMALL)
    total = EVT.daily_counts(d.activity).agg(F.sum("events")).collect()[0][0]
    assert total == d.base("events").count()
