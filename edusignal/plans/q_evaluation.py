"""Evaluation queries (E7, E8, K2, K5, D15, D16, D24, J6) over a labelled,
scored frame derived from the tables: label 1 = failed (pass flag false),
score = each model's predicted fail risk / 100."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as EV
from .base import register

KEYS = ["user_id", "course_id"]
MODELS = ["model_0", "model_1", "model_2"]


def labelled(d):
    return d.student_features.where(F.col("mooc_is_passed").isNotNull()).select(
        *KEYS, (~F.col("mooc_is_passed")).cast("int").alias("label"))


def scored(d):
    p = d.predictions.select(*KEYS, "model_name", (F.col("fail_risk_score") / 100).alias("score"))
    return labelled(d).join(p, KEYS)


def folds(d, k=10):
    return EV.stratified_folds(labelled(d), "label", KEYS, k=k, seed=42)


def fold_metrics(d):
    x = scored(d).join(folds(d).select(*KEYS, "fold"), KEYS)
    return EV.evaluate(x, "score", "label", ["model_name", "fold"]).withColumnRenamed("model_name", "model")


_LAB = """lab AS (SELECT user_id, course_id, CAST(NOT mooc_is_passed AS INT) AS label FROM student_features
              WHERE mooc_is_passed IS NOT NULL)"""
_FOLDS = """fo AS (SELECT user_id, course_id, label,
              CAST((ROW_NUMBER() OVER (PARTITION BY label ORDER BY md5('42-' || CAST(user_id AS VARCHAR) || '-' || course_id),
                    user_id, course_id) - 1) % 10 AS INT) AS fold FROM lab)"""
_SCORED = """sc AS (SELECT l.user_id, l.course_id, l.label, p.model_name, p.fail_risk_score / 100 AS score
              FROM lab l JOIN predictions p ON p.user_id = l.user_id AND p.course_id = l.course_id)"""


def _metrics_sql(group: str) -> str:
    """Per-group confusion, metrics and rank AUC over a relation ``x``."""
    return f"""
cm AS (SELECT {group},
         SUM(CASE WHEN label = 0 AND score < 0.5 THEN 1 ELSE 0 END) AS tn,
         SUM(CASE WHEN label = 0 AND score >= 0.5 THEN 1 ELSE 0 END) AS fp,
         SUM(CASE WHEN label = 1 AND score < 0.5 THEN 1 ELSE 0 END) AS fn,
         SUM(CASE WHEN label = 1 AND score >= 0.5 THEN 1 ELSE 0 END) AS tp FROM x GROUP BY {group}),
rk AS (SELECT {group}, label,
         RANK() OVER (PARTITION BY {group} ORDER BY score)
           + (COUNT(*) OVER (PARTITION BY {group}, score) - 1) / 2.0 AS r FROM x),
au AS (SELECT {group}, CASE WHEN SUM(label) > 0 AND COUNT(*) - SUM(label) > 0 THEN
         (SUM(CASE WHEN label = 1 THEN r ELSE 0 END) - SUM(label) * (SUM(label) + 1) / 2.0)
         / (SUM(label) * (COUNT(*) - SUM(label))) END AS auc_roc FROM rk GROUP BY {group}),
mt AS (SELECT cm.*, (tp + tn) * 1.0 / (tp + tn + fp + fn) AS accuracy,
         CASE WHEN tp + fp > 0 THEN tp * 1.0 / (tp + fp) ELSE 0.0 END AS precision,
         CASE WHEN tp + fn > 0 THEN tp * 1.0 / (tp + fn) ELSE 0.0 END AS recall FROM cm)"""


_FM_COLS = "model:s fold:i tn:i fp:i fn:i tp:i accuracy:d precision:d recall:d f1_score:d auc_roc:d"
_FM_SQL = f"""
WITH {_LAB}, {_FOLDS}, {_SCORED},
x AS (SELECT sc.*, fo.fold FROM sc JOIN fo ON sc.user_id = fo.user_id AND sc.course_id = fo.course_id),
{_metrics_sql('model_name, fold')}
SELECT mt.model_name AS model, mt.fold, tn, fp, fn, tp, accuracy, precision, recall,
  CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1_score,
  au.auc_roc
FROM mt LEFT JOIN au ON au.model_name = mt.model_name AND au.fold = mt.fold"""


@register("stratified_folds", "user_id:i course_id:s label:i fold:i",
          f"WITH {_LAB}, {_FOLDS} SELECT user_id, course_id, label, fold FROM fo", "E7")
def q_folds(d):
    return folds(d)


@register("fold_balance", "label:i fold:i n:i",
          f"WITH {_LAB}, {_FOLDS} SELECT label, fold, COUNT(*) AS n FROM fo GROUP BY 1, 2", "E7 balance")
def q_fold_balance(d):
    return folds(d).groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n"))


@register("stratified_split", "user_id:i course_id:s label:i is_test:b", f"""
WITH {_LAB}
SELECT user_id, course_id, label,
  ROW_NUMBER() OVER (PARTITION BY label ORDER BY md5('42-' || CAST(user_id AS VARCHAR) || '-' || course_id),
                     user_id, course_id) <= FLOOR(COUNT(*) OVER (PARTITION BY label) * 0.2 + 0.5) AS is_test
FROM lab""", "K2")
def q_split(d):
    return EV.stratified_split(labelled(d), "label", KEYS, 0.2, 42)


@register("auc_by_course", "course_id:s model:s auc_roc:d", f"""
WITH {_LAB}, {_SCORED}, x AS (SELECT * FROM sc),
rk AS (SELECT course_id, model_name, label,
         RANK() OVER (PARTITION BY course_id, model_name ORDER BY score)
           + (COUNT(*) OVER (PARTITION BY course_id, model_name, score) - 1) / 2.0 AS r FROM x)
SELECT course_id, model_name AS model, CASE WHEN SUM(label) > 0 AND COUNT(*) - SUM(label) > 0 THEN
  (SUM(CASE WHEN label = 1 THEN r ELSE 0 END) - SUM(label) * (SUM(label) + 1) / 2.0)
  / (SUM(label) * (COUNT(*) - SUM(label))) END AS auc_roc
FROM rk GROUP BY 1, 2""", "E8")
def q_auc(d):
    return EV.auc_roc(scored(d), "score", "label", ["course_id", "model_name"]) \
        .withColumnRenamed("model_name", "model")


@register("evaluate_models", "model:s tn:i fp:i fn:i tp:i accuracy:d precision:d recall:d f1_score:d auc_roc:d",
          f"""
WITH {_LAB}, {_SCORED}, x AS (SELECT * FROM sc),
{_metrics_sql('model_name')}
SELECT mt.model_name AS model, tn, fp, fn, tp, accuracy, precision, recall,
  CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1_score,
  au.auc_roc
FROM mt LEFT JOIN au ON au.model_name = mt.model_name""", "K5 E8")
def q_evaluate(d):
    return EV.evaluate(scored(d), "score", "label", ["model_name"]).withColumnRenamed("model_name", "model")


@register("class_report", "model:s class:s precision:d recall:d f1_score:d support:i", f"""
WITH {_LAB}, {_SCORED}, sides AS (
  SELECT model_name AS model, label AS class, label, (score >= 0.5)::INT AS said FROM sc
  UNION ALL SELECT model_name, 1 - label, label, (score >= 0.5)::INT FROM sc),
per AS (SELECT model, class,
    ifnull(count(*) FILTER (label = class AND said = class) / nullif(count(*) FILTER (said = class), 0)::DOUBLE, 0) AS precision,
    ifnull(count(*) FILTER (label = class AND said = class) / nullif(count(*) FILTER (label = class), 0)::DOUBLE, 0) AS recall,
    count(*) FILTER (label = class) AS support FROM sides GROUP BY ALL),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1_score FROM per)
SELECT model, class::VARCHAR AS class, precision, recall, f1_score, support FROM f
UNION ALL SELECT model, 'macro', avg(precision), avg(recall), avg(f1_score), sum(support) FROM f GROUP BY model
UNION ALL SELECT model, 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
  sum(f1_score * support) / sum(support), sum(support) FROM f GROUP BY model""", "K5 per class")
def q_class_report(d):
    return EV.class_report(EV.evaluate(scored(d), "score", "label", ["model_name"]).withColumnRenamed("model_name", "model"), ["model"])


@register("fold_metrics", _FM_COLS, _FM_SQL, "K5 per fold E7")
def q_fold_metrics(d):
    return fold_metrics(d)


_UNPIVOT = " UNION ALL ".join(f"SELECT model, '{m}' AS metric, {m} AS value FROM fm"
                              for m in EV.METRICS)


@register("kfold_summary", "model:s metric:s mean:d std:d min:d max:d n_folds:i stability:s", f"""
WITH fm AS ({_FM_SQL}), lng AS ({_UNPIVOT}),
s AS (SELECT model, metric, AVG(value) AS mean, STDDEV_POP(value) AS std, MIN(value) AS min, MAX(value) AS max,
        COUNT(*) AS n_folds FROM lng GROUP BY 1, 2)
SELECT *, CASE WHEN std < 0.02 THEN 'Very Stable [OK]' WHEN std < 0.05 THEN 'Stable'
               WHEN std < 0.10 THEN 'Moderately Stable' ELSE 'Unstable [!]' END AS stability FROM s""",
          "D15 J6")
def q_kfold_summary(d):
    return EV.kfold_summary(fold_metrics(d), by=["model"])


@register("comparison_summary", "model:s metric:s mean:d std:d is_best:b", f"""
WITH fm AS ({_FM_SQL}), lng AS ({_UNPIVOT}),
s AS (SELECT model, metric, AVG(value) AS mean, STDDEV_SAMP(value) AS std FROM lng GROUP BY 1, 2)
SELECT model, metric, mean, std,
  ROW_NUMBER() OVER (PARTITION BY metric ORDER BY mean DESC,
    CASE model WHEN 'model_0' THEN 0 WHEN 'model_1' THEN 1 WHEN 'model_2' THEN 2 ELSE 3 END) = 1 AS is_best
FROM s""", "D16")
def q_comparison(d):
    return EV.comparison_summary(fold_metrics(d), MODELS)


@register("avg_confusion", "model:s avg_tn:d avg_fp:d avg_fn:d avg_tp:d", f"""
WITH fm AS ({_FM_SQL})
SELECT model, AVG(tn) AS avg_tn, AVG(fp) AS avg_fp, AVG(fn) AS avg_fn, AVG(tp) AS avg_tp FROM fm GROUP BY 1""",
          "D24")
def q_avg_confusion(d):
    return EV.avg_confusion(fold_metrics(d), by=["model"])
