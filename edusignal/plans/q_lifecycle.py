"""Upsert and prediction life-cycle queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.expr import as_of_lit
from ..operators import predictions as P
from ..operators.upsert import upsert
from ..session import ensure_checkpoint_dir
from ..sources.buckets import read_buckets, upsert_buckets
from .base import AS_OF, register

KEYS = ["user_id", "course_id"]

# --- A17 -------------------------------------------------------------------------

UPSERT_COLS = ("user_id:i course_id:s total_blocks:i completed_blocks:i progress_percent:d "
               "completion_rate:d last_activity:t")


def _refetched_progress(d):
    """A re-fetch of progress for every customer (incl. those the first fetch
    missed), with last activity over all orders."""
    c = d.base("customer")
    last = d.base("orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_activity"))
    k = F.col("c_custkey")
    return c.join(last, k == F.col("o_custkey"), "left").select(
        k.alias("user_id"), F.col("c_mktsegment").alias("course_id"),
        ((k * 53) % 101).cast("decimal(5,2)").alias("completion_rate"), "last_activity")


_UPSERT_SQL = """
SELECT COALESCE(t.user_id, s.user_id) AS user_id, COALESCE(t.course_id, s.course_id) AS course_id,
  t.total_blocks, t.completed_blocks, t.progress_percent,
  CASE WHEN s.user_id IS NOT NULL THEN s.completion_rate ELSE t.completion_rate END AS completion_rate,
  CASE WHEN s.user_id IS NOT NULL THEN s.last_activity ELSE t.last_activity END AS last_activity
FROM mooc_progress t
FULL OUTER JOIN (
  SELECT c.c_custkey AS user_id, c.c_mktsegment AS course_id,
         CAST((c.c_custkey * 53) % 101 AS DECIMAL(5,2)) AS completion_rate, m.last_activity
  FROM customer c LEFT JOIN (SELECT o_custkey, MAX(o_orderdate) AS last_activity FROM orders GROUP BY 1) m
    ON c.c_custkey = m.o_custkey) s
ON t.user_id = s.user_id AND t.course_id = s.course_id"""


@register("upsert_progress", UPSERT_COLS, _UPSERT_SQL, "A17 Q11")
def q_upsert(d):
    return upsert(d.mooc_progress, _refetched_progress(d), KEYS, ["completion_rate", "last_activity"], "last_activity")


@register("upsert_progress_buckets", UPSERT_COLS, _UPSERT_SQL, "A17 N1 in hash buckets, read back from storage")
def q_upsert_buckets(d):
    """The same upsert into a bucketed table: two writes, one manifest each, then a scan of the files it names."""
    base = f"{ensure_checkpoint_dir(d.spark).rstrip('/')}/tables/{uuid.uuid4()}"
    upsert_buckets(d.spark, base, d.mooc_progress, KEYS, "last_activity")
    upsert_buckets(d.spark, base, _refetched_progress(d), KEYS, "last_activity", update_cols=["completion_rate", "last_activity"])
    return read_buckets(d.spark, base)


@register("upsert_progress_repeated", UPSERT_COLS, """
WITH fetched AS (
  SELECT o.o_custkey AS user_id, c.c_mktsegment AS course_id, o.o_orderdate AS last_activity,
         CAST(o.o_orderkey % 101 AS DECIMAL(5,2)) AS completion_rate
  FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey),
newest AS (
  SELECT user_id, course_id, last_activity, MAX(completion_rate) AS completion_rate FROM fetched f
  WHERE last_activity = (SELECT MAX(g.last_activity) FROM fetched g WHERE g.user_id = f.user_id)
  GROUP BY ALL)
SELECT user_id, course_id, t.total_blocks, t.completed_blocks, t.progress_percent,
  CASE WHEN n.last_activity IS NULL THEN t.completion_rate ELSE n.completion_rate END AS completion_rate,
  COALESCE(n.last_activity, t.last_activity) AS last_activity
FROM mooc_progress t FULL JOIN newest n USING (user_id, course_id)""", "A17 with several source rows per key")
def q_upsert_repeated(d):
    """Every order is one fetch of its customer's progress; the last one counts."""
    o, c = d.base("orders"), d.base("customer")
    src = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_custkey").alias("user_id"), F.col("c_mktsegment").alias("course_id"),
        F.col("o_orderdate").alias("last_activity"),
        (F.col("o_orderkey") % 101).cast("decimal(5,2)").alias("completion_rate"))
    return upsert(d.mooc_progress, src, KEYS, ["completion_rate", "last_activity"], "last_activity")


@register("upsert_progress_twice", UPSERT_COLS, "SELECT * FROM (" + """
SELECT COALESCE(t.user_id, s.user_id) AS user_id, COALESCE(t.course_id, s.course_id) AS course_id,
  t.total_blocks, t.completed_blocks, t.progress_percent,
  CASE WHEN s.user_id IS NOT NULL THEN s.completion_rate ELSE t.completion_rate END AS completion_rate,
  CASE WHEN s.user_id IS NOT NULL THEN s.last_activity ELSE t.last_activity END AS last_activity
FROM mooc_progress t
FULL OUTER JOIN (
  SELECT c.c_custkey AS user_id, c.c_mktsegment AS course_id,
         CAST((c.c_custkey * 53) % 101 AS DECIMAL(5,2)) AS completion_rate, m.last_activity
  FROM customer c LEFT JOIN (SELECT o_custkey, MAX(o_orderdate) AS last_activity FROM orders GROUP BY 1) m
    ON c.c_custkey = m.o_custkey) s
ON t.user_id = s.user_id AND t.course_id = s.course_id""" + ") x", "A17 idempotence")
def q_upsert_twice(d):
    src = _refetched_progress(d)
    once = upsert(d.mooc_progress, src, KEYS, ["completion_rate", "last_activity"], "last_activity")
    return upsert(once, src, KEYS, ["completion_rate", "last_activity"], "last_activity")


# --- L1 save ------------------------------------------------------------------------

PRED_OUT = ("id:i user_id:i course_id:s model_name:s model_version:s fail_risk_score:d risk_level:s "
            "predicted_at:t is_latest:b")

_NEW_ROWS = f"""
SELECT (SELECT MAX(id) FROM predictions) + ROW_NUMBER() OVER (
         ORDER BY md5('id-' || CAST(user_id AS VARCHAR) || '-' || course_id), user_id, course_id) AS id,
       user_id, course_id, 'rescore' AS model_name, 'r1' AS model_version, fail_risk_score, risk_level,
       {AS_OF} AS predicted_at, TRUE AS is_latest
FROM predictions WHERE model_name = 'model_1'"""


def _rescore_rows(d):
    src = d.predictions.where(F.col("model_name") == "model_1")
    return src.select(F.lit(None).cast("bigint").alias("id"), *KEYS,
                      F.lit("rescore").alias("model_name"), F.lit("r1").alias("model_version"),
                      "fail_risk_score", "risk_level", "snapshot_grade", "snapshot_completion_rate",
                      "snapshot_days_inactive", as_of_lit(d.as_of).alias("predicted_at"))


@register("save_predictions", PRED_OUT, f"""
SELECT id, user_id, course_id, model_name, model_version, fail_risk_score, risk_level, predicted_at, is_latest
FROM predictions p
WHERE NOT EXISTS (SELECT 1 FROM predictions n WHERE n.model_name = 'model_1'
                  AND n.user_id = p.user_id AND n.course_id = p.course_id)
UNION ALL {_NEW_ROWS}""", "L1 Q10")
def q_save(d):
    return P.save_predictions(d.predictions, _rescore_rows(d))


@register("save_predictions_history", PRED_OUT, f"""
SELECT id, user_id, course_id, model_name, model_version, fail_risk_score, risk_level, predicted_at,
  CASE WHEN EXISTS (SELECT 1 FROM predictions n WHERE n.model_name = 'model_1'
                    AND n.user_id = p.user_id AND n.course_id = p.course_id) THEN FALSE ELSE is_latest END
    AS is_latest
FROM predictions p
UNION ALL {_NEW_ROWS}""", "L1 keep_history")
def q_save_hist(d):
    return P.save_predictions(d.predictions, _rescore_rows(d), keep_history=True)


# --- L2 / L3 / L4 / C10 -----------------------------------------------------------------

@register("apply_scores", "user_id:i course_id:s mooc_grade_percentage:d fail_risk_score:d", """
SELECT f.user_id, f.course_id, f.mooc_grade_percentage,
  (SELECT s.fail_risk_score FROM predictions s
   WHERE s.is_latest AND s.user_id = f.user_id AND s.course_id = f.course_id) AS fail_risk_score
FROM student_features f""", "L2")
def q_apply(d):
    """The new scores include keys (an archived course) that have no wide row: an update ignores them."""
    new = d.predictions.where(F.col("is_latest"))
    archived = new.withColumn("course_id", F.concat(F.col("course_id"), F.lit(" archived")))
    return P.apply_scores(d.student_features, new.unionByName(archived))


SYNC_OUT = PRED_OUT + " snapshot_grade:d"


@register("sync_predictions", SYNC_OUT, f"""
WITH kept AS (SELECT * FROM predictions p WHERE id = (SELECT MAX(id) FROM predictions q
               WHERE q.user_id = p.user_id AND q.course_id = p.course_id)),
raw AS (SELECT f.*, m.fail_risk_score, {AS_OF} AS extracted_at FROM student_features f
        JOIN predictions m ON m.user_id = f.user_id AND m.course_id = f.course_id AND m.model_name = 'model_0')
SELECT t.id, COALESCE(t.user_id, s.user_id) AS user_id, COALESCE(t.course_id, s.course_id) AS course_id,
  CASE WHEN t.user_id IS NOT NULL THEN t.model_name ELSE 'synced' END AS model_name,
  CASE WHEN t.user_id IS NOT NULL THEN t.model_version ELSE 's1' END AS model_version,
  CASE WHEN s.user_id IS NOT NULL THEN s.fail_risk_score ELSE t.fail_risk_score END AS fail_risk_score,
  CASE WHEN s.user_id IS NOT NULL THEN (CASE WHEN s.fail_risk_score >= 70 THEN 'HIGH'
       WHEN s.fail_risk_score >= 40 THEN 'MEDIUM' ELSE 'LOW' END) ELSE t.risk_level END AS risk_level,
  CASE WHEN s.user_id IS NOT NULL THEN s.extracted_at ELSE t.predicted_at END AS predicted_at,
  CASE WHEN s.user_id IS NOT NULL THEN TRUE ELSE FALSE END AS is_latest,
  CASE WHEN t.user_id IS NOT NULL THEN t.snapshot_grade ELSE s.mooc_grade_percentage END AS snapshot_grade
FROM kept t FULL OUTER JOIN raw s ON t.user_id = s.user_id AND t.course_id = s.course_id""", "L3 A17")
def q_sync(d):
    raw = (d.student_features.join(
        d.predictions.where(F.col("model_name") == "model_0").select(*KEYS, "fail_risk_score"), KEYS)
        .withColumn("extracted_at", as_of_lit(d.as_of)))
    return P.sync_predictions(P.keep_latest(d.predictions), raw, "synced", "s1")


@register("cleanup_counts", "course_id:s before:i after:i deleted:i", """
WITH judged AS (
  SELECT a.course_id, EXISTS (SELECT 1 FROM predictions b
    WHERE b.user_id = a.user_id AND b.course_id = a.course_id AND b.id > a.id) AS outdated
  FROM predictions a)
SELECT course_id, count(*) AS before, count(*) FILTER (NOT outdated) AS after, count(*) FILTER (outdated) AS deleted
FROM judged GROUP BY course_id""", "L4 C10")
def q_cleanup(d):
    return P.cleanup_counts(d.predictions)


@register("keep_latest", PRED_OUT, """
SELECT id, user_id, course_id, model_name, model_version, fail_risk_score, risk_level, predicted_at, is_latest
FROM predictions p WHERE id = (SELECT MAX(id) FROM predictions q WHERE q.user_id = p.user_id
                               AND q.course_id = p.course_id)""", "C10 E4")
def q_keep_latest(d):
    return P.keep_latest(d.predictions)


# --- L5 / L7 / L8 / E9 ------------------------------------------------------------------

_LATEST_SQL = """
SELECT id, user_id, course_id, model_name, model_version, fail_risk_score, risk_level, predicted_at, is_latest
FROM predictions WHERE is_latest {extra}
QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id, course_id ORDER BY predicted_at DESC, id DESC) = 1"""


@register("latest_prediction", PRED_OUT, _LATEST_SQL.format(extra=""), "L5 E4")
def q_latest(d):
    return P.latest_prediction(d.predictions)


@register("latest_prediction_model", PRED_OUT, _LATEST_SQL.format(extra="AND model_name = 'model_2'"), "L5")
def q_latest_model(d):
    return P.latest_prediction(d.predictions, model="model_2")


@register("prediction_history", PRED_OUT + " seq:i", """
SELECT id, user_id, course_id, model_name, model_version, fail_risk_score, risk_level, predicted_at, is_latest,
  ROW_NUMBER() OVER (PARTITION BY user_id, course_id ORDER BY predicted_at, id) AS seq FROM predictions""",
          "L7")
def q_history(d):
    return P.prediction_history(d.predictions)


@register("rollback_prediction", "id:i user_id:i course_id:s is_latest:b", """
SELECT p.id, p.user_id, p.course_id,
  CASE WHEN t.id IS NULL THEN p.is_latest ELSE p.id = t.id END AS is_latest
FROM predictions p LEFT JOIN (SELECT id, user_id, course_id FROM predictions WHERE model_name = 'model_1') t
  ON p.user_id = t.user_id AND p.course_id = t.course_id""", "L8")
def q_rollback(d):
    targets = d.predictions.where(F.col("model_name") == "model_1").select("id")
    return P.rollback_prediction(d.predictions, targets)


@register("risk_drift",
          "user_id:i course_id:s id:i predicted_at:t fail_risk_score:d prev_score:d score_change:d "
          "prev_level:s risk_level:s", """
SELECT user_id, course_id, id, predicted_at, fail_risk_score,
  LAG(fail_risk_score) OVER w AS prev_score, fail_risk_score - LAG(fail_risk_score) OVER w AS score_change,
  LAG(risk_level) OVER w AS prev_level, risk_level
FROM predictions WINDOW w AS (PARTITION BY user_id, course_id ORDER BY predicted_at, id)""", "E9")
def q_drift(d):
    return P.risk_drift(d.predictions)


# --- L9 / L10 / C11 / C9 / K12 / K13 / D26 --------------------------------------------

@register("collect_training",
          "user_id:i course_id:s mooc_grade_percentage:d mooc_completion_rate:d days_since_last_activity:i "
          "is_passed:b is_dropout:b final_grade:d semester:s collected_at:t", f"""
SELECT user_id, course_id, mooc_grade_percentage, mooc_completion_rate, days_since_last_activity,
  mooc_is_passed AS is_passed, days_since_last_activity > 30 AS is_dropout,
  mooc_grade_percentage AS final_grade, '2001-2' AS semester, {AS_OF} AS collected_at
FROM student_features WHERE mooc_is_passed IS NOT NULL""", "L9")
def q_collect(d):
    return P.collect_training(d.student_features, "2001-2", d.as_of)


@register("backfill_counts", "features_rows:i prediction_rows:i training_rows:i", """
SELECT COUNT(*) AS features_rows, COUNT(p.fail_risk_score) AS prediction_rows,
  COUNT(f.mooc_is_passed) AS training_rows
FROM student_features f LEFT JOIN predictions p ON f.user_id = p.user_id AND f.course_id = p.course_id
  AND p.is_latest""", "L10")
def q_backfill(d):
    raw = d.student_features.join(
        d.predictions.where(F.col("is_latest")).select(*KEYS, "fail_risk_score"), KEYS, "left")
    return P.backfill_counts(raw)


_BACKFILL = """FROM student_features f LEFT JOIN (SELECT user_id, course_id, fail_risk_score, predicted_at
  FROM predictions WHERE is_latest) p USING (user_id, course_id)"""


def _backfill_raw(d):
    scores = d.predictions.where(F.col("is_latest")).select(*KEYS, "fail_risk_score", F.col("predicted_at").alias("extracted_at"))
    return d.student_features.join(scores, KEYS, "left")


@register("backfill_features", "user_id:i course_id:s mooc_grade_percentage:d mooc_completion_rate:d h5p_total_contents:i",
          "SELECT user_id, course_id, f.mooc_grade_percentage, f.mooc_completion_rate, f.h5p_total_contents " + _BACKFILL, "L10")
def q_backfill_features(d):
    return P.backfill_tables(_backfill_raw(d))["features"]


@register("backfill_predictions", "user_id:i course_id:s model_name:s fail_risk_score:d risk_level:s predicted_at:t is_latest:b",
          "SELECT user_id, course_id, 'backfill' AS model_name, p.fail_risk_score, ['LOW', 'MEDIUM', 'HIGH'][1 + "
          "(p.fail_risk_score >= 40)::INT + (p.fail_risk_score >= 70)::INT] AS risk_level, p.predicted_at, TRUE AS is_latest "
          + _BACKFILL + " WHERE p.fail_risk_score IS NOT NULL", "L10")
def q_backfill_predictions(d):
    return P.backfill_tables(_backfill_raw(d))["predictions"]


@register("backfill_training", "user_id:i course_id:s is_passed:b final_grade:d semester:s",
          "SELECT user_id, course_id, f.mooc_is_passed AS is_passed, f.mooc_grade_percentage AS final_grade, 'backfill' AS semester "
          + _BACKFILL + " WHERE f.mooc_is_passed IS NOT NULL", "L10")
def q_backfill_training(d):
    return P.backfill_tables(_backfill_raw(d))["training"]


@register("stale_courses", "course_id:s students_without_recent_prediction:i", f"""
SELECT f.course_id, COUNT(*) AS students_without_recent_prediction
FROM student_features f
WHERE (f.mooc_is_passed IS NULL OR f.mooc_is_passed = FALSE)
  AND NOT EXISTS (SELECT 1 FROM predictions p WHERE p.user_id = f.user_id AND p.course_id = f.course_id
                  AND p.predicted_at > {AS_OF} - INTERVAL 24 HOUR)
GROUP BY f.course_id""", "C11")
def q_stale(d):
    return P.stale_courses(d.student_features, d.predictions, d.as_of)


@register("model_for_course", "course_id:s model_name:s is_default_choice:b assigned_at:t", """
WITH reg AS (SELECT DISTINCT model_name, model_name <> 'model_1' AS is_active,
                    model_name = 'model_0' AS is_default FROM predictions),
cmap AS (SELECT course_id, model_name, MIN(predicted_at) AS assigned_at, model_name <> 'model_2' AS is_active
        FROM predictions GROUP BY course_id, model_name),
best AS (SELECT m.course_id, m.model_name, m.assigned_at FROM cmap m JOIN reg r ON m.model_name = r.model_name
         WHERE m.is_active
         QUALIFY ROW_NUMBER() OVER (PARTITION BY m.course_id ORDER BY m.assigned_at DESC, m.model_name) = 1)
SELECT c.course_id, COALESCE(b.model_name, (SELECT MIN(model_name) FROM reg WHERE is_default AND is_active))
  AS model_name, b.model_name IS NULL AS is_default_choice, b.assigned_at
FROM (SELECT DISTINCT course_id FROM enrollments) c LEFT JOIN best b ON b.course_id = c.course_id""", "C9")
def q_model_for_course(d):
    return P.model_for_course(d.enrollments, P.course_mapping_from(d.predictions),
                              P.model_registry_from(d.predictions))


_W = {"model_0": 0.2, "model_1": 0.3, "model_2": 0.5}


@register("ensemble", "user_id:i course_id:s ensemble_score:d models_used:i risk_level:s", f"""
SELECT user_id, course_id, s AS ensemble_score, n AS models_used,
  CASE WHEN s >= 70 THEN 'HIGH' WHEN s >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
FROM (SELECT user_id, course_id,
        SUM(fail_risk_score * CASE model_name WHEN 'model_0' THEN 0.2 WHEN 'model_1' THEN 0.3 ELSE 0.5 END)
        / SUM(CASE model_name WHEN 'model_0' THEN 0.2 WHEN 'model_1' THEN 0.3 ELSE 0.5 END) AS s,
        COUNT(*) AS n
      FROM predictions WHERE model_name IN ('model_0', 'model_1', 'model_2') GROUP BY 1, 2) x""", "K12")
def q_ensemble(d):
    return P.ensemble(d.predictions, _W)


@register("ab_assign", "user_id:i course_id:s variant:s", """
SELECT user_id, course_id,
  CASE WHEN ROW_NUMBER() OVER (PARTITION BY course_id ORDER BY md5('42-' || CAST(user_id AS VARCHAR) || '-' || course_id))
            <= COUNT(*) OVER (PARTITION BY course_id) // 2 THEN 'A' ELSE 'B' END AS variant
FROM student_features""", "K13")
def q_ab(d):
    return P.ab_assign(d.student_features.select(*KEYS))


@register("semester_trends",
          "semester:s students:i dropout_rate:d avg_completion:d avg_grade:d avg_exercises:d dropout_rate_change:d",
          """
SELECT *, dropout_rate - LAG(dropout_rate) OVER (ORDER BY semester) AS dropout_rate_change
FROM (SELECT CAST(year(e.created) AS VARCHAR) || CASE WHEN month(e.created) <= 6 THEN '-1' ELSE '-2' END AS semester,
        COUNT(*) AS students, AVG(CASE WHEN f.days_since_last_activity > 30 THEN 1.0 ELSE 0.0 END) AS dropout_rate,
        AVG(f.mooc_completion_rate) AS avg_completion, AVG(f.mooc_grade_percentage) AS avg_grade,
        AVG(f.h5p_total_contents) AS avg_exercises
      FROM student_features f JOIN enrollments e ON f.user_id = e.user_id AND f.course_id = e.course_id
      GROUP BY 1) s""", "D26")
def q_semester(d):
    return P.semester_trends(d.student_features, d.enrollments)
