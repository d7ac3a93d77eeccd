"""End-to-end batch jobs (survey lifecycle L-1, L-2; K15, K16).

Each job is one Spark application over all courses at once; intermediate
tables are written as new versions in the given warehouse folder (never over
the table being read), and long lineages are cut by those writes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features as FE
from ..operators import models as M
from ..operators import predictions as P
from ..operators import stats as S
from ..operators import wide as W
from ..operators.evaluation import evaluate, stratified_split
from ..operators.exercises import h5p_summary, video_summary  # noqa: F401  (rollups D23)
from ..operators.upsert import upsert
from ..sources import payloads as PL
from ..sources import sinks as SK

KEYS = ["user_id", "course_id"]


#: Keys of the tables that the ETL upserts (enrolments are unique by their own id;
#: the rest of the key tells rows without one apart).
TABLE_KEYS = {"enrollments": ["enrollment_id", "course_id", "user_id", "username"],
              "course_stats_benchmarks": ["course_id"]}


def landed(spark: SparkSession, landing_root: str, as_of: str) -> dict[str, DataFrame]:
    """Every table's rows from the landed payloads."""
    items = PL.read_enrollment_pages(spark, landing_root)
    enroll = PL.apply_course_info(PL.flatten_enrollments(items, as_of), PL.read_course_info(spark, landing_root))
    h_detail, h_sum = PL.flatten_h5p(spark, landing_root, as_of)
    v_detail, v_sum = PL.flatten_video(spark, landing_root, as_of)
    return {"enrollments": enroll, "h5p_scores_summary": h_sum, "video_progress_summary": v_sum,
            "dashboard_summary": PL.dashboard_summary(PL.flatten_combined(spark, landing_root),
                                                      PL.flatten_dashboard(spark, landing_root)),
            "mooc_grades": PL.flatten_grades(spark, landing_root), "mooc_progress": PL.flatten_progress(spark, landing_root),
            "mooc_discussions": PL.flatten_discussions(spark, landing_root),
            "course_stats_benchmarks": PL.benchmarks_from_stats(spark, landing_root),
            "h5p_scores": h_detail, "video_progress": v_detail}


def upsert_table(spark: SparkSession, src: DataFrame, base: str, keys: list[str], order: list[str]) -> str:
    """A17 into the versioned table at ``base``, or its first version."""
    current = SK.read_latest(spark, base) if SK.list_versions(spark, base) else None
    return SK.write_version(upsert(current, src, keys, [c for c in src.columns if c not in keys], order), base)


def etl(spark: SparkSession, landing_root: str, warehouse: str, as_of: str) -> dict:
    """L-1: landed JSON -> keyed tables (A1–A11 + A17) -> wide rows.

    Replaces the per-user HTTP + per-user SQL loop with one plan per table.
    Attempt and position rows have no key in the reference (Q1); a row that is
    the same in every field but the fetch time is the same row, so landing a
    payload twice changes nothing.  Exercise and video totals of the wide rows
    come from the stored summaries.  Returns the paths written."""
    wh, out = warehouse.rstrip("/"), {}
    for name, src in landed(spark, landing_root, as_of).items():
        if name in ("h5p_scores", "video_progress"):
            keys = [c for c in src.columns if c != "fetched_at"]
        else:
            keys = TABLE_KEYS.get(name, KEYS)
        order = [c for c in ("fetched_at", "created", "last_activity") if c in src.columns] \
            or [c for c in src.columns if c not in keys][:1]
        out[name] = upsert_table(spark, src, f"{wh}/{name}", keys, order)
    t = {n: spark.read.parquet(p) for n, p in out.items()}
    raw = W.build_raw(t["enrollments"], t["h5p_scores"], t["video_progress"], t["mooc_grades"],
                      t["mooc_progress"], t["mooc_discussions"], t["course_stats_benchmarks"], as_of,
                      dash=t["dashboard_summary"], h5p_sums=t["h5p_scores_summary"], video_sums=t["video_progress_summary"])
    out["raw_data"] = SK.write_version(raw, f"{wh}/raw_data", partition_by=["course_id"])
    return out


def daily_prediction(spark: SparkSession, raw: DataFrame, model_path: str, predictions_base: str,
                     csv_path: str, as_of: str, raw_base: str | None = None) -> DataFrame:
    """Features (I19) -> scores (K4) -> prediction rows saved with the
    latest flag (L1) -> scores on the wide rows (L2, a new version at ``raw_base``)
    -> CSV per course and day (A15) -> risk totals (D11).  One job for every
    course; no loop per course.  Running a day again replaces that day's rows."""
    model, meta = M.load_model(model_path)
    feats = FE.all_features(raw)
    cat, num = meta["categorical"], meta["numeric"]
    feats = M.fill_features(FE.ensure_features(feats, cat + num, cat), cat, num)
    scored = M.score(model, feats)
    rows = P.scores_to_rows(scored, meta.get("model_name", "gbt"), meta.get("model_version", "1"), as_of)
    if SK.list_versions(spark, predictions_base):
        current = SK.read_latest(spark, predictions_base)
    else:
        from pyspark.sql.types import BooleanType, StructField, StructType
        current = spark.createDataFrame([], StructType(rows.schema.fields + [StructField("is_latest", BooleanType())]))
    new_table = P.save_predictions(current, rows)
    path = SK.write_version(new_table, predictions_base)
    if raw_base is not None:
        SK.write_version(P.apply_scores(raw, rows), raw_base, partition_by=["course_id"])
    SK.write_predictions(scored.select(*KEYS, "fail_risk_score", "risk_level"), csv_path, as_of)
    return S.risk_distribution(spark.read.parquet(path))


def retrain(spark: SparkSession, raw: DataFrame, model_path: str, seed: int = 42, day: str | None = None) -> DataFrame:
    """Features (I19) -> training frame (K1) -> stratified split (K2) ->
    boosted trees (K3) -> test metrics (K5) -> saved pipeline + metadata (K10),
    as the default and, with ``day``, as that day's copy."""
    tf, cat, num = M.training_frame(FE.all_features(raw))
    tf = M.materialize(tf)
    split = stratified_split(tf, "label", KEYS, 0.2, seed)
    model = M.train(split.where(~F.col("is_test")).drop("is_test"), cat, num, "gbt", seed)
    test = M.score(model, split.where(F.col("is_test"))).withColumn("score", F.col("fail_risk_score") / 100)
    metrics = evaluate(test, "score", "label")
    M.save_model(model, model_path, {"categorical": cat, "numeric": num, "model_name": "gbt",
                                     "model_version": "1", "seed": seed}, day)
    return metrics
