"""Model evaluation as DataFrame jobs (survey E7, E8, K2, K5, D15, D16, D24, J6).

Everything here is an aggregate over (group, label, prediction) or over
distinct scores, so it scales with the data: the AUC never sorts all rows in
one task, folds never put a whole label in one task (see
:mod:`edusignal.operators.ranking`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import stability
from .ranking import hex_bucket, md5_key, positions
from .skew import settle

METRICS = ["accuracy", "auc_roc", "precision", "recall", "f1_score"]


def stratified_folds(df: DataFrame, label: str, key_cols: list[str], k: int = 10, seed: int = 42,
                     group: list[str] | None = None) -> DataFrame:
    """``fold = (row_number() over (partition by label order by md5(seed-key)) - 1) % k``.
    Folds are disjoint, complete, and balanced within one row per label."""
    g = (group or []) + [label]
    x = df.withColumn("_k", md5_key(seed, *key_cols))
    r = positions(x, g, "_k", hex_bucket("_k"), out="_pos", tie_cols=key_cols)
    return r.withColumn("fold", ((F.col("_pos") - 1) % k).cast("int")).drop("_k", "_pos", "_pos_n")


def stratified_split(df: DataFrame, label: str, key_cols: list[str], test_size: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """K2: per label, the first ``round(n * test_size)`` rows of the seeded
    order are the test set (``is_test``)."""
    x = df.withColumn("_k", md5_key(seed, *key_cols))
    r = positions(x, [label], "_k", hex_bucket("_k"), out="_pos", tie_cols=key_cols)
    n_test = F.floor(F.col("_pos_n") * test_size + 0.5)
    return r.withColumn("is_test", F.col("_pos") <= n_test).drop("_k", "_pos", "_pos_n")


def _ranked_counts(df: DataFrame, score: str, label: str, g: list[str]) -> DataFrame:
    """One row per (group, score): positives, negatives, and negatives with a lower score.

    The distinct scores are sorted into ranges whose borders come from a sample of them, so ranges stay even however the
    scores crowd; negatives below a score are those of the group's ranges before (a row a range) plus those before it
    in its own."""
    y = F.col(label).cast("int")
    per = df.groupBy(*g, F.col(score).cast("double").alias("_s")).agg(
        F.sum(y).cast("double").alias("_pos"), F.sum(1 - y).cast("double").alias("_neg"))
    ranges = settle(per.orderBy(*g, "_s")).withColumn("_p", F.spark_partition_id())
    sizes = ranges.groupBy(*g, "_p").agg(F.sum("_neg").alias("_pneg"))
    wb = Window.partitionBy(*g).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.select(*g, "_p", F.coalesce(F.sum("_pneg").over(wb), F.lit(0.0)).alias("_off"))
    wl = Window.partitionBy(*g, "_p").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.join(offs, [*g, "_p"]).withColumn(
        "_below", F.col("_off") + F.coalesce(F.sum("_neg").over(wl), F.lit(0.0)))


def _auc():
    """Mann-Whitney AUC (ties count one half) as an aggregate over :func:`_ranked_counts`."""
    u, p, n = F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2)), F.sum("_pos"), F.sum("_neg")
    return F.when((p > 0) & (n > 0), u / (p * n)).alias("auc_roc")


def auc_roc(df: DataFrame, score: str, label: str, group: list[str] | None = None) -> DataFrame:
    """Rank AUC per group."""
    g = group or []
    return _ranked_counts(df, score, label, g).groupBy(*g).agg(_auc())


def evaluate(df: DataFrame, score: str, label: str, group: list[str] | None = None,
             threshold: float = 0.5) -> DataFrame:
    """K5: accuracy, AUC, precision, recall, F1 and the confusion matrix (predict
    fail at ``score >= threshold``) per group; zero division gives 0.  Everything
    comes from the (group, score) counts: the scored rows are read once."""
    if not group:  # one overall row: evaluate a constant group, then drop it
        return evaluate(df.withColumn("_all", F.lit(1)), score, label, ["_all"], threshold).drop("_all")
    hit = F.col("_s") >= threshold

    def c(name, cond):
        return F.coalesce(F.sum(F.when(cond, F.col(name))), F.lit(0)).cast("bigint")

    cm = _ranked_counts(df, score, label, group).groupBy(*group).agg(
        c("_neg", ~hit).alias("tn"), c("_neg", hit).alias("fp"), c("_pos", ~hit).alias("fn"), c("_pos", hit).alias("tp"), _auc())
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    out = cm.withColumns({"accuracy": (tp + tn) / (tp + tn + fp + fn),
                          "precision": F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0)),
                          "recall": F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1_score", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)))


def class_report(evaluated: DataFrame, by: list[str]) -> DataFrame:
    """K5: precision, recall, F1 and support of each class (0 = passed, 1 = failed), and
    their plain (``macro``) and support-weighted (``weighted``) means."""
    d = {c: F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp")}

    def row(name, hit, wrong, missed):
        p = F.when(hit + wrong > 0, hit / (hit + wrong)).otherwise(0.0)
        r = F.when(hit + missed > 0, hit / (hit + missed)).otherwise(0.0)
        f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
        return F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1_score"),
                        (hit + missed).alias("support"))

    zero, one = row("0", d["tn"], d["fn"], d["fp"]), row("1", d["tp"], d["fp"], d["fn"])
    n0, n1 = zero["support"], one["support"]

    def mean(name, w0, w1):
        each = [((zero[c] * w0 + one[c] * w1) / (w0 + w1)).alias(c) for c in ("precision", "recall", "f1_score")]
        return F.struct(F.lit(name).alias("class"), *each, (n0 + n1).alias("support"))

    rows = F.array(zero, one, mean("macro", F.lit(1.0), F.lit(1.0)), mean("weighted", n0, n1))
    return evaluated.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")


def kfold_summary(folds: DataFrame, by: list[str] | None = None) -> DataFrame:
    """D15 + J6: mean, population std, min, max per metric, and a stability
    band per metric (long format: one row per metric)."""
    b = by or []
    stack = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                                for m in METRICS]))
    long = folds.select(*b, stack.alias("x")).select(*b, "x.metric", "x.value")
    s = long.groupBy(*b, "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"), F.count(F.lit(1)).cast("bigint").alias("n_folds"))
    return s.withColumn("stability", stability("std"))


def comparison_summary(folds: DataFrame, model_order: list[str]) -> DataFrame:
    """Per model and metric the mean and *sample* std; ``is_best`` marks
    the model with the highest mean per metric, the first in ``model_order``
    winning ties."""
    stack = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                                for m in METRICS]))
    long = folds.select("model", stack.alias("x")).select("model", "x.metric", "x.value")
    s = long.groupBy("model", "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    order = F.lit(len(model_order))
    for i, m in reversed(list(enumerate(model_order))):
        order = F.when(F.col("model") == m, F.lit(i)).otherwise(order)
    w = Window.partitionBy("metric").orderBy(F.col("mean").desc(), order)  # <= models rows per metric
    return s.withColumn("is_best", F.row_number().over(w) == 1)


def avg_confusion(folds: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Average confusion matrix over folds."""
    return folds.groupBy(*(by or [])).agg(*[F.avg(F.col(c).cast("double")).alias(f"avg_{c}")
                                            for c in ("tn", "fp", "fn", "tp")])
