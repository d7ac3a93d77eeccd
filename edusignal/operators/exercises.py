"""Exercise ("H5P") and video marts (survey D3–D10, D23, C8, F4, F6, G4, G5, J3).

Distinct-student counts are done in two aggregation steps — first per
(course, content, user), then per (course, content) — instead of several
``countDistinct`` in one ``agg`` (which Spark plans as an Expand that copies
every row once per distinct expression).  Both steps partially aggregate
map-side, so a content or course holding a third of all attempts does not
land in one task.

Rounding follows MySQL: ``ROUND`` on exact decimals, half away from zero;
AVG of a decimal is first rounded to 4 more places, as Spark's decimal AVG does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import epoch_to_ntz, safe_ratio
from .skew import shards

CONTENT = ["course_id", "content_id", "content_title", "folder_name"]


def _dec(c, p=38, s=0):
    return F.col(c).cast(f"decimal({p},{s})") if isinstance(c, str) else c.cast(f"decimal({p},{s})")


def _rate(num, den):
    """ROUND(num * 100.0 / den, 2) on decimals (den > 0)."""
    return F.round(_dec(num, 20, 0) * F.lit(100).cast("decimal(3,0)") / _dec(den, 20, 0), 2).cast("double")


def _avg_round(total, n, scale_in: int, digits: int):
    """ROUND(AVG(x), digits) for a decimal x with ``scale_in`` places, given its
    exact sum and count: AVG keeps scale_in + 4 places (half up), then ROUND."""
    avg = (_dec(total, 38, scale_in) / _dec(n, 20, 0)).cast(f"decimal(38,{scale_in + 4})")
    return F.round(avg, digits).cast("double")


# --- D8 / D23 rollups ----------------------------------------------------------

def attempts_by_content(h: DataFrame, *more: str) -> DataFrame:
    """One row per (user, course, content, and ``more`` columns) with every partial sum the
    per-student rollups need (D8, D9, D22, D23).

    Distinct counts become plain counts over these rows (instead of several
    ``countDistinct`` in one ``agg``, an Expand that copies every attempt row
    per distinct expression)."""
    if "done_fin" in h.columns:
        return h
    fin = F.col("finished") > 0
    pct = F.col("percentage")
    cents = (pct * 100).cast("bigint")
    return h.groupBy("user_id", "course_id", "content_id", *more).agg(
        F.max(fin.cast("int")).alias("done_fin"),
        F.max((pct >= 70).cast("int")).alias("done70"),
        F.sum("score").alias("s"), F.sum("max_score").alias("m"), F.sum("time_spent").alias("t"),
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(cents).alias("cents"), F.count(pct).alias("n_pct"),
        F.sum(F.when(fin, cents)).alias("fin_cents"), F.sum(fin.cast("int")).alias("n_fin"),
        F.sum((fin & (pct >= 60)).cast("int")).alias("n_success"),
        F.sum((fin & (pct < 60)).cast("int")).alias("n_struggle"),
        F.sum(F.col("opened").cast("double")).alias("opened_sum"), F.count("opened").alias("n_opened"))


# A student's contents are dealt to this many tasks at most.
DEALT = 8


def attempts_by_student(h: DataFrame) -> DataFrame:
    """One row per (user, course) with the sums and counts that D8, D9, D22 and D23 are made of.

    Nearly every attempt is a (student, content) of its own, so summing before the shuffle saves little: the attempts are
    dealt once by student and part of the contents, and both steps' sums are made where they arrive, of which up to
    ``DEALT`` rows a student go on.  Several rollups can share the rows: write this result once (``skew.settle``) and pass
    it wherever attempts are taken; it is recognised and returned as it is.  Separate consumers of the attempts would not
    share the scan, because column pruning makes their aggregates differ."""
    if "n_contents" in h.columns:
        return h
    if "done_fin" not in h.columns:
        part = F.pmod(F.xxhash64("content_id"), F.lit(DEALT)).cast("int")
        h = attempts_by_content(h.withColumn("_part", part).repartition("user_id", "course_id", "_part"), "_part")
    return h.groupBy("user_id", "course_id").agg(
        F.count(F.lit(1)).alias("n_contents"), F.sum("done_fin").alias("n_done_fin"), F.sum("done70").alias("n_done70"),
        *[F.sum(c).alias(c) for c in ("s", "m", "t", "n_rows", "cents", "n_pct", "fin_cents", "n_fin", "n_success", "n_struggle",
                                      "opened_sum", "n_opened")])


def decimal_avg(total_cents, n) -> F.Column:
    """AVG of a decimal(x,2) from its exact cent sum and count: 6 places,
    half up — what Spark's and MySQL's decimal AVG return."""
    return F.round(total_cents.cast("decimal(38,0)") / (n.cast("decimal(38,0)") * 100), 6).cast("decimal(38,6)")


def h5p_rollup(h: DataFrame) -> DataFrame:
    """Per (user, course) — distinct contents, distinct with pct >= 70,
    sums, average percentage (as the populate job's sub-select)."""
    return attempts_by_student(h).select(
        "user_id", "course_id",
        F.col("n_contents").alias("total_contents"),
        F.col("n_done70").alias("completed_contents"),
        F.col("s").alias("total_score"),
        F.col("m").alias("total_max_score"),
        (F.col("cents") / F.col("n_pct") / 100.0).alias("avg_percentage"),
        F.col("t").alias("total_time_spent"),
    )


SUMMARY_COLS = ["total_contents", "completed_contents", "total_score", "total_max_score", "overall_percentage",
                "total_time_spent"]
METRIC_COLS = ["finished_count", "avg_finished_score", "success_count", "struggling_count",
               "assessment_attempts_avg", "success_rate"]


def h5p_user_rollup(h: DataFrame) -> DataFrame:
    """Per (user, course): the exercise summary (D23) and the attempt metrics
    (D9) in one aggregate, so a consumer that needs both (the wide row)
    reads the attempt table once."""
    g = attempts_by_student(h).select(
        "user_id", "course_id",
        F.col("n_contents").alias("total_contents"),
        F.col("n_done_fin").alias("completed_contents"),
        F.col("s").alias("total_score"),
        F.col("m").alias("total_max_score"),
        F.round(F.col("s").cast("decimal(38,0)") * F.lit(100).cast("decimal(3,0)")
                / F.nullif(F.col("m"), F.lit(0)).cast("decimal(38,0)"), 2).cast("double")
         .alias("overall_percentage"),
        F.col("t").alias("total_time_spent"),
        F.col("n_fin").alias("finished_count"),
        # decimal AVG (6 places, half up) as MySQL returns it, then double
        F.when(F.col("n_fin") > 0, decimal_avg(F.col("fin_cents"), F.col("n_fin"))).cast("double")
         .alias("avg_finished_score"),
        F.col("n_success").alias("success_count"),
        F.col("n_struggle").alias("struggling_count"),
        (F.col("opened_sum") / F.col("n_opened")).alias("avg_opened"),
    )
    return g.select(
        "user_id", "course_id", *SUMMARY_COLS, "finished_count",
        F.coalesce("avg_finished_score", F.lit(0.0)).alias("avg_finished_score"),
        "success_count", "struggling_count",
        F.least(F.coalesce("avg_opened", F.lit(0.0)), F.lit(999.99)).alias("assessment_attempts_avg"),
        safe_ratio("success_count", "finished_count", 1.0, 0.0).alias("success_rate"))


def h5p_summary(h: DataFrame) -> DataFrame:
    """``h5p_scores_summary`` from attempt rows (finished > 0 = completed)."""
    return h5p_user_rollup(h).select("user_id", "course_id", *SUMMARY_COLS)


def videos_by_student(v: DataFrame) -> DataFrame:
    """Per (user, course): ``video_summary`` and ``video_views`` (D10, D23) from one pass over the position rows, one state
    per video (its best progress).  Written once (``skew.settle``) it can be passed wherever positions are taken."""
    if "video_views" in v.columns:
        return v
    per = v.groupBy("user_id", "course_id", "content_id").agg(
        F.max("progress_percent").alias("best"), F.max("duration").alias("duration"),
        F.max("current_time").alias("watched"), F.count(F.when(F.col("progress_percent") > 0, 1)).alias("views"))
    best = F.col("best")
    return per.groupBy("user_id", "course_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("total_videos"),
        F.sum((best >= 100).cast("int")).cast("bigint").alias("completed_videos"),
        F.sum(((best > 0) & (best < 100)).cast("int")).cast("bigint").alias("in_progress_videos"),
        F.sum((best == 0).cast("int")).cast("bigint").alias("not_started_videos"),
        F.sum("duration").cast("bigint").alias("total_duration"),
        F.sum("watched").cast("bigint").alias("total_watched_time"),
        _avg_round(F.sum("best"), F.count(F.lit(1)), 2, 2).alias("overall_progress"),
        F.sum("views").alias("video_views"),
    )


def video_summary(v: DataFrame) -> DataFrame:
    """``video_progress_summary`` from position rows, one state per video
    (its best progress)."""
    return videos_by_student(v).drop("video_views")


# --- D3/D4/J3/F6 content difficulty ---------------------------------------------

def _content_stats(h: DataFrame) -> DataFrame:
    """Per (course, content, title, folder): the D3 measures, two-step.

    Nearly every attempt is a (content, student) of its own: summing them before the shuffle fills a task's memory and
    saves little, so the attempts are dealt first, to more tasks than a plain shuffle has."""
    fin = F.col("finished") > 0
    cents = (F.col("percentage") * 100).cast("bigint")
    dealt = h.repartition(shards(h.sparkSession), *CONTENT, "user_id")
    per_user = dealt.groupBy(*CONTENT, "user_id").agg(
        F.max(fin.cast("int")).alias("u_done"),
        F.max((F.col("percentage") < 100).cast("int")).alias("u_not_max"),
        F.count("percentage").alias("n"), F.sum(cents).alias("cents"),
        F.count(F.when(fin, F.col("percentage"))).alias("n_fin"),
        F.sum(F.when(fin, cents)).alias("cents_fin"),
        F.min("percentage").alias("mn"), F.max("percentage").alias("mx"),
        F.sum("score").alias("s"), F.sum("max_score").alias("m"),
        F.count("time_spent").alias("n_t"), F.sum("time_spent").alias("t"),
    )
    g = per_user.groupBy(*CONTENT).agg(
        F.count(F.lit(1)).alias("total_students"),
        F.sum("u_done").alias("completed_students"),
        F.sum("u_not_max").alias("students_not_max_score"),
        F.sum("n").alias("n"), F.sum("cents").alias("cents"),
        F.sum("n_fin").alias("n_fin"), F.sum("cents_fin").alias("cents_fin"),
        F.min("mn").alias("min_score"), F.max("mx").alias("max_score"),
        F.sum("s").alias("total_score"), F.sum("m").alias("total_max_score"),
        F.sum("n_t").alias("n_t"), F.sum("t").alias("t"),
    )
    avg_t = _avg_round(F.col("t"), F.col("n_t"), 0, 0)
    return g.select(
        *CONTENT,
        F.col("total_students").cast("bigint"),
        F.col("completed_students").cast("bigint"),
        F.col("students_not_max_score").cast("bigint"),
        _rate("students_not_max_score", "total_students").alias("not_max_rate"),
        _rate("completed_students", "total_students").alias("completion_rate"),
        _avg_round(F.col("cents"), F.col("n") * 100, 2, 2).alias("avg_score"),
        F.when(F.col("n_fin") > 0, _avg_round(F.col("cents_fin"), F.col("n_fin") * 100, 2, 2))
         .alias("avg_score_completed"),
        F.col("min_score").cast("double"), F.col("max_score").cast("double"),
        F.col("total_score").cast("bigint"), F.col("total_max_score").cast("bigint"),
        avg_t.alias("avg_time_spent_seconds"),
        F.round((avg_t.cast("decimal(38,0)") / F.lit(60).cast("decimal(2,0)")), 1).cast("double")
         .alias("avg_time_spent_minutes"),
    )


def difficulty(not_max_rate="not_max_rate", avg_score="avg_score", completion_rate="completion_rate"):
    """HIGH / MEDIUM / LOW difficulty and ``needs_attention``."""
    nm, av, cr = (F.coalesce(F.col(c), F.lit(0.0)) for c in (not_max_rate, avg_score, completion_rate))
    level = (F.when((nm > 80) | (av < 50) | (cr < 50), F.lit("HIGH"))
             .when((nm > 60) | (av < 70) | (cr < 70), F.lit("MEDIUM"))
             .otherwise(F.lit("LOW")))
    attention = (nm > 70) | (av < 60) | (cr < 60)
    return level, attention


def h5p_low_performance(h: DataFrame, min_students: int = 5, limit: int | None = 20) -> DataFrame:
    """D3 + J3 for every course: HAVING total_students >= min_students, order
    by not-max students desc, not-max rate desc, avg score asc (content id as
    the final tie-break, Q20), first ``limit`` per course.

    The per-course top-N is ``row_number() <= limit``; Spark plans it with a
    partial WindowGroupLimit before the shuffle, so each task forwards at most
    ``limit`` rows per course.
    """
    s = _content_stats(h).where(F.col("total_students") >= min_students)
    level, attention = difficulty()
    s = s.withColumn("difficulty_level", level).withColumn("needs_attention", attention)
    w = Window.partitionBy("course_id").orderBy(
        F.col("students_not_max_score").desc(), F.col("not_max_rate").desc(),
        F.col("avg_score").asc_nulls_first(), F.col("content_id").asc(),
        F.col("content_title").asc(), F.col("folder_name").asc())
    s = s.withColumn("rank", F.row_number().over(w).cast("bigint"))
    return s.where(F.col("rank") <= limit) if limit else s


def h5p_low_performance_summary(d3: DataFrame) -> DataFrame:
    """Statistics over the D3 rows that survived the limit."""
    return d3.groupBy("course_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("total_contents_analyzed"),
        F.round(F.avg(F.col("completion_rate").cast("decimal(10,2)")), 2).cast("double").alias("avg_completion_rate"),
        F.round(F.avg(F.col("avg_score").cast("decimal(10,2)")), 2).cast("double").alias("avg_score_all"),
        F.sum((F.col("difficulty_level") == "HIGH").cast("int")).cast("bigint").alias("high_difficulty_count"),
        F.sum(F.col("needs_attention").cast("int")).cast("bigint").alias("needs_attention_count"),
    )


def hardest_easiest(d3: DataFrame, n: int = 10) -> DataFrame:
    """first ``n`` of D3 per course (hardest) and the ``n`` with the highest
    average score among the D3 rows (easiest)."""
    w_easy = Window.partitionBy("course_id").orderBy(F.col("avg_score").desc_nulls_last(),
                                                     F.col("content_id").asc())
    hard = d3.where(F.col("rank") <= n).select("course_id", "content_id", F.lit("hardest").alias("list"),
                                               F.col("rank").alias("position"))
    easy = (d3.withColumn("position", F.row_number().over(w_easy).cast("bigint"))
              .where(F.col("position") <= n)
              .select("course_id", "content_id", F.lit("easiest").alias("list"), "position"))
    return hard.unionByName(easy)


# --- D5/D6 content detail --------------------------------------------------------

def h5p_content_summary(h: DataFrame) -> DataFrame:
    """Per content — students, finished students, rates, avg/min/max."""
    s = _content_stats(h)
    return s.select(*CONTENT, "total_students", "completed_students", "avg_score", "min_score",
                    "max_score", "completion_rate")


def h5p_distribution(h: DataFrame) -> DataFrame:
    """Score buckets per content, counting attempt rows; buckets ignore
    ``finished`` and overlap ``not_attempted`` (Q7, literal)."""
    p, fin = F.col("percentage"), F.col("finished")

    def c(cond):
        return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")

    return h.groupBy("course_id", "content_id").agg(
        c(p >= 90).alias("excellent"), c((p >= 80) & (p < 90)).alias("good"),
        c((p >= 70) & (p < 80)).alias("average"), c((p >= 50) & (p < 70)).alias("below_average"),
        c((p > 0) & (p < 50)).alias("poor"), c(fin == 0).alias("not_attempted"))


def performance_bands(h: DataFrame) -> DataFrame:
    """Each attempt's list on the content page — not attempted
    (finished = 0) first, then >= 80 high, >= 50 medium, else low."""
    p, fin = F.col("percentage"), F.col("finished")
    band = (F.when(fin == 0, F.lit("not_attempted")).when(p >= 80, F.lit("high_performers"))
            .when(p >= 50, F.lit("medium_performers")).otherwise(F.lit("low_performers")))
    return h.withColumn("band", band)


def student_bands(h: DataFrame, zero_finished: str = "finished") -> DataFrame:
    """Each attempt's list on the student page.

    ``FROM_UNIXTIME(0)`` is 1970-01-01, not NULL, so with the literal
    reference (``zero_finished='finished'``) nothing is in progress (Q6);
    ``'in_progress'`` applies the documented meaning of 0."""
    p = F.col("percentage")
    finished_time = F.when(F.col("finished").isNull(), F.lit(None).cast("timestamp_ntz")) \
        .otherwise(epoch_to_ntz("finished"))
    if zero_finished == "in_progress":
        finished_time = F.when(F.col("finished") == 0, F.lit(None).cast("timestamp")).otherwise(finished_time)
    band = (F.when(finished_time.isNull(), F.lit("in_progress")).when(p >= 90, F.lit("excellent"))
            .when(p >= 80, F.lit("good")).when(p >= 50, F.lit("needs_improvement"))
            .otherwise(F.lit("poor")))
    return h.withColumn("finished_time", finished_time).withColumn("band", band)


def h5p_student_stats(h: DataFrame, zero_finished: str = "finished") -> DataFrame:
    """Per student — attempted, in progress, average of attempted, band counts."""
    b = student_bands(h, zero_finished)
    done = F.col("band") != "in_progress"
    cents = (F.col("percentage") * 100).cast("bigint")
    g = b.groupBy("user_id", "course_id").agg(
        F.sum(done.cast("int")).cast("bigint").alias("total_attempted"),
        F.sum((~done).cast("int")).cast("bigint").alias("total_in_progress"),
        F.sum(F.when(done, cents)).alias("cents"),
        *[F.sum((F.col("band") == x).cast("int")).cast("bigint").alias(f"{x}_count")
          for x in ("excellent", "good", "needs_improvement", "poor")])
    avg = F.when(F.col("total_attempted") > 0,
                 F.round(F.col("cents").cast("decimal(38,0)") / F.lit(100).cast("decimal(3,0)")
                         / F.col("total_attempted").cast("decimal(20,0)"), 2)).otherwise(F.lit(0))
    return g.select("user_id", "course_id", "total_attempted", "total_in_progress",
                    avg.cast("double").alias("avg_score"), "excellent_count", "good_count",
                    "needs_improvement_count", "poor_count")


def content_students(h: DataFrame, e: DataFrame) -> DataFrame:
    """Attempt rows ⟕ enrollments (names) with readable times (all contents)."""
    ee = e.select("user_id", "course_id", "full_name", "email", "mssv")
    j = h.join(ee, ["user_id", "course_id"], "left")
    return j.select(
        "course_id", "content_id", "user_id", "full_name", "email", "mssv", "score", "max_score",
        F.col("percentage").cast("double").alias("percentage"), "finished", "opened", "time_spent",
        epoch_to_ntz("opened").alias("opened_time"),
        epoch_to_ntz("finished").alias("finished_time"),
        (F.col("finished") > 0).alias("is_completed"),
        F.round(F.col("time_spent").cast("decimal(38,0)") / F.lit(60).cast("decimal(2,0)"), 1)
         .cast("double").alias("time_spent_minutes"))


def order_attempts(df: DataFrame, by: str = "content") -> DataFrame:
    """content page by percentage desc, finished desc; student page by
    percentage asc (the other columns break ties)."""
    rest = [c for c in ("course_id", "content_id", "user_id", "finished", "opened", "time_spent", "percentage") if c in df.columns]
    if by == "content":
        return df.orderBy(F.col("percentage").desc(), F.col("finished").desc(), "user_id", *rest)
    return df.orderBy(F.col("percentage").asc(), "content_id", *rest)


# --- D9/D10 attempt metrics for the wide row --------------------------------------

def h5p_detail_metrics(h: DataFrame) -> DataFrame:
    """Finished attempts, their average score, success (>= 60) and
    struggling (< 60) counts, and the average of ``opened`` capped at 999.99
    (``opened`` is a Unix time, so it always saturates — Q8, literal)."""
    return h5p_user_rollup(h).select("user_id", "course_id", *METRIC_COLS)


def video_views(v: DataFrame) -> DataFrame:
    """Videos started (progress > 0) per user and course."""
    if "video_views" in v.columns:
        return v.where(F.col("video_views") > 0).select("user_id", "course_id", "video_views")
    return v.where(F.col("progress_percent") > 0).groupBy("user_id", "course_id") \
        .agg(F.count(F.lit(1)).cast("bigint").alias("video_views"))


def content_engagement(h: DataFrame, v: DataFrame, disc: DataFrame) -> DataFrame:
    """Engagement by content type per course, one row per (course, type)."""
    ex = h.groupBy("course_id").agg(
        F.lit("exercise").alias("content_type"),
        F.count(F.lit(1)).cast("bigint").alias("interactions"),
        F.countDistinct("user_id").cast("bigint").alias("active_students"),
        F.avg(F.col("percentage").cast("double")).alias("avg_score"),
        F.sum("time_spent").cast("bigint").alias("total_time"),
        F.avg((F.col("finished") > 0).cast("double")).alias("completion_share"))
    vi = v.groupBy("course_id").agg(
        F.lit("video").alias("content_type"),
        F.sum((F.col("progress_percent") > 0).cast("int")).cast("bigint").alias("interactions"),
        F.countDistinct("user_id").cast("bigint").alias("active_students"),
        F.avg(F.col("progress_percent").cast("double")).alias("avg_score"),
        F.sum("current_time").cast("bigint").alias("total_time"),
        F.avg((F.col("progress_percent") >= 100).cast("double")).alias("completion_share"))
    di = disc.groupBy("course_id").agg(
        F.lit("discussion").alias("content_type"),
        F.sum("total_interactions").cast("bigint").alias("interactions"),
        F.sum((F.col("total_interactions") > 0).cast("int")).cast("bigint").alias("active_students"),
        F.lit(None).cast("double").alias("avg_score"),
        F.lit(None).cast("bigint").alias("total_time"),
        F.lit(None).cast("double").alias("completion_share"))
    return ex.unionByName(vi).unionByName(di)


def content_usage_rank(h: DataFrame, v: DataFrame) -> DataFrame:
    """D27 (most/least used content): attempts per content, ranked per course.
    Contents per course are few after aggregation, so the window is small."""
    ex = h.groupBy("course_id", "content_id").agg(F.count(F.lit(1)).alias("uses")) \
        .withColumn("content_type", F.lit("exercise"))
    vi = v.where(F.col("progress_percent") > 0).groupBy("course_id", "content_id") \
        .agg(F.count(F.lit(1)).alias("uses")).withColumn("content_type", F.lit("video"))
    u = ex.unionByName(vi)
    w_most = Window.partitionBy("course_id", "content_type").orderBy(F.col("uses").desc(), "content_id")
    w_least = Window.partitionBy("course_id", "content_type").orderBy(F.col("uses").asc(), "content_id")
    return u.select("course_id", "content_type", "content_id", F.col("uses").cast("bigint"),
                    F.row_number().over(w_most).cast("bigint").alias("most_used_rank"),
                    F.row_number().over(w_least).cast("bigint").alias("least_used_rank"))
