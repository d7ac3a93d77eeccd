"""Keys with a third of all rows, crowded scores, repeated rows: no part of the work gets most of them."""

from pyspark.sql import functions as F

from edusignal.operators import evaluation as EV
from edusignal.operators import events as E
from edusignal.operators import exercises as X
from edusignal.operators import models as M
from edusignal.operators.skew import shard_of, shards
from edusignal.plans import q_sources as Q
from edusignal.sources import payloads as PL


def test_crowded_scores_spread_evenly(spark):
    """All scores lie within 1e-6 of 1: no range holds more than twice the mean, and the AUC is exact."""
    df = spark.range(20000).select((1 - F.col("id") / 2e10).alias("s"), (F.pmod(F.xxhash64("id"), F.lit(3)) == 0).cast("int").alias("y"), F.lit("g").alias("g"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in EV._ranked_counts(df, "s", "y", ["g"]).groupBy("_p").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) > 4 and max(sizes) <= 2 * sum(sizes) / len(sizes)
    rows = sorted((r["s"], r["y"]) for r in df.collect())
    below = pairs = 0
    for _, y in rows:
        below += 1 - y
        pairs += below if y else 0
    n = sum(y for _, y in rows)
    assert abs(EV.auc_roc(df, "s", "y", ["g"]).first()["auc_roc"] - pairs / (n * (len(rows) - n))) < 1e-12


def test_pages_of_repeated_rows_are_bounded(spark):
    """Rows equal in all columns are dealt like any others."""
    df = spark.range(3000).select(F.lit(7).alias("user_id"), F.lit("HOT").alias("course_id"), F.lit("x").alias("username"))
    sizes = [r["count"] for r in Q.dealt(df, ["course_id"]).groupBy("_part").count().collect()]
    assert len(sizes) == 30 and set(sizes) == {Q.PART}


def _largest_part(spark, rows):
    dealt = rows.groupBy(shard_of(spark, F.col("user_id")).alias("s"), "course_id").count()
    return dealt.agg(F.max("count")).first()[0] / rows.count()


def test_a_course_with_most_rows_meets_its_row_in_parts(spark):
    """The join key of weekly progress, course info and checkpoint cuts is (part, course): a course with nine tenths of the
    students has no part near that, and every row finds its course."""
    e = spark.range(6000).select(F.col("id").alias("user_id"), F.when(F.col("id") % 10 > 0, "HOT").otherwise("c").alias("course_id"))
    assert _largest_part(spark, e) < 4 / shards(spark)
    info = spark.createDataFrame([("HOT", "Hot"), ("c", "Cold")], "course_id string, course_name string")
    named = PL.apply_course_info(e, info).groupBy("course_name").count().collect()
    assert {r["course_name"]: r["count"] for r in named} == {"Hot": 5400, "Cold": 600}
    act = e.select("user_id", "course_id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("user_id") * 600).cast("timestamp_ntz").alias("ts"),
                   F.lit("problem_correct").alias("action"), F.concat(F.lit("i"), (F.col("user_id") % 5).cast("string")).alias("item"))
    known = M.known_by_week(act, 2).groupBy("course_id").count().collect()
    start = {"HOT": 600, "c": 0}
    days = {c: [i for i in range(6000) if (i % 10 > 0) == (c == "HOT")] for c in start}
    day = {c: (1_700_000_000 + start[c]) // 86400 for c in start}
    want = {c: sum((1_700_000_000 + i * 600) // 86400 - day[c] < 14 for i in days[c]) for c in days}
    assert {r["course_id"]: r["count"] for r in known} == want


def test_weekly_progress_of_a_hot_course(spark):
    from edusignal.sources.fixtures import Domain

    from .conftest import SMALL

    d = Domain(spark, SMALL)
    hot = d.activity.withColumn("course_id", F.lit("HOT"))
    one = E.progress_weekly(hot)
    assert one.where("total_blocks IS NULL OR week_start_date IS NULL").count() == 0
    last = one.groupBy("user_id").agg(F.max("completed_blocks").alias("b")).join(
        hot.where(F.col("action").isin("problem_correct", "video_view") & F.col("item").isNotNull())
        .groupBy("user_id").agg(F.countDistinct("action", "item").alias("n")), "user_id")
    assert last.where("b <> n").count() == 0 and last.count() > 0


def test_refresh_reads_and_rewrites_little(spark, tmp_path):
    """The changed students' rows come from semi joins in front of every rollup, and other buckets keep their files."""
    from edusignal.operators import wide as W
    from edusignal.plans.q_wide import _bench
    from edusignal.sources.buckets import read_buckets, upsert_buckets
    from edusignal.sources.fixtures import Domain

    from .conftest import SMALL

    d = Domain(spark, SMALL)
    bench = M.materialize(_bench(d))
    tables = (d.enrollments, d.h5p_scores, d.video_progress, d.mooc_grades, d.mooc_progress, d.mooc_discussions)
    full = W.build_raw(*tables, bench, d.as_of)
    base = str(tmp_path / "raw")
    first = upsert_buckets(spark, base, full, ["user_id", "course_id"], "extracted_at", buckets=32)
    graded = d.mooc_grades.withColumn("grade_percentage", F.when(F.col("user_id") == 5, 1).otherwise(F.col("grade_percentage")).cast("decimal(5,2)"))
    changed = d.enrollments.where("user_id = 5")
    rows = W.refreshed(changed, *tables[:3], graded, *tables[4:], bench, d.as_of)
    assert rows.count() == changed.count()
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") >= 6
    second = upsert_buckets(spark, base, rows, ["user_id", "course_id"], "extracted_at")
    assert sum(first["files"][b] != second["files"][b] for b in first["files"]) == changed.count()
    want = W.build_raw(*tables[:3], graded, *tables[4:], bench, d.as_of)
    got = read_buckets(spark, base).select(want.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_a_course_scan_lists_its_partition(spark, tmp_path):
    from edusignal.sources.sinks import scan

    spark.range(50).select("id", (F.col("id") % 5).cast("string").alias("course_id")).write.partitionBy("course_id").parquet(str(tmp_path / "t"))
    df = scan(spark, str(tmp_path / "t"), "3")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(course_id" in plan and df.count() == 10


def test_content_stats_are_dealt_to_more_tasks(spark):
    """The attempts of a content and student meet in one of ``shards`` tasks, and are summed there alone (F8)."""
    rows = [(u, "c", i % 5, f"t{i % 5}", None if i == 3 else "f", i % 4, i % 51, 50, 2.0 * (i % 51), 10) for u in range(8) for i in range(20)]
    h = spark.createDataFrame(rows, "user_id long, course_id string, content_id long, content_title string, folder_name string, finished long, "
                                    "score long, max_score long, percentage double, time_spent long").withColumn("percentage", F.col("percentage").cast("decimal(5,2)"))
    out = X._content_stats(h)
    plan = out._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "user_id" in line]
    assert len(dealt) == 1 and f", {shards(spark)}), REPARTITION_BY_NUM" in dealt[0]
    assert plan.index("partial_sum(u_done") < plan.index("partial_max(") < plan.index(dealt[0])
    got = {(r["content_id"], r["folder_name"]): r["total_students"] for r in out.collect()}
    assert got == {(0, "f"): 8, (1, "f"): 8, (2, "f"): 8, (3, "f"): 8, (3, None): 8, (4, "f"): 8}


def _small_tables(spark, top):
    """40 students of two courses with 6 orders of 5 attempts each; every fifth attempt repeats a content."""
    key = F.col("id")
    spark.range(1, 41).select(key.alias("c_custkey"), F.concat(F.lit("n"), key.cast("string")).alias("c_name"), (key % 3).cast("int").alias("c_nationkey"),
                              (key % 7 - 2.0).alias("c_acctbal"), F.when(key % 4 == 0, "B").otherwise("A").alias("c_mktsegment")).write.parquet(f"{top}/customer.parquet")
    day = F.to_timestamp(F.lit("2001-01-01")) + F.make_dt_interval((key % 200).cast("int"))
    spark.range(240).select(key.alias("o_orderkey"), (key % 40 + 1).alias("o_custkey"), F.when(key % 3 == 0, "P").otherwise("F").alias("o_orderstatus"),
                            F.lit(1.0).alias("o_totalprice"), day.cast("timestamp_ntz").alias("o_orderdate"),
                            F.when(key % 2 == 0, "1-URGENT").otherwise("2-HIGH").alias("o_orderpriority")).write.parquet(f"{top}/orders.parquet")
    spark.range(1200).select((key % 240).alias("l_orderkey"), F.floor(key / 300).alias("l_partkey"), key.alias("l_suppkey"), F.lit(1).alias("l_linenumber"),
                             (key % 50 + 1.0).alias("l_quantity"), (key % 97 * 1.5).alias("l_extendedprice"), F.lit(0.0).alias("l_discount"), F.lit(0.0).alias("l_tax"),
                             F.when(key % 3 == 0, "N").otherwise("R").alias("l_returnflag"), F.lit("O").alias("l_linestatus"),
                             day.cast("timestamp_ntz").alias("l_shipdate")).write.parquet(f"{top}/lineitem.parquet")


def test_refresh_keeps_one_row_a_student(spark, tmp_path, monkeypatch):
    """What the refresh writes down for its later steps is a row a student at most, not one a student and content, and the
    refreshed rows are those of a full build (F7)."""
    from edusignal.plans import q_wide
    from edusignal.sources.fixtures import Domain

    _small_tables(spark, tmp_path)
    d, sizes, settle = Domain(spark, str(tmp_path)), [], q_wide.settle
    monkeypatch.setattr(q_wide, "settle", lambda df: sizes.append(df.count()) or settle(df))
    got = q_wide.q_wide_refreshed(d)
    assert max(sizes) == 40 and len(sizes) == 6
    want = q_wide.wide_rows(d).select(got.columns)
    assert got.count() == 40 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_attempts_are_dealt_once(spark):
    """Attempts are shuffled before they are summed, by student and part of the contents, and both sums are made there."""
    rows = [(u, "c", None if i % 9 == 8 else i % 9, i % 3, i % 51, 50, None if i == 7 else 2.0 * (i % 51), i, 10) for u in (1, 2, None) for i in range(60)]
    h = spark.createDataFrame(rows, "user_id long, course_id string, content_id long, finished long, score long, max_score long, percentage double, "
                                    "opened long, time_spent long").withColumn("percentage", F.col("percentage").cast("decimal(5,2)"))
    out = X.attempts_by_student(h)
    plan = out._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(moved) == 2 and "_part" in moved[1] and plan.index("partial_max(") < plan.index(moved[1].strip())
    got = {r["user_id"]: r for r in out.collect()}
    assert {(u, r["n_contents"], r["n_rows"], r["n_fin"], r["s"], r["n_pct"]) for u, r in got.items()} == {
        (u, 9, 60, 40, sum(i % 51 for i in range(60)), 59) for u in (1, 2, None)}
    by_content = X.attempts_by_student(X.attempts_by_content(h)).select(out.columns)
    assert out.exceptAll(by_content).count() == 0 and X.attempts_by_student(out) is out


def test_upserts_run_in_methods_the_jvm_compiles(spark, tmp_path, monkeypatch):
    """An upsert's jobs are planned with the JVM's method limit, and the session's own comes back."""
    from edusignal.sources import buckets

    key, seen, dedupe = "spark.sql.codegen.hugeMethodLimit", [], buckets.dedupe_source
    before = spark.conf.get(key)
    monkeypatch.setattr(buckets, "dedupe_source", lambda *a: seen.append(spark.conf.get(key)) or dedupe(*a))
    buckets.upsert_buckets(spark, str(tmp_path / "t"), spark.range(9).selectExpr("id", "id AS v"), ["id"], "v", buckets=4)
    assert seen == ["8000"] and spark.conf.get(key) == before
    assert buckets.read_buckets(spark, str(tmp_path / "t")).count() == 9
