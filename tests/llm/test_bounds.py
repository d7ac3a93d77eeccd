"""What reaches one task or the driver stays bounded, with the same results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from edusignal.llm import pii, toxicity, urls



def test_percentiles_equal_exact(spark):
    x = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7.0
    rows = spark.range(6000).select((F.col("id") % 3 == 0).alias("kind"), F.when(F.col("id") % 5 < 2, 3.25).when(F.col("id") % 97 == 1, 1e12 * x).otherwise(-x).alias("x"))
    for share in (0.0, 0.005, 0.3, 0.5, 0.7713, 1.0):
        want = {r["kind"]: r["p"] for r in rows.groupBy("kind").agg(F.percentile("x", F.lit(share)).alias("p")).collect()}
        assert urls.percentiles(rows, {True: share, False: share}) == want
    assert urls.percentiles(rows.where("kind"), {True: 0.5, False: 0.5}).keys() == {True}
    assert urls.percentiles(rows.limit(0), {True: 0.5}) == {}


def test_url_cut_has_no_percentile_of_all_scores(spark, monkeypatch):
    def refused(*args):
        raise AssertionError("all scores in one task")

    monkeypatch.setattr(F, "percentile", refused)
    rows = [(i, f"https://{'casino' if i % 2 else 'school'}{i}.org/page/{i}") for i in range(200)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert {r["verdict"] for r in got} == {"allow", "block"}


@pytest.fixture()
def numbered(spark):
    """Documents of many phone numbers, and one doc_id that repeats in a third of the rows."""
    line = F.concat(F.lit("call +1 425 555 "), F.lpad(F.col("id"), 4, "0"), F.lit(" or order "), F.col("id") + 10 ** 12, F.lit(" now. "))
    text = F.concat_ws(" ", *[line] * 30)
    return spark.range(120).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("long").alias("doc_id"), text.alias("text"))


def test_pii_examples_are_bounded(numbered, monkeypatch):
    seen = []
    monkeypatch.setattr(pii, "fit", lambda x, y: seen.append(x) or (_ for _ in ()).throw(StopIteration))
    for options in ({}, {"most": 200}):
        with pytest.raises(StopIteration):
            pii.train(numbered, **options)
    assert len(seen[1]) < 8 * 300 < len(seen[0])


def test_pii_repeats_change_nothing(spark, numbered):
    once = numbered.dropDuplicates(["doc_id"]).where("doc_id <> 7")
    hot = once.where("doc_id = 8")
    many = once
    for _ in range(4):
        many = many.unionByName(hot)
    a, b = pii.train(once), pii.train(many)
    assert a.trees is not None and a.cuts == b.cuts and np.array_equal(a.trees.value, b.trees.value)


def test_toxicity_learns_one_row_a_doc_id(spark, monkeypatch):
    sizes = []
    fit = toxicity.fit_cumulative
    monkeypatch.setattr(toxicity, "fit_cumulative", lambda *a, **k: sizes.append(len(a[3])) or fit(*a, **k, steps=5))
    rows = spark.range(300).select(F.when(F.col("id") < 100, 1).otherwise(F.col("id")).cast("long").alias("doc_id"))
    docs = rows.withColumn("text", F.when(F.col("doc_id") % 2 == 1, "you pathetic clown").otherwise("a quiet day"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic")).distinct()
    assert toxicity.train(docs, labels).weights and sizes[-1] == 201
