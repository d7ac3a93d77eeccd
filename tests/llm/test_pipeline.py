"""The pipeline's stages against their own definitions, and end to end."""

from collections import Counter, defaultdict

import corpus_pipeline

from ..conftest import MEDIUM
from .test_exact import LOWER, brute_components, brute_print, source
from .test_learned import INSULTS, brute_spans


def test_stages_one_by_one(spark, documents, tmp_path):
    docs, before = documents, dict(source(documents))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, MEDIUM)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            assert {r["doc_id"] for r in out.collect()} == set(before)
            break
        assert out.columns == documents.columns
        after = dict(source(out))
        assert set(after) <= set(before)
        if name == "toxicity":
            gone = {i for i in before if i not in after}
            rude = {i for i, t in before.items() if len(INSULTS & set(t.lower().split())) >= 2}
            assert len(rude & gone) > 0.9 * len(rude) and len(gone) < 0.2 * len(before)
        elif name == "exact_dedup":
            groups = defaultdict(list)
            for i, t in before.items():
                groups[t.translate(LOWER)].append(i)
            assert set(after) == {max(g) for g in groups.values()}
        elif name == "near_dedup":
            prints = {i: brute_print(t) for i, t in before.items()}
            root = brute_components(prints.values())
            groups = defaultdict(list)
            for i, p in prints.items():
                groups[root[p]].append(i)
            assert set(after) == {min(g) for g in groups.values()}
        elif name == "pii":
            assert set(after) == set(before) and not any(brute_spans(t) for t in after.values())
        docs, before = out, after


def test_run(spark):
    got = corpus_pipeline.run(spark, MEDIUM).collect()
    per = Counter(r["sequence_id"] for r in got for _ in range(1))
    size = defaultdict(int)
    for r in got:
        size[r["sequence_id"]] += r["length"]
    assert got and max(size.values()) <= 4096 and len(per) == len(size)


def test_edge_rows_pass_through(spark, edge, empty, tmp_path):
    for k, docs in enumerate((edge, empty)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, MEDIUM)
            assert name == "packing" or out.columns == docs.columns
            out.write.parquet(str(tmp_path / f"{name}{k}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}{k}"))
        assert (docs.count() > 0) == (k == 0)
