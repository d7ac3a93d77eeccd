"""The conversation trie (op11) against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from edusignal.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string"
COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:30]
            turns[c].append((turn is not None, turn or 0, digest, role, text))
    turns = {c: [t[3:] for t in sorted(ts)] for c, ts in turns.items()}
    nodes, done = defaultdict(list), defaultdict(list)
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        whole = tuple(turns.get(base, [])[:h] + turns[c][h:])
        for d in range(len(whole) + 1):
            nodes[whole[:d]].append(c)
        done[whole].append(c)
    below = {k: [0, 0] for k in nodes}
    children = defaultdict(int)
    for k in nodes:
        if k:
            children[k[:-1]] += 1
    for k in nodes:
        saved = (len(nodes[k]) - 1) * len(k[-1][1]) if k else 0
        for d in range(len(k) + 1):
            below[k[:d]][0] += not children.get(k)
            below[k[:d]][1] += saved
    return sorted([(m[0], len(k), nodes[k[:-1]][0] if k else None, len(m), children.get(k, 0), *below[k],
                    hashlib.sha256(",".join(map(str, done.get(k, []))).encode()).hexdigest()) for k, m in nodes.items()], key=str)


def got(df):
    return sorted([tuple(r) for r in df.select(*COLS).collect()], key=str)


def made(n, seed=1):
    rnd = random.Random(seed)
    rows = [(c, t, rnd.choice(["user", None, ""]), rnd.choice(["a", "bé", "", None, "long text"])) for c in range(-3, n) for t in range(rnd.randint(1, 8))]
    rows += [(5, None, "user", "first"), (5, None, "user", "first"), (7, 2, "user", "a"), (7, 2, "user", "a"), (None, 1, "user", "lost"),
             (1000000007, 0, None, None), (250, 3, "user", "a")]
    return rows


@pytest.mark.parametrize("at_once, local", [(50_000, 200_000), (20, 40)])
def test_trie_equals_brute_force(spark, at_once, local):
    rows = made(230)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({c: F.lit("x") for c in ("depth", "key", "n", "v", "p", "arcs")})
    assert got(prefixtrie.prefix_trie(df, at_once, local)) == brute(rows)


def test_one_conversation_with_most_rows(spark):
    """A conversation over several sorted partitions, and a turn repeated many times."""
    rows = [(12, t, "user", f"t{t % 3}") for t in range(3000)] + [(12, 1, "user", "t1")] * 2000 + made(20)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        turns = prefixtrie.ordered_turns(df)
        held = turns.where("conv_id = 12").groupBy("p").count().collect()
        assert len(held) >= 4  # split over partitions
        rows_of = prefixtrie.places(turns).where("conv_id = 12").orderBy("idx").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert [r["idx"] for r in rows_of] == list(range(len(rows_of)))
    total = 0
    for r in rows_of:
        total = (total + int(r["digest"], 16) * pow(prefixtrie.B, r["idx"], prefixtrie.P)) % prefixtrie.P
        assert int(r["total"], 16) == total
    small = [(c, t, r, x) for c, t, r, x in rows if c != 12] + [(12, t, "user", f"t{t % 3}") for t in range(300)]
    assert got(prefixtrie.prefix_trie(spark.createDataFrame(small, SCHEMA), 50, 100)) == brute(small)


def test_ranked_is_the_list_order(spark):
    order = list(range(500))
    random.Random(3).shuffle(order)
    rows = [(i, j, 1, k % 2, k) for k, (i, j) in enumerate(zip(order, order[1:] + [-1]))]
    df = spark.createDataFrame(rows, "id long, after long, arcs long, leaves long, saved long")
    out = {r["id"]: (r["arcs"], r["leaves"], r["saved"]) for r in prefixtrie.ranked(df, 30).collect()}
    assert out == {i: (k, k // 2, k * (k - 1) // 2) for k, i in enumerate(order)}


def test_ends_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "CHUNK", 10)
    df = spark.createDataFrame([("k", i, True) for i in range(200)] + [("m", 3, True), ("z", 1, False)], "key string, conv_id long, ended boolean")
    want = {"k": ",".join(map(str, range(200))), "m": "3"}
    assert {r["key"]: r["ends_sha256"] for r in prefixtrie.ends(df.repartition(4)).collect()} == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}


def test_no_conversations(spark):
    assert prefixtrie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefixtrie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).count() == 0


def test_doubled():
    pred = np.array([-1, 0, 1, -1, 3])
    head, sums = prefixtrie.doubled(pred, np.array([[1], [2], [4], [8], [16]]))
    assert head.tolist() == [0, 0, 0, 3, 3] and sums[:, 0].tolist() == [0, 1, 3, 0, 8]
    assert len(prefixtrie.doubled(np.zeros(0, int), np.zeros((0, 3), int))[0]) == 0
