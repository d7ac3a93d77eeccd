"""Conversation prefix trie by the Euler-tour technique.

Conversations are rebuilt (a shared head, then their own turns), and every distinct sequence of first turns is a node.
A prefix is named by a polynomial hash over the 120-bit digests of its turns, modulo 2**127 - 1; such sums shift
and subtract, so a conversation may lie in many sorted partitions, of which the driver sees one summary row each.
A node is its smallest member at a depth.  Each node has an enter and an exit arc; children follow in the order of
their smallest members, so the trie's tour is one linked list.  It is ranked in three steps: arcs of one smallest
member and stretch of depths lie together and their runs become single links; while more than ``at_once`` links are left,
random mates merge (a link of coin 0 takes in a follower of coin 1), a quarter a round, and the merges are undone
afterwards; the bounded rest is ranked by doubling.  Ranks carry sums of leaves and savings along, so a subtree's totals are the
difference of the prefix sums at its node's two arcs.

Defined cases: null role or text counts as empty; null turns come first, equal turns follow by digest; repeated rows are turns of
their own; rows without conv_id belong to no conversation and are left out; an empty table has no node, not even a
root; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import with_position
from .common import attach, settle, shard_of, ship_package

#: Modulus and base of the prefix names.
P, B = (1 << 127) - 1, 0x5DEECE66D1234567890ABCDEF1357
#: Heads are shorter than this; conversations share one in blocks of ``BLOCK``.
HEADS, BLOCK = 6, 100
#: Depths of one smallest member that lie together; characters of an ends chunk; arcs a task links locally; links ranked at once.
STRETCH, CHUNK, LOCAL, AT_ONCE = 4096, 1 << 20, 200_000, 50_000
ROOT = f"{0:032x}"
W = ["arcs", "leaves", "saved"]


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(base_id, conv_id, digest, n) in order, settled: a block's first conversation, then the others, by turn."""
    ship_package(conversations.sparkSession)
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    conv = F.col("conv_id").cast("long")
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        (conv - conv % BLOCK).alias("base_id"), conv.alias("conv_id"), "turn", F.length(text).cast("long").alias("n"),
        F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 30).alias("digest"),
        F.monotonically_increasing_id().alias("__row"))  # lets a range boundary fall between equal rows
    order = ["base_id", F.col("conv_id") != F.col("base_id"), "conv_id", F.col("turn").asc_nulls_first(), "digest", "__row"]
    return settle(rows.orderBy(*order).select("base_id", "conv_id", "digest", "n")).withColumn("p", F.spark_partition_id())


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[int], list[int]]]:
    """Each batch with the place of its rows in their conversation and the sum of digests up to them, from the
    partition's first row on."""
    conv, at, total = None, 0, 0
    for rows in batches:
        places, sums = [], []
        for c, digest in zip(rows["conv_id"], rows["digest"]):
            if c != conv:
                conv, at, total, power = c, 0, 0, 1
            total = (total + int(digest, 16) * power) % P
            places.append(at)
            sums.append(total)
            at, power = at + 1, power * B % P
        yield rows, places, sums


def _summary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A partition's first and last conversation, and the rows and sum of the last one."""
    first = last = None
    for rows, places, sums in _runs(batches):
        if len(rows):
            first = int(rows["conv_id"].iloc[0]) if first is None else first
            last = (int(rows["p"].iloc[0]), int(rows["conv_id"].iloc[-1]), places[-1] + 1, f"{sums[-1]:032x}")
    if last:
        yield pd.DataFrame([(last[0], first, *last[1:])], columns=["p", "first", "last", "rows", "total"])


def places(turns: DataFrame) -> DataFrame:
    """(base_id, conv_id, digest, n, idx, total): place in the conversation, and sum of digest_k * B**k up to it."""
    seen = sorted(turns.mapInPandas(_summary, "p int, first long, last long, rows long, total string").collect())  # a row a partition
    carry: dict[int, tuple[int, int]] = {}
    before, rows, total = None, 0, 0
    for p, first, last, n, own in seen:
        if first != before:
            rows, total = 0, 0
        carry[p] = (rows, total)
        if first != last:
            rows, total = 0, 0
        before, rows, total = last, rows + n, (total + pow(B, rows, P) * int(own, 16)) % P

    def place(batches):
        conv = start = None
        for rows, idx, sums in _runs(batches):
            if len(rows) and start is None:
                conv, start = int(rows["conv_id"].iloc[0]), carry[int(rows["p"].iloc[0])]
                shift = pow(B, start[0], P)
            lead = rows["conv_id"].to_numpy() == conv
            idx = [i + start[0] if x else i for i, x in zip(idx, lead)]
            sums = [(s * shift + start[1]) % P if x else s for s, x in zip(sums, lead)]
            yield rows.drop(columns="p").assign(idx=idx, total=[f"{s:032x}" for s in sums])
    return turns.mapInPandas(place, "base_id long, conv_id long, digest string, n long, idx long, total string")


def members(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, key, parent, n, ended) of every rebuilt conversation and its prefixes, the root's (depth 0)
    included; ``n``: characters of the last text."""
    spark = conversations.sparkSession
    rows = settle(places(ordered_turns(conversations)))
    first = F.sort_array(F.collect_list(F.when(F.col("idx") < HEADS - 1, F.struct("idx", "digest", "n"))))  # 5 rows a conversation at most
    convs = rows.groupBy("conv_id", "base_id").agg(F.count(F.lit(1)).alias("size"), first.alias("head"))
    base = convs.where("conv_id = base_id").select("base_id", F.col("head").alias("base_head"))

    def start(batches):
        for convs in batches:
            out = []
            for c, size, head, base in zip(convs["conv_id"], convs["size"], convs["head"], convs["base_head"]):
                h = zlib.crc32(str(c).encode()) % HEADS
                shared = [] if base is None else list(base)[:h]
                names, lengths, name = [ROOT], [0], 0
                for j, turn in enumerate(shared, 1):
                    name = (name + int(turn["digest"], 16) * pow(B, j, P)) % P
                    names.append(f"{name:032x}")
                    lengths.append(turn["n"])
                own = sum(int(t["digest"], 16) * pow(B, i, P) for i, t in enumerate(list(head)[:h])) % P
                shift = pow(B, len(shared) - h + 1, P)
                out.append((c, size, h, len(shared), size <= h, f"{shift:032x}", f"{(name - shift * own) % P:032x}", names, lengths))
            yield pd.DataFrame(out, columns=["conv_id", "size", "h", "shared", "turnless", "shift", "plus", "names", "lengths"])

    started = settle(convs.join(base, "base_id", "left").select("conv_id", "size", "head", "base_head").mapInPandas(
        start, "conv_id long, size long, h int, shared int, turnless boolean, shift string, plus string, names array<string>, lengths array<long>"))
    heads = (started.select("conv_id", "turnless", "shared", F.posexplode("names").alias("depth", "key"), "names", "lengths")
             .select("conv_id", F.col("depth").cast("long"), "key", F.get("names", F.col("depth") - 1).alias("parent"),
                     F.get("lengths", "depth").alias("n"), (F.col("turnless") & (F.col("depth") == F.col("shared"))).alias("ended")))

    def name(batches):
        for r in batches:
            out = []
            for i, h, shared, size, digest, total, shift, plus in zip(*(r[c] for c in ("idx", "h", "shared", "size", "digest", "total", "shift", "plus"))):
                depth = int(i) - int(h) + int(shared) + 1
                key = (int(plus, 16) + int(shift, 16) * int(total, 16)) % P
                out.append((depth, f"{key:032x}", f"{(key - int(digest, 16) * pow(B, depth, P)) % P:032x}", i == size - 1))
            got = pd.DataFrame(out, columns=["depth", "key", "parent", "ended"], index=r.index)
            yield pd.concat([r[["conv_id"]], got, r[["n"]]], axis=1)[["conv_id", "depth", "key", "parent", "n", "ended"]]

    own = attach(rows.withColumn("__shard", shard_of(spark, "digest", "idx")),
                 started.select("conv_id", "size", "h", "shared", "shift", "plus"), "conv_id").where("idx >= h")
    tails = own.select("conv_id", "idx", "h", "shared", "size", "digest", "total", "shift", "plus", "n").mapInPandas(
        name, "conv_id long, depth long, key string, parent string, n long, ended boolean")
    return heads.unionByName(tails)


def ends(found: DataFrame) -> DataFrame:
    """(key, ends_sha256): hash of each node's ended members.  Their sorted ids are joined to chunks by all tasks; only
    the hash itself, which has one order, runs over a node's chunks one after another."""
    def chunks(batches):
        key, text, size, k = None, [], 0, 0
        for rows in batches:
            out = []
            for p, at, c in zip(rows["p"], rows["key"], rows["conv_id"]):
                if text and (at != key or size >= CHUNK):
                    out.append((key, p, k, ",".join(text)))
                    text, size, k = [], 0, k + 1
                key, part = at, p
                text.append(str(c))
                size += len(text[-1]) + 1
            yield pd.DataFrame(out, columns=["key", "p", "k", "ids"])
        if text:
            yield pd.DataFrame([(key, part, k, ",".join(text))], columns=["key", "p", "k", "ids"])

    def digest(batches):
        key, sha = None, None
        for rows in batches:
            out = []
            for at, ids in zip(rows["key"], rows["ids"]):
                if at != key:
                    out += [(key, sha.hexdigest())] if sha else []
                    key, sha = at, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=["key", "ends_sha256"])
        if sha:
            yield pd.DataFrame([(key, sha.hexdigest())], columns=["key", "ends_sha256"])

    ranged = found.where("ended").select("key", "conv_id").orderBy("key", "conv_id").withColumn("p", F.spark_partition_id())
    parts = ranged.mapInPandas(chunks, "key string, p int, k long, ids string")
    return parts.repartition("key").sortWithinPartitions("key", "p", "k").mapInPandas(digest, "key string, ends_sha256 string")


def doubled(pred: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first link of each link's run, and the sums of ``weights`` over the run's links before it; ``pred`` -1: none."""
    own = np.arange(len(pred))
    head = np.where(pred < 0, own, pred)
    sums = np.where((pred < 0)[:, None], 0, weights[pred]) if len(pred) else weights
    while len(pred) and not np.array_equal(head[head], head):
        sums, head = sums + sums[head], head[head]
    return head, sums


def predecessors(ids: np.ndarray, nexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each link's predecessor (-1: none here), and whether its successor is missing here."""
    order = np.argsort(ids)
    at = np.minimum(np.searchsorted(ids, nexts, sorter=order), max(len(ids) - 1, 0))
    found = order[at] if len(ids) else at
    here = ids[found] == nexts if len(ids) else np.zeros(0, bool)
    pred = np.full(len(ids), -1)
    pred[found[here]] = np.flatnonzero(here)
    return pred, ~here


def _link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The partition's arcs (2v: enter, 2v + 1: exit) in runs: the first arc of the run and the sums before the arc;
    ``after``: the run's successor, at its last arc."""
    rows = pd.concat(list(batches), ignore_index=True)
    v, n = rows["v"].to_numpy(np.int64), len(rows)
    nexts = np.concatenate([rows["after_enter"], rows["after_exit"]]).astype(np.int64)
    weights = np.zeros((2 * n, 3), np.int64)
    weights[:, 0] = 1
    weights[:n, 1], weights[:n, 2] = rows["leaf"], rows["saved"]
    ids = np.concatenate([2 * v, 2 * v + 1])
    pred, last = predecessors(ids, nexts)
    head, sums = doubled(pred, weights)
    yield pd.DataFrame({"arc": ids, "head": ids[head], **dict(zip(W, sums.T)), "last": last, "after": nexts,
                        **{f"own_{c}": x for c, x in zip(W, weights.T)}})


def ranked(links: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """(id, sums before it) of every link of one list, given (id, after, sums of its own); ``after`` -1 ends the list."""
    undo, k = [], 0
    while links.count() > at_once:
        k += 1

        def coin(c, k=k):
            return F.pmod(F.xxhash64(c, F.lit(k)), F.lit(2))
        mate = (coin("id") == 0) & (F.col("after") >= 0) & (coin("after") == 1)
        mates = links.where(mate).select(F.col("id").alias("by"), F.col("after").alias("id"), *[F.col(c).alias(f"by_{c}") for c in W])
        joined = settle(links.where(coin("id") == 1).join(mates, "id", "left"))
        taken = joined.where("by IS NOT NULL")
        merged = taken.select(F.col("by").alias("id"), "after", *[(F.col(c) + F.col(f"by_{c}")).alias(c) for c in W])
        undo.append(taken.select("id", "by", *[f"by_{c}" for c in W]))
        links = settle(merged.unionByName(joined.where("by IS NULL").select("id", "after", *W)).unionByName(
            links.where((coin("id") == 0) & ~mate).select("id", "after", *W)))

    def rank(batches):
        rows = pd.concat(list(batches), ignore_index=True)
        ids = rows["id"].to_numpy(np.int64)
        pred, _ = predecessors(ids, rows["after"].to_numpy(np.int64))
        yield pd.DataFrame({"id": ids, **dict(zip(W, doubled(pred, rows[W].to_numpy(np.int64))[1].T))})

    sums = ", ".join(f"{c} long" for c in W)
    out = links.select("id", "after", *W).coalesce(1).mapInPandas(rank, f"id long, {sums}")  # ``at_once`` rows at most
    for taken in reversed(undo):
        there = out.select(F.col("id").alias("by"), *W)
        back = taken.join(there, "by").select("id", *[(F.col(c) + F.col(f"by_{c}")).alias(c) for c in W])
        out = settle(out.unionByName(back))
    return out


def prefix_trie(conversations: DataFrame, at_once: int = AT_ONCE, local: int = LOCAL) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    found = settle(members(conversations))
    named = found.groupBy("depth", "key").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
                                              F.max("n").alias("n"), F.max("parent").alias("parent"))
    named = settle(named.withColumn("__shard", shard_of(spark, "key")))
    over = named.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = with_position(attach(named, over, "parent").drop("__shard").orderBy("parent_conv_id", "depth", "conv_id"), "v")
    nodes = settle(nodes)
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(
        F.min("v").alias("first"), F.max("v").alias("last"), F.count(F.lit(1)).alias("n_children"))
    family = settle(nodes.select("key", "v").join(children, "key").drop("key"))
    rows = (nodes.join(family.select("v", "first", "n_children"), "v", "left")
            .join(family.select(F.col("last").alias("v"), F.col("v").alias("up")), "v", "left")
            .select("v", "key", "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
                    F.coalesce(2 * F.col("first"), 2 * F.col("v") + 1).alias("after_enter"),
                    F.when(F.col("depth") == 0, -1).otherwise(F.coalesce(2 * F.col("up") + 1, 2 * F.col("v") + 2)).alias("after_exit"),
                    F.col("first").isNull().cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("n")).alias("saved")))
    rows = settle(rows)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * rows.count() // local))
    placed = rows.select("v", "after_enter", "after_exit", "leaf", "saved",
                         F.xxhash64("conv_id", F.floor(F.col("depth") / STRETCH)).alias("near")).repartition(parts, "near").drop("near")
    kinds = ", ".join(f"{p}{c} long" for p in ("", "own_") for c in W)
    arcs = settle(placed.mapInPandas(_link, f"arc long, head long, last boolean, after long, {kinds}"))
    links = settle(arcs.where("last").select(F.col("head").alias("id"), "after", *[(F.col(c) + F.col(f"own_{c}")).alias(c) for c in W]))
    starts = ranked(links, at_once).select(F.col("id").alias("head"), *[F.col(c).alias(f"to_{c}") for c in W])
    at = arcs.join(starts, "head").select(F.shiftright("arc", 1).alias("v"), F.when(F.col("arc") % 2 == 0, -1).otherwise(1).alias("side"),
                                          *[(F.col(c) + F.col(f"to_{c}")).alias(c) for c in W])
    totals = at.groupBy("v").agg(F.sum(F.col("leaves") * F.col("side")).alias("n_leaves"), F.sum(F.col("saved") * F.col("side")).alias("saved_tokens"),
                                 F.min("arcs").alias("tour_at"))
    nothing = hashlib.sha256(b"").hexdigest()
    return (rows.drop("saved").join(totals, "v").join(ends(found), "key", "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"), "tour_at"))
