"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints at most 2r bits apart share a value within r bits of both.  So every
distinct fingerprint emits all its variants within r = distance // 2 bits (2081 of 64 bits
for r = 2), the variants are shuffled, and fingerprints that emitted the same variant
are linked.  Emitting 2081 plain rows a document would be far larger than the
documents, so the shuffle has two steps:

1. Blocks of about ``BLOCK`` fingerprints send their variants as sorted hashes, in
   Elias-Fano form (about 2.4 bytes each), to the bucket of the hash's leading bits.  A
   bucket finds the hashes that came twice and tells the blocks which.
2. Blocks send the full variants behind those hashes, with their fingerprint, as rows.
   Rows of one variant are de-duplicated, linked to the variant's smallest fingerprint
   and verified by bit distance.  A hash collision costs a row, never a link.

A variant has at most 2081 senders (the points within 2 bits of it), so no bucket of a
variant grows with the input.  Copies have one fingerprint and are collapsed first.
Components come from alternating large-star and small-star rounds over the links, each
written to the shared checkpoint folder.

Defined cases: null text counts as empty, texts without words have fingerprint zero and
are linked like any other; null doc_ids count last for the smallest id; repeated rows share
their fingerprint; an empty table gives no rows; an odd distance is refused.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import attach, held, kept_rows, settle, shard_of

BITS = 64
#: Fingerprints a block, and variants a bucket (a power of two) at most: bounds on a task's memory.
BLOCK, BUCKET = 1024, 1 << 22
#: Hash bits beyond those that count the variants: a chance collision in one of 2**SPARE.
SPARE = 9


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of the text's word shingles, as an unsigned integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], seed) for a, b in zip(starts.tolist(), (ends[shingle - 1:] - 1).tolist())]
    votes = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = np.array(hashes[i:i + (1 << 14)], dtype="<u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_udf(shingle: int, seed: int):
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle, seed) for t in texts], dtype=np.uint64).view(np.int64))
    return run


def masks(radius: int) -> np.ndarray:
    """All 64-bit values with at most ``radius`` set bits."""
    out, layer = [np.zeros(1, np.uint64)], [0]
    for _ in range(radius):
        layer = sorted({m | 1 << b for m in layer for b in range(BITS) if not m >> b & 1})
        out.append(np.array(layer, dtype=np.uint64))
    return np.concatenate(out)


def mixed(values: np.ndarray, bits: int) -> np.ndarray:
    """The leading ``bits`` of a mixing hash; works in place."""
    values ^= values >> np.uint64(32)
    values *= np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(32)
    values *= np.uint64(0xD6E8FEB86659FD93)
    values >>= np.uint64(64 - bits)
    return values


def pack(values: np.ndarray, bits: int) -> bytes:
    """Sorted values below 2**bits in Elias-Fano form: 16 low bits each, the rest in unary."""
    high = (values >> np.uint64(16)).astype(np.int64)
    unary = np.zeros(len(values) + (1 << max(0, bits - 16)), np.uint8)
    unary[high + np.arange(len(values))] = 1
    return len(values).to_bytes(8, "little") + (values & np.uint64(0xFFFF)).astype("<u2").tobytes() + np.packbits(unary).tobytes()


def unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    low = np.frombuffer(data, "<u2", n, 8).astype(np.uint64)
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=8 + 2 * n)))[:n]
    return ((ones - np.arange(n)).astype(np.uint64) << np.uint64(16)) | low


def links(prints: DataFrame, distance: int) -> DataFrame:
    """Verified links (a, b), a > b, among the distinct fingerprints ``fp``: every two that
    share a variant are joined through the variant's smallest fingerprint.  ``distance`` is even: with an odd one, two
    fingerprints of a variant could be one bit too far apart, and links through the smallest would be lost."""
    if distance % 2:
        raise ValueError("the distance must be even")
    ball = masks(distance // 2)
    n = prints.count()
    variants = max(1, n * len(ball))
    bits = max(24, min(60, math.ceil(math.log2(variants)) + SPARE))
    top = max(0, math.ceil(math.log2(max(1, variants / BUCKET))))
    rest = bits - top
    blocks = max(1, math.ceil(n / BLOCK))
    # Few bytes but much work a block: a stated number of partitions, which Spark doesn't merge.
    block = prints.select(F.pmod(F.xxhash64("fp", F.lit("block")), F.lit(blocks)).cast("int").alias("block"), "fp").repartition(blocks, "block")

    def hashes(fps: pd.Series) -> np.ndarray:
        held("balls", dict)  # no other stage's memory beside these arrays
        own = fps.to_numpy(np.int64).view(np.uint64)
        return mixed((own[:, None] ^ ball[None, :]).reshape(-1), bits)

    def send(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        all_ = hashes(rows["fp"])
        all_.sort()
        cuts = np.searchsorted(all_, np.arange(1 << top, dtype=np.uint64) << np.uint64(rest)).tolist() + [len(all_)]
        inner = np.uint64((1 << rest) - 1)
        out = [(b, key[0], pack(all_[i:j] & inner, rest)) for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i]
        return pd.DataFrame(out, columns=["bucket", "block", "data"])

    def meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        held("balls", dict)
        parts = [unpack(d) for d in rows["data"]]
        all_ = np.concatenate(parts)
        all_.sort()
        twice = np.unique(all_[1:][all_[1:] == all_[:-1]])
        del all_
        out = []
        for to, part in zip(rows["block"], parts):
            at = np.minimum(np.searchsorted(twice, part), max(0, len(twice) - 1))
            hit = np.unique(part[twice[at] == part]) if len(twice) else part[:0]
            if len(hit):
                out.append((to, (hit | np.uint64(int(key[0]) << rest)).astype("<u8").tobytes()))
        return pd.DataFrame(out, columns=["block", "hits"])

    def tell(rows: pd.DataFrame, hits: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or hits.empty:
            return pd.DataFrame({"variant": np.zeros(0, np.int64), "fp": np.zeros(0, np.int64)})
        wanted = np.sort(np.concatenate([np.frombuffer(h, "<u8") for h in hits["hits"]]))
        all_ = hashes(rows["fp"])
        at = np.minimum(np.searchsorted(wanted, all_), len(wanted) - 1)
        where = np.flatnonzero(wanted[at] == all_)
        own = rows["fp"].to_numpy(np.int64).view(np.uint64)[where // len(ball)]
        return pd.DataFrame({"variant": (own ^ ball[where % len(ball)]).view(np.int64), "fp": own.view(np.int64)})

    packed = block.groupBy("block").applyInPandas(send, "bucket int, block int, data binary")
    hits = packed.groupBy("bucket").applyInPandas(meet, "block int, hits binary")
    rows = (block.groupBy("block").cogroup(hits.groupBy("block"))
            .applyInPandas(tell, "variant long, fp long"))
    # At most len(ball) fingerprints share a variant: the list is bounded.
    groups = rows.groupBy("variant").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    ends = groups.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).where("a != b").distinct()
    return ends.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node reachable."""
    spark = edges.sparkSession

    def least(rows: DataFrame) -> DataFrame:
        """Of rows (u, v): (u, v, m), m the smallest of u and its v's; a hub's rows stay spread."""
        low = rows.groupBy("u").agg(F.min("v").alias("__m"))
        cut = rows.withColumn("__shard", shard_of(spark, F.col("v")))
        return attach(cut, low, "u").select("u", "v", F.least("u", "__m").alias("m"))

    now, seen = settle(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))), None
    for _ in range(most):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = settle(least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small = least(large)
        now = settle(small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                     .unionAll(small.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_groups(docs: DataFrame, shingle: int = 4, distance: int = 4, seed: int = 42) -> DataFrame:
    """One row a document: doc_id, ``__h`` (hash of the text), fp (signed), component_id and
    ``__rep`` (struct of the row that stands for its component)."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = settle(docs.select("doc_id", F.xxhash64("text").alias("__h"), shard_of(spark, F.col("doc_id")).alias("__shard"),
                              fingerprint_udf(shingle, seed)(F.coalesce(F.col("text"), F.lit(""))).alias("fp")))
    mine = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("__h").alias("h"))
    prints = settle(rows.groupBy("fp").agg(F.min(mine).alias("__rep")))
    roots = components(links(prints.select("fp"), distance))
    known = settle(prints.join(roots, prints["fp"] == roots["node"], "left")
                   .select("fp", "__rep", F.coalesce("root", "fp").alias("__root"),
                           shard_of(spark, F.col("fp")).alias("__shard")))
    best = known.groupBy("__root").agg(F.min("__rep").alias("__best"))
    named = attach(known, best, "__root").select("fp", F.col("__best").alias("__rep"))
    return attach(rows, named, "fp").select("doc_id", "__h", "fp", F.col("__rep.id").alias("component_id"), "__rep")


def drop_near_copies(docs: DataFrame, shingle: int = 4, distance: int = 4, seed: int = 42) -> DataFrame:
    """``docs`` (all columns) with one row, that of the smallest doc_id, of each component."""
    found = near_groups(docs, shingle, distance, seed)
    return kept_rows(docs, found.select(F.col("__rep.id").alias("__id"), F.col("__rep.h").alias("__h")).distinct())
