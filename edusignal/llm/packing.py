"""Best-fit packing by minimum bin slack.

Bins are filled one after another: the longest length left seeds a bin, and a subset-sum
over the lengths that are left, as one bitset, finds the fullest feasible combination with
it, which is then removed.  Only lengths matter, and there are at most ``capacity`` of them:
the driver plans on the histogram of lengths (a bounded table), and applies a combination
as often as its lengths last, which is what bin-by-bin search would do.  Documents
never pass through the driver: every piece gets its rank among the pieces of its length,
and rank and length give its bin and place.

Ranks are counted in parts (length, hash part): a length that a third of all pieces share
is spread over all parts.

Defined cases: a null text counts as empty and still takes its end-of-text token; null
doc_ids and repeated rows are packed like any other; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_alphabet
from .common import held, id_text, settle, shard_of

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Words that a worker remembers as recent, and as many again as older.
REMEMBERED = 300_000
#: ASCII punctuation (no apostrophe) right after a letter: there the tokenizer cuts anyway.
AFTER_LETTER = re.compile(r"(?<=[a-zß-öø-ÿ])[!-&(-/:-@\[-`{-~]")
#: The byte-level stand-ins of bytes whose own character isn't printable.
STAND_INS = {b: c for c, b in byte_alphabet().items() if ord(c) != b}


def folded(text: str) -> str:
    """A text with the same ids that has fewer different words: lower case, and a space where the
    tokenizer cuts between a letter and punctuation.  Latin-1 only, where lower-casing is letter by
    letter and normalisation does nothing; texts that may hold a special token stay as they are."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text if "<|" in text else AFTER_LETTER.sub(r" \g<0>", text.lower())


class WordIds(dict):
    """Word to its ids as little-endian uint32 bytes.  The tokenizer drops white space and never joins
    across it, so it is asked once for each new word free of ASCII white space."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.older: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            shown = word.decode("utf-8", "surrogatepass")
            if shown.isalpha() and shown.islower() and max(shown) <= "ÿ":  # one piece that needs no normalising
                own = [t.id for t in self.tok.model.tokenize(word.decode("latin-1").translate(STAND_INS))]
            else:
                own = self.tok.encode(shown, add_special_tokens=False).ids
            ids = array("I", own).tobytes()
        if len(self) >= REMEMBERED:  # words not met for long are forgotten
            self.older = {}  # first: three generations are never held at once
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, folded(text).encode("utf-8", "surrogatepass").split()))


def word_ids(path: str) -> WordIds:
    """The worker's table: what it remembers serves its later tasks."""
    return held(f"words of {path}", lambda: WordIds(path))


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Token pieces of every document, ``capacity`` tokens each but the last."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = word_ids(vocabulary).encode, array("I", [end_id]).tobytes()
        for rows in batches:
            out = []
            for doc, text in zip(rows["doc_id"], rows["text"]):
                ids = encode(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            made = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield made.astype({"doc_id": "Int64"})

    return id_text(docs).select(F.col("doc_id").cast("long"), "text").mapInPandas(cut, PIECES)


def fullest(room: int, left: dict[int, int], lengths: list[int]) -> list[tuple[int, int]]:
    """(length, copies) of the combination of lengths that fills ``room`` best; ``lengths`` falls."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for size in lengths:
        copies = min(left[size], room // size) if size <= room else 0
        chunk = 1
        while copies:
            chunk = min(chunk, copies)
            steps.append((size, chunk, reach))
            reach |= reach << size * chunk & mask
            copies -= chunk
            chunk *= 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for size, chunk, before in reversed(steps):
        if not before >> total & 1:
            used[size] = used.get(size, 0) + chunk
            total -= size * chunk
    return sorted(used.items(), reverse=True)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, from rank, copies a bin, first bin, place in the bin, bins): which ranks of a
    length go where.  Its size depends on ``capacity``, not on the number of pieces."""
    left = {k: v for k, v in histogram.items() if v > 0}
    rank, out, bins = dict.fromkeys(left, 0), [], 0
    lengths = sorted(left, reverse=True)
    while lengths:
        seed = lengths[0]
        left[seed] -= 1
        need = {seed: 1}
        for size, copies in fullest(capacity - seed, left, lengths):
            need[size] = need.get(size, 0) + copies
        left[seed] += 1
        times = min(left[size] // copies for size, copies in need.items())
        at = 0
        for size, copies in need.items():
            out.append((size, rank[size], copies, bins, at, times))
            rank[size] += copies * times
            left[size] -= copies * times
            at += size * copies
        bins += times
        lengths = [size for size in lengths if left[size]]
    return out


def pack(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset`` there."""
    spark = docs.sparkSession
    rows = settle(pieces(docs, vocabulary, capacity, end_id)
                  .withColumn("__shard", shard_of(spark, F.col("doc_id"), F.col("piece"), F.col("ids_crc32"))))
    parts = settle(rows.groupBy("length", "__shard").agg(F.count(F.lit(1)).alias("n")))
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    steps = sorted(plan(counts, capacity))
    size, first, copies, bin_, place, _ = (np.array(x, dtype=np.int64) for x in zip(*steps)) if steps else [np.zeros(0, np.int64)] * 6

    before = Window.partitionBy("length").orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("length", "__shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    turn = Window.partitionBy("length", "__shard").orderBy("doc_id", "piece", "start", "ids_crc32")

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        held("places", dict)  # no words beside the rows that are placed
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.searchsorted(size * (1 << 48) + first, n * (1 << 48) + r, "right") - 1
        j = r - first[at]
        return pd.DataFrame({"sequence_id": bin_[at] + j // copies[at], "offset": place[at] + j % copies[at] * n})

    ranked = (rows.join(bases, ["length", "__shard"])
              .withColumn("__rank", F.col("__base") + F.row_number().over(turn) - 1))
    return (ranked.withColumn("__at", placed("length", "__rank"))
            .select("doc_id", "piece", "start", "length", "ids_crc32", "__at.sequence_id", "__at.offset"))
