"""Language identification as multilingual mixture inference.

A text's letters (lower-cased, other characters as one space) give its trigrams, hashed to
``BUCKETS``.  Each language has smoothed trigram likelihoods from labelled documents.  A document is a
mixture: expectation-maximisation finds the languages' proportions, and languages join the
set one by one while the likelihood rises by more than a penalty of ``PENALTY * log(trigrams)``.
The likelihood is concave in the proportions, so a language whose first-order gain is below
the penalty can't pay for itself, and EM is skipped for it; the result is the same.

Training takes about ``per_language`` (default 5000) documents of each language, by hash of doc_id, one at least, and of rows
that repeat a doc_id one.  The model is broadcast: half a MB a language.

Defined cases: null texts and texts without a letter (Unicode category L; marks alone are none) are ``und`` with score 0;
equal likelihoods go to the alphabetically first language; repeated rows are judged one by one; without training rows, as on an
empty table, every text is ``und``; null doc_ids are not held out and not learned from; extra columns are not read.
"""

from __future__ import annotations

import math
import unicodedata
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

BUCKETS, PENALTY, SMOOTH = 1 << 15, 3.0, 0.1
#: Overlapping trigrams count each character three times.
OVERLAP = 3


@cache
def letters() -> tuple[np.ndarray, np.ndarray]:
    """Which code points are letters, and which are letters or combining marks."""
    kind = np.array([ord(unicodedata.category(chr(i))[0]) for i in range(0x110000)], dtype=np.uint8)
    return kind == ord("L"), (kind == ord("L")) | (kind == ord("M"))


def trigrams(text: str | None) -> np.ndarray:
    """Bucket of every trigram of the text, in order; empty without letters."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter, within = letters()
    if not letter[codes].any():
        return np.zeros(0, np.int64)
    is_letter = within[codes]  # a mark belongs to its word
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first of other characters stays, as a space
    line = np.concatenate(([32], np.where(is_letter, codes, 32)[keep], [32])).astype(np.uint64)
    line = line[np.concatenate(([True], (line[1:] != 32) | (line[:-1] != 32)))]
    mix = (line[:-2] * np.uint64(0x9E3779B1) + line[1:-1]) * np.uint64(0x85EBCA77) + line[2:]
    mix = (mix ^ (mix >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mix >> np.uint64(49)).astype(np.int64)


class Mixture:
    """Languages and their trigram likelihoods."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.langs = sorted(counts)
        table = np.array([counts[x] for x in self.langs], dtype=float).reshape(len(self.langs), BUCKETS)
        self.table = (table + SMOOTH) / (table.sum(axis=1, keepdims=True) + SMOOTH * BUCKETS)
        self.log = np.log(self.table)

    def em(self, p: np.ndarray, n: np.ndarray, start: np.ndarray, steps: int = 60) -> tuple[np.ndarray, float]:
        share, last = start, -np.inf
        for _ in range(steps):
            joint = share[:, None] * p
            total = joint.sum(axis=0)
            like = float(n @ np.log(total))
            if like - last < 1e-4:
                break
            last = like
            share = (joint / total) @ n / n.sum()
        return share, like

    def infer(self, grams: np.ndarray) -> list[tuple[str, float]]:
        """(language, proportion), largest proportion first."""
        if not len(grams) or not self.langs:
            return []
        at, n = np.unique(grams, return_counts=True)
        n = n / OVERLAP
        size = n.sum()
        fee = PENALTY * max(1.0, math.log(size))
        alone = self.log[:, at] @ n
        chosen = [int(np.argmax(alone))]
        share, like = np.ones(1), float(alone[chosen[0]])
        p = self.table[:, at]
        while len(chosen) < len(self.langs):
            now = share @ p[chosen]
            gain = p @ (n / now) - size  # first-order bound of what a language can add
            gain[chosen] = -np.inf
            best = None
            for new in np.flatnonzero(gain > fee):
                start = np.append(share * 0.9, 0.1)
                found = self.em(p[[*chosen, new]], n, start)
                if found[1] - like > fee and (best is None or found[1] > best[2]):
                    best = (int(new), *found)
            if best is None:
                break
            chosen, share, like = [*chosen, best[0]], best[1], best[2]
        return sorted(((self.langs[i], float(s)) for i, s in zip(chosen, share)), key=lambda x: (-x[1], x[0]))


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, per_language: int = 5000) -> Mixture:
    """Likelihoods from ``docs`` (text, lang, doc_id); rows with a null there teach nothing.  About ``per_language`` doc_ids of
    each language, by their hash, one at least; of rows that repeat a doc_id and language, the one whose text has the smallest hash."""
    ship_package(docs.sparkSession)
    rows = docs.where("doc_id is not null and lang is not null")  # no text is read for the sizes
    part = F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 30)) / float(1 << 30)
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.03).alias("n"), F.min(part).alias("first")).collect()  # a row a language
    if not sizes:
        return Mixture({})
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], max(r["first"], min(1.0, per_language / r["n"])))])
    rows = rows.where(part <= F.element_at(share, F.col("lang")))
    rows = rows.groupBy("lang", "doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("lang", "text")

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for part in batches:
            for lang, text in zip(part["lang"], part["text"]):
                own = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                own += np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, own in total.items():
            at = np.flatnonzero(own)
            yield pd.DataFrame({"lang": lang, "at": at, "n": own[at]})

    summed = rows.mapInPandas(count, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n"))
    counts: dict[str, np.ndarray] = {}
    for r in summed.toArrow().to_pylist():  # at most BUCKETS rows a language
        counts.setdefault(r["lang"], np.zeros(BUCKETS))[r["at"]] = r["n"]
    return Mixture(counts)


def identify(docs: DataFrame, model: Mixture) -> DataFrame:
    """doc_id, lang_pred, score (the language's proportion) and mixture (array of language and proportion)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # half a MB a language

    @F.pandas_udf("lang_pred string, score double, mixture array<struct<lang:string,share:double>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        model = shared.value
        found = [model.infer(trigrams(t)) for t in texts]
        return pd.DataFrame({"lang_pred": [x[0][0] if x else "und" for x in found], "score": [min(1.0, x[0][1]) if x else 0.0 for x in found],
                             "mixture": [[{"lang": a, "share": b} for a, b in x] for x in found]})
    return docs.select("doc_id", run(F.coalesce(F.col("text"), F.lit(""))).alias("__r")).select("doc_id", "__r.*")
