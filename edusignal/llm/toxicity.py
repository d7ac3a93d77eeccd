"""Toxicity by cumulative-link ordinal regression.

Features of a text are its words and their 5- to 7-letter beginnings, each with the value
(1 + sqrt(min(1, 50 * count / words))) / 2: half for being there, half for how often.  One more feature counts the words
with a loud feature (log odds of 3.5 or more, in a hundredth of the toxic documents).  Training uses a bounded sample of labelled documents
(``sample``, default 8000, by hash of doc_id; of rows that repeat a doc_id, one): the executors count in how many toxic and other
documents each feature occurs, the ``features`` (default 4096) that are most associated with toxic ones stay, and the
sample's sparse rows go to the driver, whose size these two parameters bound.

Labels are 0 or 1 only, so severity grades are made from them: grade 0 is not toxic; toxic
documents get grades 1 to 3 by thirds of the share of their words that carry toxic-associated
features.  The model is P(grade >= k) = sigmoid(w.x + b_k) with one w for all k and b_1 >= b_2 >= b_3, fitted by
full-batch gradient steps on the cumulative-link likelihood.  Severity is the expected grade,
sum of P(grade >= k).  The cut on P(grade >= 1) is calibrated on a held-out fifth of the sample.

Defined cases: null and wordless texts have no features and grade 0 probability as learned;
without labelled documents of both kinds nothing is toxic (probabilities 0); labels that
disagree for one doc_id count as toxic; rows with a null doc_id are scored but not learned from.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import one_a_key, sampled, settle

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (5, 6, 7)
GRADES = 3
#: Words whose features a worker remembers at most.
REMEMBERED = 300_000


def word_features(word: str) -> list[str]:
    return [word, *(f"^{word[:k]}" for k in PREFIXES if len(word) > k)]


def known_features(word: str, index, loud) -> list[str]:
    """The word's selected features, and the common feature of loud ones."""
    own = [f for f in word_features(word) if f in index]
    return own + ["#loud"] if any(f in loud for f in own) else own


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Model:
    """Weights of the selected features and the ordered thresholds."""
    weights: dict[str, float] = field(default_factory=dict)
    bias: tuple[float, ...] = (-35.0,) * GRADES
    cut: float = 1.1
    loud: frozenset[str] = frozenset()
    known: dict[str, list[tuple[str, float]]] = field(default_factory=dict)

    def score(self, text: str | None) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), P(grade >= 3)."""
        words = WORD.findall((text or "").lower())
        counts: dict[str, int] = {}
        if len(self.known) > REMEMBERED:
            self.known.clear()
        for w, n in Counter(words).items():
            has = self.known.get(w)
            if has is None:
                has = self.known[w] = known_features(w, self.weights, self.loud)
            for f in has:
                counts[f] = counts.get(f, 0) + n
        eta = sum(self.weights[f] * value(n, len(words)) for f, n in counts.items())
        return sigmoid(eta + np.array(self.bias)) if words else sigmoid(np.array(self.bias))


def value(count, words):
    return 0.5 + 0.5 * np.sqrt(np.minimum(1.0, 50.0 * count / max(1, words)))


def fit_cumulative(rows, cols, vals, grades, n_features, steps=800, rate=0.1, l2=2e-5):
    """(w, b) of the cumulative-link model; rows, cols, vals are the sparse matrix."""
    n = len(grades)
    w = np.zeros(n_features)
    share = [np.clip((grades >= k).mean(), 1e-3, 1 - 1e-3) for k in range(1, GRADES + 1)]
    b = np.array([math.log(s / (1 - s)) for s in share])
    m, v = np.zeros(n_features + GRADES), np.zeros(n_features + GRADES)
    for step in range(1, steps + 1):
        eta = np.bincount(rows, vals * w[cols], minlength=n)
        up = sigmoid(eta[:, None] + b[None, :])
        full = np.concatenate([np.ones((n, 1)), up, np.zeros((n, 1))], axis=1)
        hi, lo = full[np.arange(n), grades], full[np.arange(n), grades + 1]
        p = np.maximum(hi - lo, 1e-9)
        g_eta = 1 - hi - lo
        dens = full * (1 - full)
        g_b = np.zeros(GRADES)
        for k in range(1, GRADES + 1):
            g_b[k - 1] = np.mean(np.where(grades == k, dens[:, k] / p, 0) - np.where(grades == k - 1, dens[:, k] / p, 0))
        grad = np.concatenate([np.bincount(cols, vals * g_eta[rows], minlength=n_features) / n - l2 * w, g_b])
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad ** 2
        move = rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w += move[:n_features]
        b = np.minimum.accumulate(b + move[n_features:])
        b -= np.arange(GRADES) * 1e-6
    return w, b


def train(docs: DataFrame, labels: DataFrame, sample: int = 8000, features: int = 4096, least: int = 3) -> Model:
    """Model from the labelled documents among ``docs``; the bounds are described above."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("__toxic"))
    marks = sampled(marks, sample)  # at most about ``sample`` rows of two numbers: safe to broadcast
    # Read from the documents once, and written: the three passes below read the sample only.
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(marks), "doc_id")
    rows = settle(one_a_key(rows, "doc_id", "__toxic"))

    def count(batches):
        for part in batches:
            seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, toxic in zip(part["text"], part["__toxic"]):
                seen[int(toxic > 0)].update({f for w in set(WORD.findall(text.lower())) for f in word_features(w)})
            yield pd.DataFrame([(f, seen[0][f], seen[1][f]) for f in seen[0].keys() | seen[1].keys()], columns=["f", "n0", "n1"])

    total = rows.groupBy("__toxic").count().collect()  # two rows
    n1, n0 = sum(r["count"] for r in total if r["__toxic"] > 0), sum(r["count"] for r in total if r["__toxic"] <= 0)
    if not n1 or not n0:
        return Model()
    counted = rows.mapInPandas(count, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    odds = F.log((F.col("n1") + 0.5) / (n1 + 1)) - F.log((F.col("n0") + 0.5) / (n0 + 1))
    best = (counted.where(F.col("n1") >= least).withColumn("odds", odds).where("odds >= 1.5")
            .orderBy((F.col("odds") * F.sqrt("n1")).desc(), "f").limit(features).collect())
    if not best:
        return Model()
    loud = frozenset(r["f"] for r in best if r["odds"] >= 3.5 and r["n1"] >= max(5, 0.01 * n1))
    index = {f: i for i, f in enumerate(["#loud", *(r["f"] for r in best)])}

    def vector(batches):
        for part in batches:
            out = []
            for doc, text, toxic in zip(part["doc_id"], part["text"], part["__toxic"]):
                words = WORD.findall(text.lower())
                counts, hits = Counter(), 0
                for w, n in Counter(words).items():
                    own = known_features(w, index, loud)
                    counts.update(dict.fromkeys((index[f] for f in own), n))
                    hits += n * ("#loud" in own)
                out.append((doc, int(toxic > 0), hits / max(1, len(words)), list(counts), [float(value(n, len(words))) for n in counts.values()]))
            yield pd.DataFrame(out, columns=["doc_id", "toxic", "share", "at", "val"])

    got = (rows.mapInPandas(vector, "doc_id long, toxic int, share double, at array<int>, val array<double>")
           .collect())  # the bounded sample
    got.sort(key=lambda r: (r["doc_id"], r["toxic"], r["share"]))
    toxic = np.array([r["toxic"] for r in got])
    share = np.array([r["share"] for r in got])
    thirds = np.quantile(share[toxic == 1], [1 / 3, 2 / 3])
    grades = np.where(toxic == 1, 1 + np.searchsorted(thirds, share, "left"), 0)
    size = np.array([len(r["at"]) for r in got])
    row = np.repeat(np.arange(len(got)), size)
    col = np.array([i for r in got for i in r["at"]], dtype=np.int64)
    val = np.array([x for r in got for x in r["val"]])
    own = np.arange(len(got)) % 5 != 0
    local = np.cumsum(own) - 1
    w, b = fit_cumulative(local[row[own[row]]], col[own[row]], val[own[row]], grades[own], len(index))
    p = sigmoid(np.bincount(row, val * w[col], minlength=len(got)) + b[0])
    cut = calibrated(p[~own], toxic[~own])
    w, b = fit_cumulative(row, col, val, grades, len(index))  # the cut is known: now with the whole sample
    return Model({f: float(w[i]) for f, i in index.items()}, tuple(b.tolist()), cut, loud)


def calibrated(p: np.ndarray, toxic: np.ndarray, beta: float = 0.5) -> float:
    """The middle of the cuts on the held-out part with the best F-score (beta < 1 favours precision)."""
    cuts = np.linspace(0.4, 0.9, 51)

    def f(cut):
        hit = ((p >= cut) & (toxic == 1)).sum()
        made, there = (p >= cut).sum(), (toxic == 1).sum()
        return (1 + beta ** 2) * hit / max(1e-9, made + beta ** 2 * there)
    scores = np.array([f(c) for c in cuts])
    return float(np.median(cuts[scores >= scores.max() - 1e-12]))


def scorer(model: Model):
    """Column function: severity, toxic and the probabilities of a text."""
    @F.pandas_udf("severity double, toxic boolean, p1 double, p2 double, p3 double")
    def run(texts: pd.Series) -> pd.DataFrame:
        p = np.array([model.score(t) for t in texts]).reshape(-1, GRADES)
        return pd.DataFrame({"severity": p.sum(axis=1), "toxic": p[:, 0] >= model.cut, "p1": p[:, 0], "p2": p[:, 1], "p3": p[:, 2]})
    return run


def severity(docs: DataFrame, model: Model) -> DataFrame:
    """One row a document: doc_id, severity (0 to 3), toxic, and the three probabilities."""
    return docs.select("doc_id", scorer(model)(F.coalesce(F.col("text"), F.lit(""))).alias("__s")).select("doc_id", "__s.*")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (all columns) without toxic documents."""
    judged = docs.withColumn("__s", scorer(model)(F.coalesce(F.col("text"), F.lit(""))))
    return judged.where("not __s.toxic").select(*[F.col(f"`{c}`") for c in docs.columns])
