"""Personal data by gradient-boosted candidates.

Base spans come from fixed patterns and checks (e-mail, IP address, card number, phone
number).  High-recall generators propose further, overlapping spans: also spelled-out
``(at)``/``[dot]`` addresses, other separators, missing plus signs.  Boosted regression trees score each
candidate from its format (digits, groups, separators, checks) and context (neighbouring
characters, key words before it).  A kind's threshold is calibrated on held-out candidates so that at
most one accepted in a hundred is wrong; accepted candidates that touch no base span or better candidate
are added.

Trees learn from those of at most about ``sample`` (default 60000) documents, by hash of doc_id (of rows that repeat
a doc_id, one), that hold a digit or an @, and from at most about ``most`` (default 30000) examples of each kind and label,
by hash of doc_id, start, kind and form, which count for all examples when thresholds are calibrated: base spans are positive, as are rewritten forms of them (``(at)`` for @, dots for spaces); candidates that
touch no base span, dates, amounts and other numbers in a base span's place, and digit-shuffled
forms are negative.

Defined cases: null counts as empty (no spans, digest of the empty string); spans of
different kinds may overlap; without training rows the method adds nothing.
"""

from __future__ import annotations

import hashlib
import random
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted, fit
from .common import id_text, one_a_key, sampled, settle

KINDS = ("email", "ip", "card", "phone")

# Base patterns (a look-behind keeps a run of digits from being scanned once a digit).
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Generators: wider forms of the same kinds, of bounded length.
WIDE = {
    "email": re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64}\s?(?:@|\(at\)|\[at\])\s?[\w-]{1,63}(?:\s?(?:\.|\(dot\)|\[dot\])\s?[A-Za-z0-9-]{2,63}){1,5}", re.I),
    "ip": re.compile(r"(?<![\d.])\d{1,3}(?:(?:\.|\[\.\]|\(\.\))\d{1,3}){3}(?![\d.])"),
    "card": re.compile(r"(?<![\d+.])\d(?:[ . -]?\d){12,18}(?!\d)"),
    "phone": re.compile(r"(?<![\d+.])(?:\+|00)?\(?\d(?:[ (). /-]{0,2}\d){8,14}(?!\d)"),
}
HINTS = re.compile(r"\b(?:(mail|e-mail|email|contact|write)|(ip|host|server|address|addr)|(card|visa|credit|payment|iban)|(tel|phone|call|fax|mobile|cell))\b", re.I)
ANY = re.compile(r"[0-9@]|[(\[]at[)\]]", re.I)
KNOWN_TLD = frozenset("com org net edu gov io info de fr es uk eu".split())


# Forms of numbers that aren't personal; they take a base span's place as negatives.
OTHER_NUMBERS = ("2024-01-02 10:11:12", "02.03.2021 14:05", "1990-12-31", "10:11:12.123456", "1 234 567.89", "12-13-14-15", "00012345678",
                 "978-3-16-148410-0", "2020 2021 2022", "3.141592653589", "1.2.3.4", "v 10.0.19041.1", "100 200 300 400")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def emails(text: str):
    """Leftmost, non-overlapping: at each @, the longest local part before and the domain behind."""
    done, at = 0, text.find("@")
    while at >= 0:
        i = at
        while i > done and text[i - 1] in LOCAL_CHARS:
            i -= 1
        m = DOMAIN.match(text, at + 1) if i < at else None
        if m:
            yield i, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    if not ANY.search(text):
        return []
    out = [(0, a, b) for a, b in emails(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 13 <= len(d := only_digits(m[0])) <= 19 and luhn(d)]
    out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(only_digits(m[0])) <= 15]
    return out


def candidates(text: str) -> list[tuple[int, int, int]]:
    """Proposed spans of every kind; they may overlap."""
    if not ANY.search(text):
        return []
    return [(k, *m.span()) for k, kind in enumerate(KINDS) for m in WIDE[kind].finditer(text)]


def features(text: str, kind: int, a: int, b: int) -> list[float]:
    """Format of text[a:b] and its surroundings."""
    s, before, after = text[a:b], text[max(0, a - 30):a], text[b:b + 2]
    digits = only_digits(s)
    groups = re.findall(r"\d+", s)
    hints = {i for m in HINTS.finditer(before) for i in range(1, 5) if m[i]}
    tail = re.findall(r"[A-Za-z]+\Z", s)
    return [
        kind, len(s), len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        len(set(digits)), s.count(" "), s.count("-"), s.count("."), s.count("("), float(s[:1] == "+"), float(s[:1] == "("),
        float(bool(digits) and luhn(digits)), float(all(int(g) <= 255 for g in groups[:4] if len(g) < 5)), float("@" in s),
        float(bool(tail) and tail[0].lower() in KNOWN_TLD), len(tail[0]) if tail else 0, sum(c.isalpha() for c in s),
        float(kind + 1 in hints), float(bool(hints - {kind + 1})),
        float(before[-1:].isalnum()), float(before[-1:] in ("", " ", "\n", "\t")), float(after[:1].isalnum()),
        float(after[:1] in ("", " ", "\n", ".", ",")), float(before[-1:] in ("$", "#", "=", "/", "_")),
    ]


def examples(text: str, rng: random.Random) -> list[tuple[list[float], int, int]]:
    """Feature rows, labels and starts from one text."""
    base = base_spans(text)
    inside: dict[int, list[tuple[int, int]]] = {k: [(a, b) for x, a, b in base if x == k] for k in range(len(KINDS))}
    out = []
    for k, a, b in candidates(text):
        if not any(i < b and a < j for i, j in inside[k]):
            out.append((features(text, k, a, b), 0, a))
    for k, a, b in base:
        s, digits = text[a:b], only_digits(text[a:b])
        left, right = text[max(0, a - 40):a], text[b:b + 40]

        def put(form: str) -> list[float]:
            return features(left + form + right, k, len(left), len(left) + len(form))

        forms = {0: [s.replace("@", " (at) "), s.replace("@", "[at]")], 1: [s.replace(".", "[.]")],
                 2: [" ".join(digits[i:i + 4] for i in range(0, len(digits), 4))], 3: [s[1:], "00" + s[1:], s.replace(" ", ".")]}[k]
        out += [(put(f), 1, a) for f in dict.fromkeys([s, *forms])]
        other = rng.choice(OTHER_NUMBERS)
        shown, end = left + other + right, len(left) + len(other)
        real = set(base_spans(shown))
        out += [(features(shown, *c), 0, a) for c in candidates(shown) if c[1] < end and len(left) < c[2] and c not in real]
        if k != 0:  # the same length and context without the form: plain or shuffled digits
            mixed = "".join(rng.sample(digits, len(digits)))
            out += [(put(f), 0, a) for f in dict.fromkeys([mixed, mixed[:max(9, len(mixed) // 2)]]) if not (k == 2 and luhn(f))]
    return out


@dataclass
class Model:
    trees: Boosted | None = None
    cuts: dict[int, float] = field(default_factory=dict)

    def spans(self, text: str) -> tuple[list, list]:
        """(base spans, all spans), each by kind, then start."""
        base = base_spans(text)
        if self.trees is None:
            return base, base
        every = [(a, b) for _, a, b in base]
        open_ = [c for c in candidates(text) if self.cuts.get(c[0], 2) <= 1 and not any(c[1] < b and a < c[2] for a, b in every)]
        if not open_:
            return base, base
        p = self.trees.predict(np.array([features(text, *c) for c in open_]))
        added = []
        for i in np.argsort(-p, kind="stable"):
            k, a, b = open_[i]
            if p[i] >= self.cuts[k] and not any(a < y and x < b for x, y in every):
                added.append((k, a, b))
                every.append((a, b))
        return base, sorted(base + added)


def train(docs: DataFrame, sample: int = 60000, seed: int = 7, most: int = 30000) -> Model:
    """Trees and thresholds from a bounded sample of documents and of their examples."""
    rows = docs.select("doc_id", "text").where("doc_id is not null")
    # Chosen among the ids, whatever their rows; the texts are read once the ids are known.
    chosen = sampled(rows.select("doc_id").distinct(), sample)
    rows = one_a_key(rows.where(F.col("text").rlike("[0-9@]")).join(F.broadcast(chosen), "doc_id"), "doc_id")

    def make(batches):
        for part in batches:
            out = []
            for doc, text in zip(part["doc_id"], part["text"]):
                out += [(doc, a, i, int(x[0]), y, x) for i, (x, y, a) in enumerate(examples(text, random.Random(seed * 1_000_003 + doc)))]
                if len(out) >= 2000:
                    yield pd.DataFrame(out, columns=["doc_id", "a", "i", "k", "y", "x"])
                    out = []
            yield pd.DataFrame(out, columns=["doc_id", "a", "i", "k", "y", "x"])

    every = settle(rows.mapInPandas(make, "doc_id long, a int, i int, k int, y int, x array<double>"))
    n = {(r["k"], r["y"]): r["count"] for r in every.groupBy("k", "y").count().collect()}  # eight rows
    share = F.lit(1 << 30)
    for (k, y), m in n.items():
        if m > most:
            share = F.when((F.col("k") == k) & (F.col("y") == y), int(most / m * (1 << 30))).otherwise(share)
    got = every.where(F.pmod(F.xxhash64("doc_id", "a", "k", "i", F.lit("example")), F.lit(1 << 30)) < share).collect()  # about 8 * most
    if not got:
        return Model()
    got.sort(key=lambda r: (r["doc_id"], r["y"], r["x"]))
    x, y = np.array([r["x"] for r in got], dtype=float), np.array([r["y"] for r in got], dtype=float)
    held = np.array([r["doc_id"] % 4 == 0 for r in got])
    if held.all() or not held.any() or len(set(y[~held])) < 2:
        return Model()
    trees = fit(x[~held], y[~held])
    stands = np.array([max(1.0, n[r["k"], r["y"]] / most) for r in got])[held]  # for so many examples
    p, cuts = trees.predict(x[held]), {}
    for k in range(len(KINDS)):
        own = x[held][:, 0] == k
        good = [c for c in np.linspace(0.5, 0.99, 50) if (hit := p[own] >= c).any() and np.average(y[held][own][hit], weights=stands[own][hit]) >= 0.99]
        cuts[k] = float(max(0.8, good[0])) if good else 2.0
    return Model(trees, cuts)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, model: Model) -> DataFrame:
    """One row a document: numbers of base spans by kind, their digest, and all spans."""
    kind = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            base, all_ = model.spans(t)
            out.append((*(sum(k == i for k, _, _ in base) for i in range(4)), hashlib.sha256(written(base).encode()).hexdigest(), written(all_)))
        return pd.DataFrame(out, columns=[c.split()[0] for c in kind.split(", ")])
    return id_text(docs).select("doc_id", run("text").alias("__r")).select("doc_id", "__r.*")


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or joined overlap of spans, as its kind in angle brackets."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:] if spans else text


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (all columns) with all spans replaced in ``text``, and ``n_chars`` (if there) following it."""
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else redacted(t, model.spans(t)[1]) for t in texts], dtype=object)
    new = docs.withColumn("__text", run("text"))
    cols = {"text": F.col("__text"), "n_chars": F.when(F.col("__text") != F.col("text"), F.length("__text")).otherwise(F.col("n_chars")).cast("long")
            if "n_chars" in docs.columns else None}
    return new.select(*[(cols[c] if c in cols else F.col(f"`{c}`")).alias(c) for c in docs.columns])
