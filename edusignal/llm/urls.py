"""URL filter by character language-model ratio (DataFrame functions only).

Host and path become a string over 32 symbols (a-z, one for digits, / . -, one for others, a
boundary).  Two Markov models, of accepted and of rejected URLs, give each symbol's probability
after up to three symbols; contexts of variable order: Witten-Bell smoothing passes on to the next
shorter context, entirely so for contexts that were never seen.  The log ratio of the
models is a table of at most 32**4 rows whatever the input, joined by broadcast.  A URL's
score is its mean log ratio a symbol; it is rejected below a threshold calibrated on a held-out
quarter of the training URLs (by md5 of the URL), which never enters the models: they are counts
of the other three quarters, as the SQL has it, also once the cut is known.

Explicit rules (host, path, verdict) come first: a rule fits its host and all subdomains if
the path starts with the rule's, and the longest that fits decides.

Training URLs are chosen by the caller (``accepted``, ``rejected``: boolean columns).  The query takes
hosts with a term of ``SPAM_TERMS`` as rejected; as accepted, the others that no rule blocks.

Defined cases: null URLs and those without ``://`` have empty host and path, score null and are
allowed unless a rule fits; without URLs of either kind nothing is blocked but by rules.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle
from .exactdedup import lower_az

ALPHABET = "abcdefghijklmnopqrstuvwxyz0/.-*"  # and the boundary, code 31
N = 32

# Rules (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

# Terms of hosts that count as rejected when the models are learned.
SPAM_TERMS = ("casino", "bets", "poker", "pills", "viagra", "adult", "porn", "spam", "ads", "track", "cheap", "free-", "-win", "farm")


def parts(urls: DataFrame) -> DataFrame:
    """``urls`` with ``host`` and ``path``."""
    url, shape = F.coalesce(F.col("url"), F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.when(F.instr(url, "://") > 0, lower_az(F.regexp_extract(url, shape, 1))).otherwise("")
    path = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, shape, 2)).otherwise("")
    return urls.withColumns({"host": host, "path": path})


def ruled(rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, said in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is asked first
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def codes() -> Column:
    """Symbol numbers of host and path, after three boundaries."""
    line = F.regexp_replace(F.regexp_replace(lower_az(F.concat("host", "path")), "[0-9]", "0"), "[^a-z0/.-]", "*")
    symbols = F.transform(F.filter(F.split(line, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    return F.concat(F.array(*[F.lit(N - 1)] * 3), symbols)


def grams(code: Column) -> Column:
    """Number of each position's four symbols (three of context, one own)."""
    at = F.when(F.size(code) > 3, F.sequence(F.lit(3), F.size(code) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: ((F.get(code, i - 3) * N + F.get(code, i - 2)) * N + F.get(code, i - 1)) * N + F.get(code, i)).cast("array<long>")


def model(counts: DataFrame, needed: DataFrame, name: str) -> DataFrame:
    """(g, p): probability of the last symbol of every ``needed`` gram after its context.
    ``counts`` has (g, n), ``needed`` has (g): 32**4 rows at most, either."""
    prob = None
    for order in range(1, 5):
        size = N ** order
        own = counts.groupBy((F.col("g") % size).alias("g")).agg(F.sum("n").alias("n"))
        context = own.groupBy(F.floor(F.col("g") / N).cast("long").alias("c")).agg(F.sum("n").alias("cn"), F.count(F.lit(1)).alias("ck"))
        here = needed.select((F.col("g") % size).alias("g")).distinct().select("g", F.floor(F.col("g") / N).cast("long").alias("c"),
                                                                               (F.col("g") % (size // N)).alias("s"))
        shorter = here.withColumn("sp", F.lit(1.0 / N)) if prob is None else here.join(prob.select(F.col("g").alias("s"), F.col("p").alias("sp")), "s")
        prob = (shorter.join(own, "g", "left").join(context, "c", "left")
                .select("g", F.when(F.col("cn").isNull(), F.col("sp"))
                        .otherwise((F.coalesce("n", F.lit(0)) + F.col("ck") * F.col("sp")) / (F.col("cn") + F.col("ck"))).alias("p")))
    return prob.withColumnRenamed("p", name)


def log_ratios(rows: DataFrame) -> DataFrame:
    """(g, x): log P(accepted) - log P(rejected) of every gram that occurs in ``rows``."""
    seen = settle(rows.select("accepted", "held", F.explode(grams(F.col("code"))).alias("g"))
                  .groupBy("accepted", "held", "g").agg(F.count(F.lit(1)).alias("n")))
    learned, needed = seen.where("not held"), settle(seen.select("g").distinct())
    accepted, rejected = model(learned.where("accepted"), needed, "a"), model(learned.where("not accepted"), needed, "r")
    return accepted.join(rejected, "g").select("g", F.log(F.col("a") / F.col("r")).alias("x"))


def order_statistics(rows: DataFrame, ranks: dict[bool, list[int]], buckets: int = 4096) -> dict[tuple[bool, int], float]:
    """The value of each (kind, 0-based rank) of ``rows`` (kind boolean, x double without nulls).

    Values are counted by bucket of the range that holds a rank; the bucket with the rank is the next
    range, until its smallest and largest value are one.  Tasks and driver see ``buckets`` rows a range
    at most, however many values or repeats there are."""
    ends = {r["kind"]: (r["lo"], r["hi"]) for r in rows.groupBy("kind").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).collect()}  # two rows
    # (kind, rank): smallest and largest value of the range that holds it, and how many of its kind are below.
    at, found = {(k, r): (*ends[k], 0) for k, own in ranks.items() for r in own}, {}
    while True:
        found |= {key: lo for key, (lo, hi, _) in at.items() if lo == hi}
        at = {key: a for key, a in at.items() if key not in found}
        if not at:
            return found
        ranges, number = sorted({(k, *a) for (k, _), a in at.items()}), F.lit(None).cast("int")
        place = F.lit(None).cast("int")
        for i, (kind, lo, hi, _) in enumerate(ranges):
            own = (F.col("kind") == kind) & F.col("x").between(lo, hi)
            part = F.least(F.lit(buckets - 1), F.floor((F.col("x") / 2 - lo / 2) / (hi / 2 - lo / 2) * buckets).cast("int"))
            number, place = F.when(own, i).otherwise(number), F.when(own, part).otherwise(place)
        counted = (rows.select(number.alias("i"), place.alias("b"), "x").where("i is not null").groupBy("i", "b")
                   .agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect())
        by: dict[int, list] = {}
        for r in sorted(counted, key=lambda r: (r["i"], r["b"])):
            by.setdefault(r["i"], []).append(r)
        for (kind, rank), a in list(at.items()):
            below = a[2]
            for r in by[ranges.index((kind, *a))]:
                if rank < below + r["n"]:
                    at[kind, rank] = (r["lo"], r["hi"], below)
                    break
                below += r["n"]


def percentiles(rows: DataFrame, shares: dict[bool, float]) -> dict[bool, float]:
    """The exact percentile of ``x`` for each kind that has rows, between two values as F.percentile has it."""
    n = {r["kind"]: r["count"] for r in rows.groupBy("kind").count().collect()}  # two rows
    at = {k: (n[k] - 1) * share for k, share in shares.items() if k in n}
    ranks = {k: sorted({math.floor(p), math.ceil(p)}) for k, p in at.items()}
    value = order_statistics(rows, ranks) if ranks else {}
    out = {}
    for k, p in at.items():
        low, high = math.floor(p), math.ceil(p)
        a, b = value[k, low], value[k, high]
        out[k] = a if a == b else (high - p) * a + (p - low) * b
    return out


def judge(urls: DataFrame, accepted: Column | None = None, rejected: Column | None = None, rules=RULES, margin: float = 0.005) -> DataFrame:
    """``urls`` (page_id, url) with host, path, rule, verdict and score."""
    rule, said = ruled(rules)
    spam = F.col("host").rlike("|".join(SPAM_TERMS))
    rejected = spam if rejected is None else rejected
    accepted = (~spam & ~F.col("__said").eqNullSafe("block")) if accepted is None else accepted
    rows = parts(urls.select("page_id", "url")).withColumns({"rule": rule, "__said": said})
    rows = settle(rows.select(
        F.monotonically_increasing_id().alias("__row"), "page_id", "host", "path", "rule", "__said", codes().alias("code"),
        F.when(F.col("host") == "", None).when(rejected, False).when(accepted, True).alias("accepted"),
        F.substring(F.md5(F.coalesce(F.col("url"), F.lit(""))), 1, 1).isin("0", "1", "2", "3").alias("held")))  # row numbers are as written
    table = settle(log_ratios(rows))  # 32**4 rows of two numbers at most: safe to broadcast
    score = (rows.select("__row", F.explode(grams(F.col("code"))).alias("g")).join(F.broadcast(table), "g")
             .groupBy("__row").agg(F.avg("x").alias("score")))
    scored = settle(rows.drop("code").join(score, "__row", "left"))
    ends = percentiles(scored.where("held and accepted is not null and score is not null").select(F.col("accepted").alias("kind"), F.col("score").alias("x")),
                       {True: margin, False: 1 - margin})
    low, high = ends.get(True), ends.get(False)
    # Midway if the kinds are apart, else at most ``margin`` of the accepted fall below.
    cut = None if low is None or high is None else (low + high) / 2 if high < low else low
    by_model = F.when(F.col("score") < F.lit(cut).cast("double"), "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("__said", by_model).alias("verdict"), "score")
