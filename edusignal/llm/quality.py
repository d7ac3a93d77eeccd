"""Quality rules by distribution divergence (DataFrame functions only).

Each text gets a histogram over character classes and one over the common words of its
language.  Summed over all documents that pass the base rule, these are the language's
references.  A document fails when the Jensen-Shannon distance (base 2, 0 to 1) of a histogram to its
language's reference is above a limit; texts below a minimum length are not judged by it, as short
histograms are far from any reference by chance.

Histograms are arrays of fixed length in the document's own row, built with higher-order
functions, so whole texts are never shuffled; only the sums of a handful of references are.

Defined cases: null text counts as empty (no words, base rule fails); other or null languages are
compared with the reference of all languages' characters, and not by words; repeated rows are
judged alike; equal windows are recognised by a 64-bit hash of their three words (a chance of
1e-11 for a text of 20,000 words).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

# The most frequent function words of each language.
COMMON = {
    "en": "the of and to a in is that it for was on with as be by",
    "de": "der die und in den von zu das mit sich des auf für ist im nicht",
    "fr": "de la le et les des en un du une que est pour qui dans par",
    "es": "de la que el en y los se las del un por con no una su",
}
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Limits on the distances, and the characters and words from which they hold.
CHAR_LIMIT, WORD_LIMIT, LEAST_CHARS, LEAST_WORDS = 0.30, 0.27, 200, 100


def let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.transform(F.array(value), use)[0]


def upto(n: Column) -> Column:
    """0 to n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more; each word counts once."""
    def among(w):
        windows = F.transform(upto(F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))

    def covered(h):
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s):
            twice = F.filter(upto(F.size(s)), lambda k: (F.get(s, k)["h"] == F.get(s, k - 1)["h"]).eqNullSafe(True)
                             | (F.get(s, k)["h"] == F.get(s, k + 1)["h"]).eqNullSafe(True))
            return F.sort_array(F.transform(twice, lambda k: F.get(s, k)["i"]))
        return let(let(pairs, starts), lambda t: total(F.transform(
            t, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(t, k + 1) - x, F.lit(3))))))
    return let(words, among)


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def kept_chars(text: Column, drop: str) -> Column:
    return F.length(F.regexp_replace(text, drop, "")).cast("long")


def rule_counts(docs: DataFrame) -> DataFrame:
    """One row a document: the rules' counts, ``chars`` and ``common`` (the histograms) and ``lang_ref``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    known = F.col("lang").isin(*COMMON)
    rows = docs.select("doc_id", text.alias("__t"), F.when(known, F.col("lang")).otherwise("").alias("lang_ref"))
    words = F.filter(F.split("__t", SPACE), lambda w: w != "")
    counted = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                                            repeated_words(w).alias("n_repeat_words")))
    size, letters, capitals = F.length("__t").cast("long"), kept_chars(F.col("__t"), r"\P{L}+"), kept_chars(F.col("__t"), r"\P{Lu}+")
    digits, marks = kept_chars(F.col("__t"), r"\P{Nd}+"), kept_chars(F.col("__t"), r"[^.,;:!?'\"()\-]+")
    lists = F.create_map(*[x for k, v in COMMON.items() for x in (F.lit(k), F.array(*map(F.lit, v.split())))])
    own = F.element_at(lists, F.col("lang_ref"))

    def histogram(tokens):
        at = F.filter(F.transform(F.filter(tokens, lambda x: F.length(x) <= 6), lambda x: F.array_position(own, x)), lambda i: i > 0)
        return let(at, lambda i: F.concat(F.transform(F.sequence(F.lit(1), F.lit(16)), lambda k: F.size(F.filter(i, lambda x: x == k)).cast("long")),
                                          F.array((F.size(tokens) - F.size(i)).cast("long"))))
    tokens = F.filter(F.split(F.lower(F.regexp_replace("__t", r"\P{L}+", " ")), " "), lambda x: x != "")
    common = F.when(F.col("lang_ref") != "", let(tokens, histogram))
    spaces = size - F.col("__c.word_chars")
    return (rows.withColumn("__c", counted)
            .select("doc_id", "lang_ref", "__c.n_words", "__c.word_chars", F.regexp_count("__t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
                    duplicate_lines(F.col("__t")).alias("n_dup_lines"), "__c.n_repeat_words", common.alias("common"),
                    size.alias("__n"), letters.alias("__l"), capitals.alias("__u"), digits.alias("__d"), marks.alias("__p"), spaces.alias("__s"))
            .select("doc_id", "lang_ref", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "common",
                    F.array(F.expr("__l - __u"), F.col("__u"), F.col("__d"), F.col("__s"), F.col("__p"), F.col("n_symbols"),
                            F.greatest(F.lit(0).cast("long"), F.expr("__n - __l - __d - __s - __p - n_symbols"))).alias("chars"))
            .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))))


def references(counts: DataFrame) -> DataFrame:
    """(lang_ref, ref_chars, ref_common): sums over the documents that pass the base rule, a row
    for each language of ``COMMON`` that occurs and one, '', for all: five rows at most."""
    bins = [F.sum(F.get("chars", i)).alias(f"c{i}") for i in range(7)] + [F.sum(F.get("common", i)).alias(f"w{i}") for i in range(17)]
    by = counts.where("not base_failed").groupBy("lang_ref").agg(*bins)
    every = by.groupBy(F.lit("").alias("lang_ref")).agg(*[F.sum(b).alias(b) for b in by.columns[1:]])
    return (by.where("lang_ref != ''").unionAll(every)
            .select("lang_ref", F.array(*[f"c{i}" for i in range(7)]).alias("ref_chars"), F.array(*[f"w{i}" for i in range(17)]).alias("ref_common")))


def distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance of two histograms; null if one is empty or null."""
    def part(x, m):
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    def of(p, q):
        sums = F.zip_with(p, q, lambda x, y: let((x + y) / 2, lambda m: part(x, m) + part(y, m)) / 2)
        return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(sums, F.lit(0.0), lambda s, x: s + x)))

    def shares(h):
        return let(total(h), lambda n: F.transform(h, lambda x: x / n))
    return F.when((total(a) > 0) & (total(b) > 0), let(shares(a), lambda p: let(shares(b), lambda q: of(p, q))))


def judge(docs: DataFrame) -> DataFrame:
    """One row a document: the rules' counts, base_failed, kept, and both distances."""
    counts = settle(rule_counts(docs))
    refs = references(counts)  # five rows at most: safe to broadcast
    size = total(F.col("chars"))
    return (counts.join(F.broadcast(refs), "lang_ref", "left")
            .withColumn("char_distance", F.when(size >= LEAST_CHARS, distance(F.col("chars"), F.col("ref_chars"))))
            .withColumn("word_distance", F.when(F.col("n_words") >= LEAST_WORDS, distance(F.col("common"), F.col("ref_common"))))
            .withColumn("kept", ~F.col("base_failed") & (F.coalesce("char_distance", F.lit(0.0)) <= CHAR_LIMIT)
                        & (F.coalesce("word_distance", F.lit(0.0)) <= WORD_LIMIT))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance"))
