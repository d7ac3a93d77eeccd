"""Registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, exactdedup, langid, licenses, packing, parsing, pii, prefixtrie, quality, simhash, toxicity, urls
from .common import table

VOCABULARIES = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file."""
    try:
        import public_tokenizers
        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join(VOCABULARIES, name)


def op1_mixture_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = langid.held_out(F.col("doc_id"))
    model = langid.train(docs.where(~held))
    found = langid.identify(docs, model)
    shown = F.transform("mixture", lambda m: F.format_string("%s:%.3f", m["lang"], m["share"]))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", F.array_join(shown, ",").alias("languages"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).withColumn("score", F.round("score", 6))


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.severity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_groups(table(spark, sf_dir, "documents")).drop("__h")


def op7_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.train(docs))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.find_licenses(table(spark, sf_dir, "documents"))
    return found.withColumn("expressions", F.array_join("expressions", "; "))


def op9_min_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op10_divergence_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_trie(table(spark, sf_dir, "conversations")).drop("tour_at")


def op12_parsed_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.fingerprint_edits(table(spark, sf_dir, "documents"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_mixture_language_id, op2_url_filter, op3_bpe_round_trip, op4_simhash_near_dedup, op5_ordinal_toxicity,
    op6_exact_dedup, op7_boosted_pii, op8_license_scan, op9_min_slack_packing, op10_divergence_quality, op11_conversation_trie,
    op12_parsed_fingerprints, op13_phrase_collocations)}

UPPER, LOWER = exactdedup.UPPER, exactdedup.UPPER.lower()


def url_oracle() -> str:
    """op2 in SQL: rules, counts of one to four symbols, Witten-Bell models, scores, cut."""
    def low(x):
        return f"translate({x}, '{UPPER}', '{LOWER}')"

    def rules(value):
        ordered = sorted(urls.RULES, key=lambda r: -len(r[0] + r[1]))
        return "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v if value else h + p}'"
                                  for h, p, v in ordered) + " END"
    models = []
    for o in range(1, 5):
        shorter = "1 / 32.0" if o == 1 else "b.p"
        before = "" if o == 1 else f"JOIN p{o - 1} b USING (gram, a)"
        models.append(f"""
p{o} AS (SELECT m.gram, m.a, CASE WHEN k.cn IS NULL THEN {shorter} ELSE (ifnull(n.n, 0) + k.ck * {shorter}) / (k.cn + k.ck) END AS p
  FROM m {before} LEFT JOIN n ON n.accepted = m.a AND n.o = {o} AND n.x = m.gram % {32 ** o}
  LEFT JOIN ctx k ON k.accepted = m.a AND k.o = {o} AND k.c = (m.gram % {32 ** o}) // 32)""")
    return rf"""
WITH u AS (SELECT row_number() OVER () AS r, page_id, ifnull(url, '') AS url FROM pages),
h AS (SELECT *, CASE WHEN contains(url, '://') THEN {low(r"regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")} ELSE '' END AS host,
  CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM u),
s AS (SELECT *, {rules(False)} AS rule, {rules(True)} AS said, regexp_matches(host, '{"|".join(urls.SPAM_TERMS)}') AS spam,
  substr(md5(url), 1, 1) IN ('0', '1', '2', '3') AS held,
  regexp_replace(regexp_replace({low("host || path")}, '[0-9]', '0', 'g'), '[^a-z0/.-]', '*', 'g') AS line FROM h),
c AS (SELECT *, CASE WHEN host = '' THEN NULL WHEN spam THEN FALSE WHEN said IS DISTINCT FROM 'block' THEN TRUE END AS accepted,
  [31, 31, 31] || list_transform(list_filter(string_split(line, ''), lambda x: x <> ''), lambda x: instr('{urls.ALPHABET}', x) - 1) AS code FROM s),
g AS (SELECT r, accepted, held, ((code[i - 3] * 32 + code[i - 2]) * 32 + code[i - 1]) * 32 + code[i] AS gram
  FROM (SELECT *, unnest(range(4, len(code) + 1)) AS i FROM c)),
n AS (SELECT accepted, o, gram % CAST(32 ** o AS BIGINT) AS x, count(*) AS n FROM g, (VALUES (1), (2), (3), (4)) v(o)
  WHERE NOT held AND accepted IS NOT NULL GROUP BY ALL),
ctx AS (SELECT accepted, o, x // 32 AS c, sum(n) AS cn, count(*) AS ck FROM n GROUP BY ALL),
m AS (SELECT DISTINCT gram, a FROM g, (VALUES (TRUE), (FALSE)) t(a)),{",".join(models)},
ratio AS (SELECT x.gram, ln(x.p / y.p) AS x FROM p4 x JOIN p4 y ON y.gram = x.gram AND x.a AND NOT y.a),
score AS (SELECT r, avg(ratio.x) AS score FROM g JOIN ratio USING (gram) GROUP BY r),
ends AS (SELECT quantile_cont(score, 0.005) FILTER (accepted) AS low, quantile_cont(score, 0.995) FILTER (NOT accepted) AS high
  FROM c JOIN score USING (r) WHERE held),
cut AS (SELECT CASE WHEN low IS NULL OR high IS NULL THEN NULL WHEN high < low THEN (low + high) / 2 ELSE low END AS cut FROM ends)
SELECT page_id, host, path, rule, CASE WHEN said IS NOT NULL THEN said WHEN score < cut THEN 'block' ELSE 'allow' END AS verdict,
  round(score, 6) AS score
FROM c LEFT JOIN score USING (r), cut"""


def quality_oracle() -> str:
    """op10 in SQL: counts, histograms, references and Jensen-Shannon distances."""
    def distance(a, b):
        p, q = f"(x[1] / list_sum({a}))", f"(x[2] / list_sum({b}))"
        part = " + ".join(f"CASE WHEN {v} > 0 THEN {v} * log2({v} / (({p} + {q}) / 2)) ELSE 0 END" for v in (p, q))
        return (f"CASE WHEN list_sum({a}) > 0 AND list_sum({b}) > 0 THEN "
                f"sqrt(greatest(0, list_sum(list_transform(list_zip({a}, {b}), lambda x: {part})) / 2)) END")
    lists = " ".join(f"WHEN '{k}' THEN {v.split()!r}" for k, v in quality.COMMON.items())

    def sums(name, n):
        return "[" + ", ".join(f"sum({name}[{i}])" for i in range(1, n + 1)) + "]"
    return rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, ifnull(text, '') AS t, CASE WHEN lang IN {tuple(quality.COMMON)} THEN lang ELSE '' END AS lang_ref
  FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
  CASE lang_ref {lists} END AS own,
  list_filter(string_split(lower(regexp_replace(t, '\P{{L}}+', ' ', 'g')), ' '), lambda x: x <> '') AS tokens FROM t),
win AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT r, count(DISTINCT i + k) AS covered FROM (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1), (VALUES (0), (1), (2)) v(k) GROUP BY r),
c AS (SELECT r, doc_id, lang_ref, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, length(t) AS n,
  length(regexp_replace(t, '\P{{L}}+', '', 'g')) AS l, length(regexp_replace(t, '\P{{Lu}}+', '', 'g')) AS u,
  length(regexp_replace(t, '\P{{Nd}}+', '', 'g')) AS d, length(regexp_replace(t, '[^.,;:!?''"()\-]+', '', 'g')) AS p,
  list_transform(own, lambda x: len(list_filter(tokens, lambda y: y = x))) AS hits, len(tokens) AS n_tokens FROM w),
k AS (SELECT c.*, ifnull(rep.covered, 0) AS n_repeat_words, n_words < 50 OR 100 * ifnull(rep.covered, 0) > 50 * n_words AS base_failed,
  [l - u, u, d, n - word_chars, p, n_symbols, greatest(0, n - l - d - (n - word_chars) - p - n_symbols)] AS chars,
  hits || [n_tokens - list_sum(hits)] AS common FROM c LEFT JOIN rep USING (r)),
refs AS (SELECT lang_ref, {sums("chars", 7)} AS rc, {sums("common", 17)} AS rw FROM k WHERE NOT base_failed AND lang_ref <> '' GROUP BY lang_ref
  UNION ALL SELECT '', {sums("chars", 7)}, {sums("common", 17)} FROM k WHERE NOT base_failed),
j AS (SELECT k.*, CASE WHEN list_sum(chars) >= {quality.LEAST_CHARS} THEN {distance("chars", "rc")} END AS cd,
  CASE WHEN n_words >= {quality.LEAST_WORDS} THEN {distance("common", "rw")} END AS wd FROM k LEFT JOIN refs USING (lang_ref))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND ifnull(cd, 0) <= {quality.CHAR_LIMIT} AND ifnull(wd, 0) <= {quality.WORD_LIMIT} AS kept,
  round(cd, 6) AS char_distance, round(wd, 6) AS word_distance FROM j"""


def trie_oracle() -> str:
    """op11 in SQL: crc32 bit by bit, rebuilt conversations, prefixes as lists of digests, sums over the nodes below."""
    return r"""
WITH RECURSIVE t AS (SELECT conv_id, n, d, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) - 1 AS i
  FROM (SELECT conv_id, turn, length(ifnull(text, '')) AS n, sha256(length(ifnull(role, '')) || ':' || ifnull(role, '') || ifnull(text, '')) AS d
        FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(
    [4294967295] || flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS own, i, n, d FROM c JOIN t ON t.conv_id = c.base AND t.i < c.h
  UNION ALL SELECT c.conv_id, 1, i, n, d FROM c JOIN t ON t.conv_id = c.conv_id AND t.i >= c.h),
k AS (SELECT conv_id, n, d, row_number() OVER (PARTITION BY conv_id ORDER BY own, i) AS depth FROM r),
p AS (SELECT conv_id, 0::BIGINT AS depth, '' AS key, 0::BIGINT AS n FROM c
  UNION ALL SELECT k.conv_id, k.depth, sha256(p.key || k.d), k.n FROM p JOIN k ON k.conv_id = p.conv_id AND k.depth = p.depth + 1),
e AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ended FROM p),
node AS (SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(n) AS saved,
  sha256(ifnull(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256 FROM e GROUP BY ALL),
up AS (SELECT x.depth, x.key, y.conv_id AS parent_conv_id FROM node x JOIN e ON e.conv_id = x.conv_id AND e.depth = x.depth - 1
  JOIN node y ON y.depth = e.depth AND y.key = e.key),
kids AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM up GROUP BY ALL),
below AS (SELECT e.depth, e.key, sum(x.saved) AS saved, count(*) FILTER (k.n_children IS NULL) AS leaves
  FROM node x LEFT JOIN kids k ON k.conv_id = x.conv_id AND k.depth = x.depth JOIN e ON e.conv_id = x.conv_id AND e.depth <= x.depth GROUP BY ALL)
SELECT n.conv_id, n.depth, parent_conv_id, n_convs, ifnull(n_children, 0) AS n_children, leaves AS n_leaves,
  CAST(b.saved AS BIGINT) AS saved_tokens, ends_sha256
FROM node n JOIN below b USING (depth, key) LEFT JOIN up USING (depth, key) LEFT JOIN kids ON kids.conv_id = n.conv_id AND kids.depth = n.depth"""


def collocation_oracle() -> str:
    """op13 in SQL: every phrase of up to four words, counted; cuts, scores and longer phrases."""
    return rf"""
WITH p AS (SELECT ifnull(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(ifnull(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
s AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
f AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS n FROM s, (VALUES (1), (2), (3), (4)) v(k)
  WHERE i + k - 1 <= len(ws) GROUP BY ALL),
c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND n >= 30),
inside AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN
  (SELECT lang, a, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, k)) AS i FROM c), (VALUES (2), (3)) v(m)
   WHERE m < k AND i + m - 1 <= k) x ON x.lang = c.lang AND x.phrase = c.phrase AND 100::HUGEINT * x.a >= 80::HUGEINT * c.a),
cut AS (SELECT *, array_to_string(ws[1:j], ' ') AS lp, array_to_string(ws[j + 1:k], ' ') AS rp
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c ANTI JOIN inside USING (lang, phrase))),
sc AS (SELECT cut.lang, cut.phrase, a, x.n AS l, y.n AS r, CAST(2000000::HUGEINT * a // (x.n + y.n) AS BIGINT) AS score, j
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = lp JOIN f y ON y.lang = cut.lang AND y.phrase = rp),
low AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM low JOIN (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang) USING (lang) QUALIFY rank <= 2000"""


ORACLES = {
    "op13_phrase_collocations": collocation_oracle(),
    "op11_conversation_trie": trie_oracle(),
    "op6_exact_dedup": """
        WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)""",
    "op2_url_filter": url_oracle(),
    "op10_divergence_quality": quality_oracle(),
}
