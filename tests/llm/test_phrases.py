"""Phrase collocations (op13) and parsed fingerprints (op12) against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from edusignal.llm import collocations, parsing

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            ws = re.findall("[^ \t]+", piece)
            n[lang] += len(ws)
            for k in range(1, 5):
                f[lang].update(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = {q for p, a in cand.items() for m in range(2, len(p)) for i in range(len(p) - m + 1)
                  for q in [p[i:i + m]] if 100 * a >= 80 * cand[q]}
        found = []
        for p, a in cand.items():
            if p not in inside:
                score, _, l, r = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("least, most, top", [(30, 2_000_000, 2000), (5, 300, 40)])
def test_collocations_equal_brute_force(spark, every, least, most, top):
    docs = every.limit(250) if least == 5 else every
    want = brute([(r["lang"], r["text"]) for r in docs.collect()], least, top)
    assert len(want) > 100
    assert got(collocations.collocations(docs, least, top, most)) == want


def test_collocations_edge(spark, edge, empty):
    want = brute([(r["lang"], r["text"]) for r in edge.collect()], 30)
    assert want and got(collocations.collocations(edge)) == want
    assert collocations.collocations(empty).count() == 0


def test_colliding_symbols_change_the_seed(spark, edge, monkeypatch):
    tried = []
    real = collocations.word_counts

    def counts(texts, seed):
        tried.append(seed)
        found = real(texts, seed)
        return found.withColumn("symbol", F.lit(1).cast("long")) if seed == 0 else found
    monkeypatch.setattr(collocations, "word_counts", counts)
    assert got(collocations.collocations(edge)) == brute([(r["lang"], r["text"]) for r in edge.collect()], 30)
    assert tried == [0, 1]


class Frame:
    """One partition of rows, in place of a DataFrame."""

    def __init__(self, rows):
        self.rows = rows

    def mapInPandas(self, run, schema):
        import pandas as pd
        return Rows(pd.concat(list(run(iter([self.rows]))), ignore_index=True))


class Rows:
    def __init__(self, got):
        self.got = got

    def distinct(self):
        return self.got


class Shared:
    def __init__(self, **value):
        self.value = value


@pytest.mark.parametrize("known, held", [(3, 50), (500_000, 4_000_000)])
def test_small_dictionaries_and_buffers(monkeypatch, known, held):
    """Tasks that must empty their tables again and again find the same."""
    import pandas as pd

    monkeypatch.setattr(collocations, "KNOWN", known)
    monkeypatch.setattr(collocations, "HELD", held)
    rows = pd.DataFrame({"lang": [b"en", b"de"] * 600, "text": [b"a b c, d e f", b"a b A B"] * 600})
    a, b, c = (collocations.symbol(b"en", w, 0) for w in (b"a", b"b", b"c"))
    everything = np.full(collocations.BITS // 8, 255, np.uint8)
    found = collocations.candidates(Frame(rows), Shared(bits=everything, cells=np.full(collocations.CELLS // 8, 255, np.uint8)), 0)
    assert {tuple(r) for r in found.to_numpy()} >= {(a, b, 0, 0), (b, c, 0, 0), (a, b, c, 0)} and len(found.drop_duplicates()) == 6 + 5
    none = collocations.candidates(Frame(rows), Shared(bits=everything, cells=np.zeros(collocations.CELLS // 8, np.uint8)), 0)
    assert len(none) == 0
    empty = np.zeros((0, 3), np.int64)
    trie = collocations.Trie([np.array([[a], [b]]), np.array([[a, b], [b, c]]), empty, np.zeros((0, 4), np.int64)],
                             [np.array([1, 2]), np.array([3, 4]), empty[:, 0], empty[:, 0]])
    (row,) = collocations.counted(Frame(rows), Shared(trie=trie, part=0), 0).got.itertuples()
    assert row.part == row.at == 0 and np.frombuffer(zlib.decompress(row.counts), "<i8").tolist() == [0, 600, 600, 600, 600]
    got = collocations.sketched(Frame(rows), Shared(bits=everything), 0).got
    cells = Counter()
    for row, at, k in zip(got["row"], got["at"], got["n"]):
        cells.update({row * collocations.ROW + x: y for x, y in zip(np.frombuffer(at, "<u2").tolist(), np.frombuffer(k, np.uint8).tolist())})
    one = int(collocations.cell_of(np.array([a]), np.array([b]), np.array([c]))[0])
    assert cells[one] >= 30  # a task's counts stop at 255 a batch


@pytest.mark.parametrize("known, width", [(3, 2), (500_000, 4)])
def test_passes_read_split_texts(monkeypatch, known, width):
    """The passes behind the words find the same in texts that were split before, and need no text (F1)."""
    import pandas as pd

    monkeypatch.setattr(collocations, "KNOWN", known)
    texts = [b"A b c, d e\xc3\x89 f", b"", b"a b a b. x"] * 400
    if width == 4:
        texts.append(" ".join(f"w{i}" for i in range(70_000)).encode())
    rows = pd.DataFrame({"lang": [b"en", b"de", b"de"] * 400 + [b"en"] * (width == 4), "text": texts})
    ones = {"bits": np.full(collocations.BITS // 8, 255, np.uint8), "cells": np.full(collocations.CELLS // 8, 255, np.uint8)}
    split = collocations.split_once(Frame(rows), Shared(**ones), 0).got
    a, b = ({tuple(r) for r in collocations.candidates(Frame(x), Shared(**ones), 0).to_numpy()} for x in (rows, split))
    assert a == b and len(a) >= 11 and set(split) == {"symbols", "places", "width"} and split["width"].max() == width
    pairs = np.array(sorted(r[:2] for r in a if not r[2]))
    words = np.unique(pairs)[:, None]
    empty = np.zeros((0, 3), np.int64)
    trie = collocations.Trie([words, pairs, empty, np.zeros((0, 4), np.int64)],
                             [np.arange(len(words)), np.arange(len(words), len(words) + len(pairs)), empty[:, 0], empty[:, 0]])
    of = []
    for x in (rows, split):
        n = collocations.counted(Frame(x), Shared(trie=trie, part=0), 0).got
        cells = Counter()
        got = collocations.sketched(Frame(x), Shared(bits=ones["bits"]), 0).got
        for row, at, k in zip(got["row"], got["at"], got["n"]):
            cells.update({row * collocations.ROW + i: y for i, y in zip(np.frombuffer(at, "<u2").tolist(), np.frombuffer(k, np.uint8).tolist())})
        # a buffer's counts stop at 255, and the texts' dictionary may be emptied more often
        of.append(({r.at: zlib.decompress(r.counts) for r in n.itertuples()}, {c: min(k, 255) for c, k in cells.items()}))
    assert of[0] == of[1]


def test_a_task_sends_a_candidate_once(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(collocations, "HELD", 400)
    rows = pd.DataFrame({"lang": [b"en"] * 3000, "text": [", ".join(f"a{i} b{i}" for i in range(60)).encode()] * 3000})
    ones = {"bits": np.full(collocations.BITS // 8, 255, np.uint8), "cells": np.full(collocations.CELLS // 8, 255, np.uint8)}
    found = collocations.candidates(Frame(rows), Shared(**ones), 0)
    assert len(found) == len(found.drop_duplicates()) == 60


def test_rare_phrases_of_frequent_ones_are_no_candidates():
    """All phrases of two and three words are frequent, that of four is not."""
    import pandas as pd

    texts = [b"a b c d"] * 10 + [b"a b c, b c d"] * 40
    rows = pd.DataFrame({"lang": [b"en"] * len(texts), "text": texts})
    shared = {"bits": np.full(collocations.BITS // 8, 255, np.uint8)}
    got, n = collocations.sketched(Frame(rows), Shared(**shared), 0).got, Counter()
    for row, at, k in zip(got["row"], got["at"], got["n"]):
        n.update({row * collocations.ROW + x: y for x, y in zip(np.frombuffer(at, "<u2").tolist(), np.frombuffer(k, np.uint8).tolist())})
    on = np.zeros(collocations.CELLS // 8, np.uint8)
    for cell in (c for c, k in n.items() if k >= 30):
        on[cell >> 3] |= 1 << (cell & 7)
    found = collocations.candidates(Frame(rows), Shared(cells=on, **shared), 0).to_numpy()
    assert len(found) == 5 and not found[:, 3].any()


def test_candidates_are_sent_by_a_task_a_slot(spark, edge, monkeypatch):
    tasks = []

    def spy(texts, shared, seed, real=collocations.candidates):
        tasks.append(texts.rdd.getNumPartitions())
        return real(texts, shared, seed)
    monkeypatch.setattr(collocations, "candidates", spy)
    slots = spark.sparkContext.defaultParallelism
    collocations.phrase_counts(edge.repartition(3 * slots))
    assert tasks == [slots]


def test_counts_of_tasks_are_summed_by_shard(spark):
    def packed(x):
        return zlib.compress(np.array(x, "<i8").tobytes())
    rows = [(0, 0, packed([1, 30, 0])), (0, 0, packed([2, 5, 0])), (0, 4096, packed([40])), (1, 0, packed([3, 29, 30]))]
    got = collocations.summed(spark.createDataFrame(rows, "part int, at long, counts binary").repartition(3), 2, 30).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 35), (0, 4096, 40), (1, 2, 30)]


def test_frequent_cells(spark, monkeypatch):
    rows = [(k, np.array([3, 9], "<u2").tobytes(), bytes([10, n])) for k in (0, 7) for n in (1, 25, 5)]
    df = spark.createDataFrame(rows, "row int, at binary, n binary").repartition(4)
    bits = collocations.frequent_cells(df, 3, 31)
    on = np.flatnonzero(np.unpackbits(bits, bitorder="little"))
    assert on.tolist() == [9, 7 * collocations.ROW + 9]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 40), min_size=4, max_size=4), min_size=1, max_size=60), st.integers(0, 3))
def test_trie_holds_its_phrases_only(rows, seed):
    rows = np.array(rows, np.int64)
    all_ = [np.unique(rows)[:, None], *[np.unique(rows[:, :k], axis=0) for k in (2, 3, 4)]]
    numbers = np.split(np.arange(sum(map(len, all_))), np.cumsum([len(x) for x in all_])[:-1])
    trie = collocations.Trie(list(all_), numbers)
    known = {tuple(r): n for x, ns in zip(all_, numbers) for r, n in zip(x, ns)}
    tried = np.random.default_rng(seed).integers(0, 42, (200, 4))
    for q in np.concatenate([tried, rows]):
        code = trie.codes(q)
        state = code[:1] * (trie.check[code[:1]] == 0)
        for k in range(1, 4):
            state = trie.advance(state, code[k:k + 1])
            assert (state[0] > 0) == (tuple(q[:k + 1]) in known)
            if state[0]:
                assert trie.place[state[0]] == known[tuple(q[:k + 1])]


# --- parsed fingerprints

def pairs(rows):
    """(text, next text) by falling doc_id, null last, then the digest."""
    def key(r):
        return (r[0] is None, -(r[0] or 0), hashlib.md5(r[1].encode()).digest())
    rows = sorted(rows, key=key)
    return [(i, t, rows[(k + 1) % len(rows)][1]) for k, (i, t) in enumerate(rows)]


def test_edits_of_every_document(every):
    docs = [(r["doc_id"], r["text"] or "") for r in every.collect()]
    want = []
    for i, t, nxt in pairs(docs):
        m = len(t) // 3
        e = t[:len(t) - m] + nxt[:m]
        a, b, c = parsing.fingerprints([t, e, nxt])
        want.append((str(i), len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, parsing.likeness(a, b), parsing.likeness(a, c)))
    rows = parsing.fingerprint_edits(every).collect()
    assert sorted((str(r[0]), *r[1:]) for r in rows) == sorted(want)
    long = [w for w in want if w[1] >= 300]
    assert np.mean([w[5] for w in long]) > 0.4 and np.median([w[6] for w in long]) < 0.05


def test_edits_edge(spark, edge, empty):
    assert parsing.fingerprint_edits(empty).count() == 0
    one = spark.createDataFrame([(3, "abc def", "en", "s", 7)], empty.schema)
    r = parsing.fingerprint_edits(one).collect()[0]
    assert r["edited_sha256"] == hashlib.sha256(b"abc dab").hexdigest() and r["near_next"] == 1
    copies = spark.createDataFrame([(3, "abc def " * 20, "en", "s", 7)] * 2500 + [(2, "zz", "en", "s", 2)], empty.schema)
    out = [tuple(r) for r in parsing.fingerprint_edits(copies).collect()]
    assert len(out) == 2501
    real = [r for r in out if r[0] == 3 and r[6] < 1]
    assert len(real) == 1  # the last copy is followed by the other document


def names(text):
    """All phrase names of levels 2 to 4."""
    symbols, first = np.frombuffer(text.encode(), np.uint8), np.zeros(1, np.intp)
    out = []
    for k in range(1, 5):
        symbols, first = parsing.level(symbols, first)
        if k > 1:
            out.append(set(symbols.tolist()))
    return out


@settings(max_examples=40, deadline=None)
@given(st.text("abcd é", min_size=600, max_size=900), st.text("abcd é", max_size=40), st.text("abcd é", max_size=40))
def test_equal_substrings_share_interior_names(text, before, after):
    for k, (own, moved) in enumerate(zip(names(text), names(before + text + after))):
        margin = (8, 10, 12)[k]  # phrases that may change at both ends
        assert len(own - moved) <= margin


def test_batches_do_not_matter():
    texts = ["", "a", "aa", "aaaaaaaa", "ab" * 50, "the cat sat on the mat " * 9, "x" * 5000, "Ünï çödé 漢字🙂" * 12, "\x00\x01" * 9]
    together = parsing.fingerprints(texts)
    assert together == [parsing.fingerprints([t])[0] for t in texts] == parsing.fingerprints(texts[::-1])[::-1]
    assert len(set(together)) == len(texts)
    assert parsing.likeness(together[0], together[0]) == 1 and parsing.likeness(together[0], together[5]) == 0


def test_runs_and_labels_bound_phrases():
    """Neighbours differ after runs are joined, so no phrase has more than a dozen symbols but at a text's begin."""
    rng = np.random.default_rng(5)
    symbols = rng.integers(0, 2**62, 20000).astype(np.uint64)
    out, _ = parsing.level(symbols, np.zeros(1, np.intp))
    assert 20000 / 6 < len(out) < 20000 / 2


def test_likeness_estimates_the_share_of_phrases():
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(4000)]
    text = " ".join(words)
    for share in (0.25, 0.5, 0.75):
        cut = int(len(words) * share)
        other = " ".join(words[:cut] + [w[::-1] + "q" for w in words[cut:]])
        true = np.mean([len(a & b) / len(a | b) for a, b in zip(names(text), names(other))])
        a, b = parsing.fingerprints([text, other])
        assert abs(parsing.likeness(a, b) - true) < 0.2
