"""Operators with an exact answer, against brute force (op3, op4, op6, op9)."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from edusignal.llm import bpe, exactdedup, packing, simhash

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(row):
    return tuple((x is None, x) for x in row)


def source(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]


def test_exact_groups(every):
    docs = source(every)
    groups = defaultdict(list)
    for i, t in docs:
        groups[t.translate(LOWER)].append(i)
    want = []
    for i, t in docs:
        n = t.translate(LOWER)
        ids = [x for x in groups[n] if x is not None]
        want.append((i, max(ids) if ids else None, len(groups[n]), hashlib.sha256(n.encode()).hexdigest()))
    got = exactdedup.exact_groups(every).collect()
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got], key=key) == sorted(want, key=key)
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and set(kept) == {w[3] for w in want}
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_drop_exact_copies(every, edge, empty):
    out = exactdedup.drop_exact_copies(edge)
    assert out.columns == edge.columns
    rows = [(r["doc_id"], (r["text"] or "").translate(LOWER)) for r in out.collect()]
    assert sorted(t for _, t in rows) == sorted({t.translate(LOWER) for _, t in source(edge)})
    assert (14, "hello") in rows and (2, "") in rows
    smallest = {t: i for i, t in ((r["doc_id"], (r["text"] or "").translate(LOWER)) for r in exactdedup.drop_exact_copies(edge, keep="min").collect())}
    assert smallest["hello"] == 4 and smallest[""] == 1
    assert exactdedup.exact_groups(empty).count() == 0 and exactdedup.drop_exact_copies(empty).count() == 0


def brute_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.translate(LOWER).encode())
    if not words:
        return 0
    sh = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints, distance=4):
    vals = sorted(set(prints))
    root = {v: v for v in vals}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v
    for i, a in enumerate(vals):
        for b in vals[i + 1:]:
            if (a ^ b).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {v: find(v) for v in vals}


def test_near_groups(every):
    docs = source(every)
    prints = [brute_print(t) for _, t in docs]
    root = brute_components(prints)
    best = {}
    for (i, _), p in zip(docs, prints):
        if i is not None:
            best[root[p]] = min(best.get(root[p], i), i)
    want = sorted([(i, p, best.get(root[p])) for (i, _), p in zip(docs, prints)], key=key)
    got = simhash.near_groups(every).collect()
    assert sorted([(r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in got], key=key) == want
    assert len(set(best.values())) < len(set(prints))


def test_links_and_components_of_a_dense_ball(spark):
    rng = np.random.default_rng(5)
    vals = set()
    for centre in rng.integers(0, 2**63, 4).tolist():
        for _ in range(60):
            vals.add(centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)))
    chain = 12345
    for k in range(40):  # a long chain, four bits a step
        chain ^= 0xF << (k % 15 * 4)
        vals.add(chain)
    signed = [(v - 2**64 if v >= 2**63 else v,) for v in sorted(vals)]
    df = spark.createDataFrame(signed, "fp long")
    got = {r["node"] % 2**64: r["root"] % 2**64 for r in simhash.components(simhash.links(df, 4)).collect()}
    want = brute_components(vals)
    size = Counter(want.values())
    classes = lambda m: sorted(sorted(g) for g in _classes(m).values())
    assert classes(got) == classes({v: r for v, r in want.items() if size[r] > 1})


def test_links_over_many_buckets(spark):
    """More variants than a bucket holds: links are found in every bucket, not in the first alone (F1)."""
    rng = np.random.default_rng(7)
    wanted = set()
    for v in rng.integers(0, 2**63, 3000).tolist():
        other = v ^ sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        wanted.add((min(v, other), max(v, other)))
    vals = sorted({v for pair in wanted for v in pair})
    assert len(vals) * len(simhash.masks(2)) > 2 * simhash.BUCKET
    df = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in vals], "fp long")
    got = [sorted((r["a"] % 2**64, r["b"] % 2**64)) for r in simhash.links(df, 4).collect()]
    assert sorted(map(tuple, got)) == sorted(wanted)


def _classes(m):
    out = defaultdict(list)
    for v, r in m.items():
        out[r].append(v)
    return out


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, 2**30 - 1), min_size=1, max_size=500))
def test_elias_fano_round_trip(values):
    v = np.array(sorted(values), dtype=np.uint64)
    assert (simhash.unpack(simhash.pack(v, 30)) == v).all()


def test_drop_near_copies(edge, empty):
    out = simhash.drop_near_copies(edge)
    assert out.columns == edge.columns
    assert simhash.near_groups(empty).count() == 0 and simhash.drop_near_copies(empty).count() == 0
    ids = [r["doc_id"] for r in out.collect()]
    assert 1 in ids and 2 not in ids and ids.count(4) == 1 and 5 not in ids and None not in ids


def test_bpe_equals_the_library(every):
    tok = Tokenizer.from_file(BYTE)
    docs = source(every)
    want = []
    for i, t in docs:
        ids = tok.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = [tuple(r) for r in bpe.round_trip(every, BYTE).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_bpe_any_text(texts):
    tok, own = _tokenizer(), _own()
    for t, ids in zip(texts, own.encode_batch(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids
        assert own.decode(ids) == t


_made = {}


def _tokenizer():
    return _made.setdefault("t", Tokenizer.from_file(BYTE))


def _own():
    return _made.setdefault("o", bpe.Bpe(BYTE))


def test_bpe_encode_then_decode(edge, empty):
    back = bpe.decode(bpe.encode(edge, BYTE), BYTE).collect()
    assert sorted([(r["doc_id"], r["text"]) for r in back], key=key) == sorted(source(edge), key=key)
    assert bpe.round_trip(empty, BYTE).count() == 0 and bpe.encode(empty, BYTE).count() == 0


def test_packing(every, empty):
    tok = Tokenizer.from_file(WORD)
    want = Counter()
    for i, t in source(every):
        ids = np.array(tok.encode(t, add_special_tokens=False).ids + [1], "<u4")
        for k in range(0, len(ids), 4096):
            part = ids[k:k + 4096]
            want[(i, k // 4096, k, len(part), zlib.crc32(part.tobytes()))] += 1
    got = packing.pack(every, WORD).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-sum(r["length"] for r in got) // 4096) + 1
    assert packing.pack(empty, WORD).count() == 0


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(max_codepoint=255), st.sampled_from("aB.,'<|>!\n \u0301\u1e9eΣ"),
                                           st.characters(exclude_categories=["Cs"]))), max_size=6))
def test_word_encoder_any_text(texts):
    tok = _made.setdefault("w", Tokenizer.from_file(WORD))
    texts = [*texts, "end<|endoftext|>of <|ENDOFTEXT|>", "It's, don't... O'NEIL'S.x!?a"]
    for t in texts:
        assert np.frombuffer(packing.word_ids(WORD).encode(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_word_encoder_forgets(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    own, tok = packing.WordIds(WORD), Tokenizer.from_file(WORD)
    texts = [f"word{i} again word{i % 3} x" for i in range(40)]
    assert [np.frombuffer(own.encode(t), "<u4").tolist() for t in texts] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(own) <= 5 and len(own.older) <= 5


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=200))
def test_plan_places_everything_once(lengths):
    hist = Counter(lengths)
    steps = packing.plan(hist, 50)
    ranks, bins = defaultdict(int), defaultdict(int)
    for size, first, copies, bin_, at, times in sorted(steps):
        assert first == ranks[size]
        ranks[size] += copies * times
        for b in range(bin_, bin_ + times):
            bins[b] += copies * size
    assert dict(ranks) == dict(hist) and max(bins.values()) <= 50


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=9), st.integers(0, 60))
def test_fullest_is_optimal(lengths, room):
    left = Counter(lengths)
    sums = {0}
    for x in lengths:
        sums |= {s + x for s in sums}
    best = max(s for s in sums if s <= room)
    found = packing.fullest(room, left, sorted(left, reverse=True))
    assert sum(a * b for a, b in found) == best and all(b <= left[a] for a, b in found)


def test_odd_distances_are_refused(edge):
    import pytest
    with pytest.raises(ValueError, match="even"):
        simhash.near_groups(edge, distance=3)
