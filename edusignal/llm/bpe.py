"""Byte-level BPE, encoded in batched numpy merge rounds and decoded again.

The new words of a batch lie in one flat symbol array.  Every adjacent pair's rank is found
by binary search over the sorted pair keys.  A round takes each unfinished word's
lowest rank, merges all places of that pair in the word, left to right, and looks up the pairs that
now hold a merged symbol.  Words without a known pair are finished and leave the array.  Word ids are remembered (a
bounded number), so frequent words are merged once a worker.

Defined cases: a null text counts as empty (no ids, empty decoded text); the special token's
string in a text is that token, as the public library does by default; rows are encoded one by
one, so repeats, ties and null doc_ids need no rule; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, id_text

# Fixed value: how byte-level BPE cuts a text before merging.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The letters, numbers and white space among the first 256 code points; texts within
# them are cut by the standard library's faster expressions.
LETTERS, NUMBERS, SPACES = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+"
                   rf"|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
#: Words whose ids a worker remembers as recent (as many again as older), and characters of text merged together.
REMEMBERED, FLAT = 200_000, 4_000_000
DONE = np.iinfo(np.int64).max


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: itself if visible, else the next code point from 256."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A vocabulary file's tables, its encoder and decoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, vocab = byte_alphabet(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(alphabet[c] for c in s) for s, i in vocab.items() if all(c in alphabet for c in s)}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.single = np.array([vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])], dtype=np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.words = regex.compile(WORDS)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def ranks(self, symbols: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank of the pair that begins at each position ``at``; ``DONE`` if there is none."""
        nxt = np.minimum(at + 1, len(symbols) - 1)
        key = symbols[at] << 32 | symbols[nxt]
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[found] == key) & (owner[nxt] == owner[at]) & (nxt > at), self.rank[found], DONE)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian uint32."""
        out: list[bytes] = [b""] * len(words)
        symbols = self.single[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        rank = self.ranks(symbols, owner, np.arange(len(symbols)))
        while len(symbols):
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            sizes = np.diff(np.append(starts, len(symbols)))
            lowest = np.minimum.reduceat(rank, starts)
            low = np.repeat(lowest, sizes)
            # In a run of overlapping places (aaa) every second one merges, from the left.
            run = np.flatnonzero((rank == low) & (low != DONE))
            first = np.concatenate(([True], np.diff(run) != 1)) if len(run) else np.zeros(0, bool)
            since = np.arange(len(run)) - np.maximum.accumulate(np.where(first, np.arange(len(run)), 0))
            run = run[since % 2 == 0]
            symbols[run] = self.made[rank[run]]
            keep = low != DONE
            keep[run + 1] = False
            done = np.flatnonzero(lowest == DONE)
            if len(done):
                raw = symbols.astype("<u4").tobytes()
                for word, s, n in zip(owner[starts[done]].tolist(), starts[done].tolist(), sizes[done].tolist()):
                    out[word] = raw[4 * s:4 * (s + n)]
            # Only pairs with a merged symbol have a new rank.
            merged = (np.cumsum(keep) - 1)[run]
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            if len(merged):
                new = np.concatenate((merged, merged[merged > 0] - 1))
                rank[new] = self.ranks(symbols, owner, new)
        return out

    def learn(self, words: set[str]) -> None:
        """Afterwards ``recent`` has all of ``words``; words not met for long are forgotten."""
        new = words.difference(self.recent)
        if len(self.recent) + len(new) > REMEMBERED:
            self.older, self.recent, new = self.recent, {}, words
        known = new.intersection(self.older)
        self.recent.update((w, self.older[w]) for w in known)
        self.recent.update((w, i.to_bytes(4, "little")) for w, i in self.special.items())  # no other word has its text
        rest = list(new.difference(self.recent))
        self.recent.update(zip(rest, self.merge([w.encode("utf-8", "surrogatepass") for w in rest])))

    def split(self, text: str) -> list[str]:
        """The words and special tokens of a text."""
        if self.cut and any(t in text for t in self.special):
            parts = self.cut.split(text)
            return [w for k, part in enumerate(parts) for w in ([part] if k % 2 else self.words.findall(part))]
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.words.findall(text)
        return LATIN.findall(text)

    def encode_batch(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text, as little-endian uint32; the new words of some MB of text are merged together."""
        group, size = [], 0
        for i, text in enumerate(texts):
            group.append(self.split(text))
            size += len(text)
            if size >= FLAT or i + 1 == len(texts):
                self.learn(set().union(*group))
                for words in group:
                    yield b"".join(map(self.recent.__getitem__, words))
                group, size = [], 0

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.decode("utf-8", "replace")


def tables(path: str) -> Bpe:
    """The worker's tables: what they remember serves its later tasks."""
    return held(f"merges of {path}", lambda: Bpe(path))


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids: array<int>) of every document."""
    def run(batches):
        bpe = tables(vocabulary)
        for texts in batches:
            yield pd.Series([np.frombuffer(x, "<u4").astype(np.int32) for x in bpe.encode_batch(list(texts))])
    return id_text(docs).select("doc_id", _iter_udf(run, "array<int>")("text").alias("ids"))


def decode(rows: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    def run(batches):
        bpe = tables(vocabulary)
        for ids in batches:
            yield pd.Series([bpe.decode(np.asarray(x, dtype="<u4").tobytes()) for x in ids])
    return rows.select("doc_id", _iter_udf(run, "string")("ids").alias("text"))


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoded, decoded and digested in one pass."""
    def run(batches):
        bpe = tables(vocabulary)
        for texts in batches:
            out = [(len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(bpe.decode(x).encode()).hexdigest())
                   for x in bpe.encode_batch(list(texts))]
            yield pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
    udf = _iter_udf(run, "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return id_text(docs).select("doc_id", udf("text").alias("r")).select("doc_id", "r.*")


def _iter_udf(run, kind: str):
    """An iterator pandas UDF: what ``run`` loads is loaded once a task."""
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from run(batches)

    def frames(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from run(batches)
    return F.pandas_udf(frames if " " in kind else each, kind)
