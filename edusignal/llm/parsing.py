"""Document fingerprints by locally consistent parsing.

A text's UTF-8 bytes are parsed into phrases, these into longer phrases, and so on.  On every level runs of an equal symbol
become one symbol, so neighbours differ; deterministic coin tossing (the lowest bit in which a symbol differs from its
left neighbour, and that bit, repeated on the labels) gives labels from 0 to 5; a phrase begins at each local maximum of
the labels, and its name is a hash of its symbols.  A name depends on a few symbols to either side only, so equal substrings share
the names of their interior whatever their offset.  The fingerprint holds the ``KEEP`` smallest 32-bit name hashes of each
of ``LEVELS``, in hexadecimal, one section a level; the likeness of two is the mean over levels of the share of their
joint smallest hashes that both have.  Levels on which neither text has ``LEAST`` phrases are left out, but for the first.

A batch's texts lie in one flat array.  Memory is about 60 bytes a byte of ``FLAT``, or of one text if that is longer.

Defined cases: a null text counts as empty; an empty text has empty sections, is like another empty one (1) and unlike all others (0);
documents follow each other by falling doc_id, null last, equal ones by a digest of the text; of rows that repeat both, all but the
last are followed by their own copy; the last document is followed by the first, an only one by itself; an
empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import with_position
from .common import id_text, settle

#: Levels of the fingerprint, hashes a level, phrases that a level needs to count.
LEVELS, KEEP, LEAST = (2, 3, 4), 24, 4
#: Bytes of text parsed together; bytes of text a partition.
FLAT, PART = 2_000_000, 128 << 20


def tossed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Coin tossing: twice the lowest bit in which ``b`` differs from its left neighbour ``a``, plus that bit of ``b``."""
    x = a ^ b
    low = x & (~x + x.dtype.type(1))
    return (2 * np.bitwise_count(low - x.dtype.type(1)) + ((b & low) != 0)).astype(np.uint8)


def toss_table(n: int) -> np.ndarray:
    a = np.arange(n, dtype=np.uint64)
    return np.where(a[:, None] == a, 0, tossed(a[:, None], a[None, :])).astype(np.uint8).ravel()


BYTES, WIDE, MIDDLE, SMALL = toss_table(256), toss_table(128), toss_table(16), toss_table(8)
ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_NAMES = mixed(np.arange(256, dtype=np.uint64) + ODD)


def relabelled(labels: np.ndarray, table: np.ndarray, bits: int, first: np.ndarray) -> np.ndarray:
    """One round of tossing on labels below ``2**bits``; the ``first`` of each text show nothing of the text before."""
    out = np.zeros_like(labels)
    np.take(table, labels[:-1].astype(np.uint16 if bits > 4 else np.uint8) << bits | labels[1:], out=out[1:], mode="clip")
    out[first] = 0
    return out


def level(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of ``symbols`` (bytes, or names of the level below); ``first``: places where texts begin."""
    new = np.ones(len(symbols), bool)
    np.not_equal(symbols[1:], symbols[:-1], out=new[1:])
    new[first] = True
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(symbols)))
    symbols, first = symbols[at], np.searchsorted(at, first)
    if symbols.dtype == np.uint8:
        names, labels = BYTE_NAMES[symbols], relabelled(symbols, BYTES, 8, first)
    else:
        names, labels = mixed(symbols), np.zeros(len(symbols), np.uint8)
        labels[1:] = tossed(symbols[:-1], symbols[1:])
        labels[first] = 0
        labels = relabelled(labels, WIDE, 7, first)
    long = np.flatnonzero(runs > 1)
    names[long] = mixed(names[long] + runs[long].astype(np.uint64) * ODD)
    for table, bits in ((MIDDLE, 4), (SMALL, 3), (SMALL, 3)):
        labels = relabelled(labels, table, bits, first)
    starts = np.zeros(len(symbols), bool)
    up = labels[1:] > labels[:-1]  # a text's first symbol has label 0, the lowest
    starts[1:-1] = up[:-1] & ~up[1:] & (labels[1:-1] != labels[2:])
    starts[first[1:] - 1] = False  # nor does anything of the text after
    starts[first] = True
    begin = np.flatnonzero(starts)
    sizes = np.diff(np.append(begin, len(symbols)))
    place = np.arange(len(symbols)) - np.repeat(begin, sizes)
    names *= np.cumprod(np.full(int(sizes.max()), ODD))[place]
    return mixed(np.add.reduceat(names, begin) + sizes.astype(np.uint64)), np.searchsorted(begin, first)


def smallest(names: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """The ``KEEP`` smallest name hashes of each text (``sizes``: its phrases), as big-endian uint32."""
    owner = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
    key = np.sort(owner << np.uint64(32) | mixed(names + ODD) >> np.uint64(32))
    key = key[np.diff(key, prepend=~key[:1]) != 0]
    begin = np.searchsorted(key, np.arange(len(sizes) + 1, dtype=np.uint64) << np.uint64(32))
    raw = key.astype(np.uint32).astype(">u4").tobytes()
    return [raw[4 * a:4 * min(a + KEEP, b)] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]


def parsed(texts: list[bytes]) -> list[str]:
    """The fingerprint of each text."""
    out = [".".join([""] * len(LEVELS))] * len(texts)
    there = [i for i, t in enumerate(texts) if t]
    if not there:
        return out
    symbols = np.frombuffer(b"".join(texts), np.uint8)
    first = np.cumsum([0] + [len(texts[i]) for i in there[:-1]])
    sections = []
    for k in range(1, max(LEVELS) + 1):
        symbols, first = level(symbols, first)
        if k in LEVELS:
            sections.append(smallest(symbols, np.diff(np.append(first, len(symbols)))))
    for i, of in zip(there, zip(*sections)):
        out[i] = ".".join(s.hex() for s in of)
    return out


def fingerprints(texts: list[str]) -> list[str]:
    out: list[str] = []
    group, size = [], 0
    for i, text in enumerate(texts):
        group.append(text.encode("utf-8", "surrogatepass"))
        size += len(group[-1])
        if size >= FLAT or i + 1 == len(texts):
            out += parsed(group)
            group, size = [], 0
    return out


def likeness(one: str, other: str) -> float:
    """0 to 1, from two fingerprints."""
    if one == other:
        return 1.0
    shares = []
    for k, (a, b) in enumerate(zip(one.split("."), other.split("."))):
        x, y = ({s[i:i + 8] for i in range(0, len(s), 8)} for s in (a, b))
        if k and max(len(x), len(y)) < LEAST:
            continue
        both = sorted(x | y)[:KEEP]  # hexadecimal of one width sorts as its numbers
        shares.append(sum(v in x and v in y for v in both) / len(both) if both else 1.0)
    return sum(shares) / len(shares)


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
ROUTED = "slab int, kind int, none boolean, id long, h binary, packed binary, copies long"
#: What a routed row is: a document; the next slab's first one, as the next of this slab's last; copies followed by a copy.
DOCUMENT, NEXT, COPIES = 0, 1, 2


def compared(items: list[tuple]) -> pd.DataFrame:
    """A row for each (id, none, text, next text, times), ``times`` times; items in order share their neighbours' fingerprints."""
    own, nexts, edited = [], [], []
    for _, _, text, after, _ in items:
        cut = len(text) // 3
        edited.append(text[:len(text) - cut] + after[:cut])
        own.append(text)
    for k, (_, _, text, after, _) in enumerate(items):
        follows = k + 1 < len(items) and items[k + 1][2] is after
        nexts.append(k + 1 if follows else k if after is text else len(own))
        if nexts[-1] == len(own):
            own.append(after)
    prints, changed = fingerprints(own), fingerprints(edited)
    made = [(None if none else i, len(text), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), a, b, likeness(a, b), likeness(a, prints[k]))
            for (i, none, text, _, _), e, a, b, k in zip(items, edited, prints, changed, nexts)]
    out = pd.DataFrame([row for row, item in zip(made, items) for _ in range(item[4])], columns=EDITED.replace(",", "").split()[::2])
    return out.astype({"doc_id": "Int64"})


def followed(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """Items of a partition's routed rows, which come in order: slab, kind, key."""
    last = None
    for rows in batches:
        for slab, kind, none, i, h, packed, copies in zip(*(rows[c] for c in ("slab", "kind", "none", "id", "h", "packed", "copies"))):
            key = (slab, none, i, h)
            if kind == DOCUMENT and last and last[0] == key:  # a copy from another batch
                last[2] += copies
                continue
            text = zlib.decompress(packed).decode("utf-8", "surrogatepass")
            if last:
                (_, none_, i_, _), before, times = last
                yield i_, none_, before, text, 1
                if times > 1:
                    yield i_, none_, before, before, times - 1
            if kind == COPIES:
                yield i, none, text, text, copies
            last = [key, text, copies] if kind == DOCUMENT else None


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document.

    Ids and digests alone are sorted first; every so many of them a slab begins, and the driver sees the first key of each slab.
    Then each text travels once, compressed, to its slab, and a slab's first one to the slab before as well."""
    spark = docs.sparkSession
    doc_id = F.col("doc_id").cast("long")
    rows = id_text(docs).select(doc_id.isNull().alias("none"), F.coalesce(doc_id, F.lit(0)).alias("id"), F.unhex(F.md5("text")).alias("h"), "text")
    order = [F.col("none"), F.col("id").desc(), F.col("h")]
    light = rows.groupBy("none", "id", "h").agg(F.sum(F.octet_length("text")).alias("size"))
    keys = settle(with_position(light.orderBy(*order), "pos"))
    total, size = keys.agg(F.count(F.lit(1)), F.sum("size")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (size or 0) // PART)
    apart = -(-total // (4 * parts)) or 1
    first = [(r["none"], -r["id"], bytes(r["h"])) for r in keys.where((F.col("pos") - 1) % apart == 0).orderBy("pos").collect()]  # a row a slab

    def route(batches):
        starts = {key: k for k, key in enumerate(first)}
        for at, got in enumerate(batches):
            found = {}
            for none, i, h, text in zip(got["none"], got["id"], got["h"], got["text"]):
                found.setdefault((none, -i, bytes(h)), [0, text])[0] += 1
            out = []
            for key, (n, text) in found.items():
                packed = zlib.compress(text.encode("utf-8", "surrogatepass"), 1)
                one = (key[0], -key[1], key[2], packed)
                out.append((bisect.bisect_right(first, key) - 1, DOCUMENT, *one, 1))
                if key in starts:
                    out.append(((starts[key] - 1) % len(first), NEXT, *one, 0))
                if n > 1:  # copies go anywhere
                    out.append(((zlib.crc32(key[2]) + at) % len(first), COPIES, *one, n - 1))
            yield pd.DataFrame(out, columns=["slab", "kind", "none", "id", "h", "packed", "copies"])

    def compare(batches):
        items, size = [], 0
        for item in followed(batches):
            items.append(item)
            size += len(item[2])
            if size >= FLAT or len(items) >= 5000 or item[4] > 1:
                yield compared(items)
                items, size = [], 0
        yield compared(items)

    routed = rows.mapInPandas(route, ROUTED).repartition(parts, "slab")
    return routed.sortWithinPartitions("slab", "kind", *order).mapInPandas(compare, EDITED)
