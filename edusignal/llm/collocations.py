"""Phrase collocations, counted by broadcast double-array tries.

A symbol is a 64-bit hash of (lang, word), so everything is per lang; the seed is changed until no two words of the corpus share
a symbol.  Candidates are Apriori-safe: all their words are frequent, and so may be they themselves and every phrase of two or
three words within them, judged by a sketch: tasks count phrases of two to four frequent words by cell of a hash, the counts of
a cell are summed, and a cell below ``least`` holds no frequent phrase.  A false alarm costs time only.  Words and candidates of
all lengths then make one double-array trie; a pass over all texts (split and numbered once for all these passes) advances the states of all text positions together, word by
word, bincounts the states reached, and the tasks' counts are summed.

A word's code is two digits in the trie, so a node has few children and the arrays stay dense.  A trie holds ``most`` phrases at
most, whatever the corpus: beyond that, phrases are split by their first symbol into several tries, each broadcast for a
pass of its own.  The bit maps of frequent words and cells have fixed sizes; on a corpus that fills them they sort out less, and
the tries become more.

Defined cases: a null text counts as empty, a null lang as ``und``; rows are counted one by one, repeats included, and doc_id is not read; words
are not cut whatever their length; an empty table or one without frequent phrases gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import with_position
from .common import attach, settle, shard_of, ship_package

#: Occurrences of a phrase that counts; words of the longest one; phrases of one trie; rows reported per lang.
LEAST, LONGEST, MOST, TOP = 30, 4, 2_000_000, 2000
#: Phrases of a row of counts.
SHARD = 4096
#: Words in a task's dictionary, phrases that it holds unsorted, bits of the map of frequent words, and of the sketch and a row of it.
KNOWN, HELD, BITS, CELLS, ROW = 300_000, 2_000_000, 1 << 26, 1 << 29, 1 << 16
CUTS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\xff" * 10 + b" ")  # 0xff is in no UTF-8 text
SYMBOLS = [f"s{i}" for i in range(1, LONGEST + 1)]


def symbol(lang: bytes, word: bytes, seed: int) -> int:
    """Never 0, which stands for no word."""
    raw = hashlib.blake2b(lang + b"\0" + word, digest_size=8, key=str(seed).encode()).digest()
    return int.from_bytes(raw, "little", signed=True) or 1


class Trie:
    """Double array over word codes (two digits below ``radix``).  The root's children are at their codes; a node's child by
    digit d is at ``base[node] + d``, if ``check`` there names the node."""

    def __init__(self, phrases: list[np.ndarray], numbers: list[np.ndarray]):
        """``phrases[k]``: rows of k + 1 symbols, whose prefixes are in the rows before; ``numbers``: what stands for each.
        ``phrases`` is emptied on the way: a trie's rows are not held twice."""
        self.alphabet = np.unique(np.concatenate([np.unique(r) for r in phrases]))
        self.radix = 1 << (len(self.alphabet).bit_length() + 1) // 2
        self.end = len(self.alphabet) + 1
        self.base = np.zeros(self.end + self.radix, np.int32)
        self.check = np.full(self.end + self.radix, -1, np.int32)
        self.random = np.random.default_rng(7)
        coded = [self.codes(phrases.pop(0).ravel()).reshape(-1, k) for k in range(1, len(phrases) + 1)]
        at = coded[0].ravel()
        self.check[0], self.check[at] = -2, 0
        states = [at]
        for codes in coded[1:]:
            state = codes[:, 0]
            for k in range(1, codes.shape[1] - 1):
                state = self.advance(state, codes[:, k])
            states.append(self.add(self.add(state, codes[:, -1] // self.radix), codes[:, -1] % self.radix))
        self.size = 1 + max((int(x.max()) for x in numbers if len(x)), default=-1)
        self.place = np.full(len(self.check), -1, np.int32)  # what stands for a state's phrase
        self.place[np.concatenate(states)] = np.concatenate(numbers)

    def codes(self, symbols: np.ndarray) -> np.ndarray:
        """1 and up; 0 for symbols outside the alphabet."""
        if not len(self.alphabet):
            return np.zeros(len(symbols), np.int32)
        at = np.minimum(np.searchsorted(self.alphabet, symbols), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == symbols, at + 1, 0).astype(np.int32)

    def grow(self, size: int) -> None:
        more = size + self.radix - len(self.check)
        if more > 0:
            self.base = np.concatenate([self.base, np.zeros(more, np.int32)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int32)])

    def add(self, parents: np.ndarray, digits: np.ndarray) -> np.ndarray:
        """States of the children (new ones are placed); equal rows get the same state."""
        pairs, back = np.unique(parents.astype(np.int64) * self.radix + digits, return_inverse=True)
        of, digit = pairs // self.radix, pairs % self.radix
        begin = np.flatnonzero(np.diff(of, prepend=-1))
        sizes = np.diff(np.append(begin, len(of)))
        base = np.full(len(begin), -1, np.int64)
        # Wide nodes get places of their own, one after another; the others go where there is room.
        low, high = digit[begin], digit[begin + sizes - 1] if len(begin) else digit[:0]
        wide = sizes > 16
        span = np.where(wide, high - low + 1, 0)
        base[wide] = (self.end + np.cumsum(span) - span - low + self.radix)[wide]
        self.end += int(span.sum()) + self.radix * bool(wide.any())
        self.grow(self.end)
        group = np.repeat(np.arange(len(begin)), sizes)
        there = wide[group]
        self.check[(base[group] + digit)[there]] = of[there]
        rest, turn = np.flatnonzero(~wide), 0
        if len(rest):
            self.end += 2 * int(sizes[rest].sum())
        while len(rest):
            if turn and turn % 8 == 0:
                self.end += self.end // 4 + self.radix
            self.grow(self.end)
            turn += 1
            tried = np.full(len(begin), -1, np.int64)
            tried[rest] = self.random.integers(0, self.end, len(rest))
            mine = np.flatnonzero(tried[group] >= 0)
            slot, who = tried[group[mine]] + digit[mine], group[mine]
            claim = np.full(len(self.check), -1, np.int32)
            claim[slot] = who
            lost = np.zeros(len(begin), bool)
            lost[who[(self.check[slot] != -1) | (claim[slot] != who)]] = True
            won = ~lost[who]
            self.check[slot[won]] = of[mine[won]]
            base[rest[~lost[rest]]] = tried[rest[~lost[rest]]]
            rest = rest[lost[rest]]
        self.base[of[begin]] = base
        return (base[group] + digit).astype(np.int32)[back]

    def advance(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The states after one more word each; 0 where there is none."""
        middle = self.base[states] + codes // self.radix
        middle = np.where((self.check[middle] == states) & (states > 0), middle, 0)
        after = self.base[middle] + codes % self.radix
        return np.where((middle > 0) & (codes > 0) & (self.check[after] == middle), after, 0)


class Reader:
    """Texts of a task as one flat array of word numbers; 0 between pieces and texts."""

    def __init__(self, seed: int):
        self.seed = seed
        self.clear()

    def clear(self) -> None:
        self.words: list[bytes] = [b""]
        self.langs: list[bytes] = [b""]
        self.dicts: dict[bytes, Numbers] = {}

    def read(self, langs: list, texts: list) -> np.ndarray:
        out = []
        for lang, text in zip(langs, texts):
            lang = bytes(lang)
            if lang not in self.dicts:
                self.dicts[lang] = Numbers(lang, self)
            tokens = bytes(text).lower().translate(CUTS).replace(b"\xff", b" \xff ").split()
            out.append(np.fromiter(map(self.dicts[lang].__getitem__, tokens), np.int64, len(tokens)))
            out.append(np.zeros(1, np.int64))
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def symbols(self, first: int) -> np.ndarray:
        """Symbols of the words from number ``first`` on."""
        return np.array([symbol(a, w, self.seed) if w else 0 for a, w in zip(self.langs[first:], self.words[first:])], np.int64)


class Numbers(dict):
    """A lang's words to numbers, given out as words are met."""

    def __init__(self, lang: bytes, reader: Reader):
        super().__init__({b"\xff": 0})
        self.lang, self.words, self.langs = lang, reader.words, reader.langs

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        self.langs.append(self.lang)
        return n


def read_batches(batches: Iterator[pd.DataFrame], reader: Reader, rows: int = 500) -> Iterator[np.ndarray]:
    for got in batches:
        for at in range(0, len(got), rows):
            yield reader.read(got["lang"].iloc[at:at + rows].tolist(), got["text"].iloc[at:at + rows].tolist())


def split_once(texts: DataFrame, shared, seed: int) -> DataFrame:
    """The texts in numbers, for passes on frequent words: a row has the symbols of the different frequent words of some hundred
    texts, and the words of these texts by their place there, from 1; 0 for other words and between pieces and texts; ``width``:
    bytes of a place."""
    def split(batches):
        walk = Walk(shared.value, seed)
        for flat in walk.read(batches):
            seen = np.zeros(len(walk.symbols), bool)
            seen[flat] = True
            there = np.flatnonzero(seen & walk.frequent)
            place = np.zeros(len(seen), np.uint16 if len(there) < 1 << 16 else np.uint32)
            place[there] = np.arange(1, len(there) + 1)
            yield pd.DataFrame({"symbols": [walk.symbols[there].tobytes()], "places": [place[flat].tobytes()], "width": [place.itemsize]})
            if len(walk.reader.words) > KNOWN:
                walk.clear()
    return texts.mapInPandas(split, "symbols binary, places binary, width int")


def word_counts(texts: DataFrame, seed: int) -> DataFrame:
    """(lang, word, symbol, n) of every word."""
    def count(batches):
        reader, n = Reader(seed), np.zeros(0, np.int64)

        def out():
            return pd.DataFrame({"lang": reader.langs[1:], "word": reader.words[1:], "n": np.pad(n, (0, len(reader.words) - len(n)))[1:]})
        for flat in read_batches(batches, reader):
            more = np.bincount(flat, minlength=len(reader.words))
            more[:len(n)] += n
            n = more
            if len(reader.words) > KNOWN:
                yield out()
                reader.clear()
                n = np.zeros(0, np.int64)
        yield out()

    @F.pandas_udf("long")
    def symbols(lang: pd.Series, word: pd.Series) -> pd.Series:
        return pd.Series([symbol(bytes(a), bytes(b), seed) for a, b in zip(lang, word)], dtype="int64")
    found = texts.mapInPandas(count, "lang binary, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return found.select(F.col("lang").cast("string").alias("lang"), F.col("word").cast("string").alias("word"), symbols("lang", "word").alias("symbol"), "n")


def mixed(*symbols: np.ndarray) -> np.ndarray:
    """A hash of phrases, given their first symbols, their second ones and so on."""
    x = np.full(len(symbols[0]), len(symbols), np.uint64)
    for one in symbols:
        x = (x ^ one.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return x


def cell_of(*symbols: np.ndarray) -> np.ndarray:
    """Cell of the sketch of phrases, given as for :func:`mixed`."""
    return (mixed(*symbols) >> np.uint64(35)).astype(np.int64)


class Walk:
    """What a pass keeps in a task: word numbers, their symbols, whether the bit map calls them frequent."""

    def __init__(self, shared: dict, seed: int):
        self.reader, self.shared = Reader(seed), shared
        self.clear()

    def clear(self) -> None:
        self.reader.clear()
        self.symbols, self.frequent, self.code = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def read(self, batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
        """Word numbers of texts, or of rows of :func:`split_once`, which bring their own words."""
        for got in batches:
            if "places" not in got:
                for flat in read_batches(iter([got]), self.reader):
                    self.learn(self.reader.symbols(len(self.symbols)))
                    yield flat
                continue
            for symbols, places, width in zip(got["symbols"], got["places"], got["width"]):
                self.clear()
                self.learn(np.concatenate([np.zeros(1, np.int64), np.frombuffer(symbols, np.int64)]))
                yield np.frombuffer(places, np.uint16 if width == 2 else np.uint32).astype(np.int64)

    def learn(self, new: np.ndarray) -> None:
        """Symbols of the words met since the last call."""
        self.symbols = np.concatenate([self.symbols, new])
        if "bits" in self.shared:
            self.frequent = np.concatenate([self.frequent, bit(self.shared["bits"], new % BITS) & (new != 0)])
        if "trie" in self.shared:
            self.code = np.concatenate([self.code, self.shared["trie"].codes(new)])

    def runs(self, flat: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        """For two words, three and so on: positions from which that many are frequent, and their symbols."""
        flat = np.append(flat, np.zeros(LONGEST, np.int64))
        ok = self.frequent[flat]
        at = np.flatnonzero(ok)
        for k in range(1, longest):
            at = at[ok[at + k]]
            yield at, [self.symbols[flat[at + j]] for j in range(k + 1)]

    def states(self, flat: np.ndarray) -> Iterator[np.ndarray]:
        """The states of all positions whose phrase of one word is in the trie, then of two words and so on."""
        trie, code = self.shared["trie"], np.concatenate([self.code[flat], np.zeros(LONGEST, np.int64)])
        head = code[:len(flat)]
        at = np.flatnonzero((head > 0) & (trie.check[head] == 0))
        state = head[at]
        for k in range(1, LONGEST + 1):
            yield state
            if k < LONGEST:
                state = trie.advance(state, code[at + k])
                at, state = at[state > 0], state[state > 0]


def bit(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def sketched(texts: DataFrame, shared, seed: int) -> DataFrame:
    """(row, at, n): counts of phrases of two to ``LONGEST`` frequent words by cell, a row of ``ROW`` cells each."""
    def sketch(batches):
        walk, held, size = Walk(shared.value, seed), [], 0

        def out():
            cell, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            row = cell // ROW
            begin = np.flatnonzero(np.diff(row, prepend=-1))
            ends = np.append(begin[1:], len(row))
            at, n = (cell % ROW).astype("<u2"), np.minimum(n, 255).astype(np.uint8)
            return pd.DataFrame({"row": row[begin], "at": [at[a:b].tobytes() for a, b in zip(begin, ends)], "n": [n[a:b].tobytes() for a, b in zip(begin, ends)]})
        for flat in walk.read(batches):
            for _, symbols in walk.runs(flat, LONGEST):
                held.append(cell_of(*symbols))
                size += len(held[-1])
            if size > HELD or len(walk.reader.words) > KNOWN:
                yield out()
                held, size = [], 0
            if len(walk.reader.words) > KNOWN:
                walk.clear()
        yield out()
    return texts.mapInPandas(sketch, "row int, at binary, n binary")


def frequent_cells(sketches: DataFrame, parts: int, least: int) -> np.ndarray:
    """Bit map of the cells with ``least`` phrases; a row's counts are summed as they stream by."""
    def add(batches):
        row, total = None, None

        def out():
            return pd.DataFrame({"row": [row], "bits": [zlib.compress(np.packbits(total >= min(least, 255), bitorder="little").tobytes(), 1)]})
        for got in batches:
            for k, at, n in zip(got["row"], got["at"], got["n"]):
                if k != row:
                    if row is not None:
                        yield out()
                    row, total = k, np.zeros(ROW, np.int64)
                total[np.frombuffer(at, "<u2")] += np.frombuffer(n, np.uint8)
        if row is not None:
            yield out()
    bits = np.zeros(CELLS // 8, np.uint8)
    summed = sketches.repartition(parts, "row").sortWithinPartitions("row").mapInPandas(add, "row int, bits binary")
    for r in summed.toLocalIterator():  # CELLS / ROW rows at most
        bits[r["row"] * (ROW // 8):(r["row"] + 1) * (ROW // 8)] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return bits


def candidates(texts: DataFrame, shared, seed: int) -> DataFrame:
    """(s1, ..., s4) of phrases that may be frequent, 0 after the last word; a task sends each once, unless it meets more than
    ``HELD`` / 2 different ones."""
    def distinct(rows):
        """Rows by their hash, and the hashes; of equal ones one, but for those that a rare tie of hashes parts."""
        key = mixed(*(np.ascontiguousarray(c) for c in rows.T))
        order = np.argsort(key)
        key, rows = key[order], rows[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
        return key[new], rows[new]

    def find(batches):
        walk, held, size = Walk(shared.value, seed), [], 0
        key, known = distinct(np.zeros((0, LONGEST), np.int64))
        for flat in walk.read(batches):
            cells, before, met = shared.value["cells"], np.zeros(0, np.int64), []
            for k, (at, symbols) in enumerate(walk.runs(flat, LONGEST), 2):
                ok = bit(cells, cell_of(*symbols))
                if k > 2:  # the phrases without the last and without the first word
                    there = np.zeros(len(flat) + 1, bool)
                    there[before] = True
                    ok &= there[at] & there[at + 1]
                before = at[ok]
                met.append(np.column_stack([s[ok] for s in symbols] + [np.zeros(len(before), np.int64)] * (LONGEST - k)))
            its, rows = distinct(np.concatenate(met))
            if len(known):
                rows = rows[(known[np.minimum(np.searchsorted(key, its), len(known) - 1)] != rows).any(axis=1)]
            held.append(rows)
            size += len(rows)
            if size > HELD // 16:  # a phrase takes five numbers
                key, known = distinct(np.concatenate([known, *held]))
                held, size = [], 0
                if len(known) > HELD // 2:
                    yield pd.DataFrame(known, columns=SYMBOLS)
                    key, known = key[:0], known[:0].copy()
            if len(walk.reader.words) > KNOWN // 2:  # beside the phrases
                walk.clear()
        yield pd.DataFrame(distinct(np.concatenate([known, *held]))[1], columns=SYMBOLS)
    return texts.mapInPandas(find, ", ".join(f"{c} long" for c in SYMBOLS)).distinct()


def counted(texts: DataFrame, shared, seed: int) -> DataFrame:
    """(part, at, counts) of a trie's phrases: a task's counts, ``SHARD`` phrases a row."""
    part = shared.value["part"]

    def count(batches):
        walk, trie = Walk(shared.value, seed), shared.value["trie"]
        n, held, size = np.zeros(trie.size, np.int64), [], 0
        for flat in walk.read(batches):
            for state in walk.states(flat):
                held.append(trie.place[state])
                size += len(state)
            if size > HELD:
                n += np.bincount(np.concatenate(held), minlength=len(n))
                held, size = [], 0
            if len(walk.reader.words) > KNOWN:
                walk.clear()
        if held:
            n += np.bincount(np.concatenate(held), minlength=len(n))
        at = [k for k in range(0, len(n), SHARD) if n[k:k + SHARD].any()]
        yield pd.DataFrame({"part": part, "at": at, "counts": [zlib.compress(n[k:k + SHARD].astype("<i8").tobytes(), 1) for k in at]})
    return texts.mapInPandas(count, "part int, at long, counts binary")


def summed(shards: DataFrame, parts: int, least: int) -> DataFrame:
    """(part, place, n) of the phrases with ``least``: the tasks' counts of a shard are summed as they stream by."""
    def add(batches):
        key, total = None, None

        def out():
            found = np.flatnonzero(total >= least)
            return pd.DataFrame({"part": key[0], "place": key[1] + found, "n": total[found]})
        for got in batches:
            for part, at, counts in zip(got["part"], got["at"], got["counts"]):
                own = np.frombuffer(zlib.decompress(counts), "<i8")
                if (part, at) != key:
                    if key is not None:
                        yield out()
                    key, total = (part, at), np.zeros(len(own), np.int64)
                total = total + own
        if key is not None:
            yield out()
    return shards.repartition(parts, "part", "at").sortWithinPartitions("part", "at").mapInPandas(add, "part int, place long, n long")


def tries(spark, phrases: DataFrame, of: int):
    """Broadcast tries, one after another, which together hold ``phrases`` (part, place, s1, ..., s4)."""
    for part in range(of):
        mine = phrases.where(F.col("part") == part)
        rows, numbers = [], []
        for k in range(1, LONGEST + 1):
            there = mine.where(F.col(SYMBOLS[k - 1]) != 0)
            there = there if k == LONGEST else there.where(F.col(SYMBOLS[k]) == 0)
            got = there.select("place", *SYMBOLS[:k]).orderBy("place").toArrow()
            numbers.append(got["place"].to_numpy())
            rows.append(np.column_stack([got[c].to_numpy() for c in SYMBOLS[:k]]))
            del got
        yield spark.sparkContext.broadcast({"trie": Trie(rows, numbers), "part": part})


def word_bits(frequent: DataFrame) -> np.ndarray:
    """Bit map of symbols, built by 64-bit words: BITS / 64 rows at most, whatever their number."""
    place = F.pmod("symbol", F.lit(BITS))
    one = F.expr(f"shiftleft(1L, cast(pmod(symbol, {BITS}) % 64 as int))")
    rows = frequent.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(one).alias("b")).toArrow()
    bits = np.zeros(BITS // 64, np.uint64)
    bits[rows["at"].to_numpy()] = rows["b"].to_numpy().view(np.uint64)
    return bits.view(np.uint8)


def phrase_counts(docs: DataFrame, least: int = LEAST, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """All words (lang, word, symbol, n), and (s1, ..., s4, n) of the phrases of 1 to 4 words that occur ``least`` times."""
    spark = docs.sparkSession
    ship_package(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.coalesce("lang", F.lit("und")).cast("binary").alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    seed = 0
    while True:
        words = settle(word_counts(texts, seed))
        if words.groupBy("symbol").agg(F.count(F.lit(1)).alias("k")).where("k > 1").isEmpty():
            break
        seed += 1
    frequent = settle(words.where(F.col("n") >= least).select("symbol"))
    bits = word_bits(frequent)
    judged = {"bits": bits}
    shared = spark.sparkContext.broadcast(judged)
    split = settle(split_once(texts, shared, seed))
    judged["cells"] = frequent_cells(sketched(split, shared, seed), parts, least)
    judged = spark.sparkContext.broadcast(judged)  # the driver keeps no copy
    # A task a slot, not one a split: each sends all candidates that it meets, so rows would grow with splits times candidates.
    found = candidates(split.coalesce(max(1, spark.sparkContext.defaultParallelism)), judged, seed)
    alone = frequent.select(F.col("symbol").alias("s1"), *[F.lit(0).cast("long").alias(c) for c in SYMBOLS[1:]])
    phrases = settle(found.unionByName(alone))
    of = max(1, -(-phrases.count() // most))
    # A part's phrases are numbered from 0: places in the sorted whole, less that of the part's first.
    ranked = settle(with_position(phrases.withColumn("part", F.pmod("s1", F.lit(of)).cast("int")).orderBy("part", *SYMBOLS), "number"))
    first = ranked.groupBy("part").agg(F.min("number").alias("first"))  # ``of`` rows
    placed = settle(ranked.join(first, "part").select("part", (F.col("number") - F.col("first")).alias("place"), *SYMBOLS))
    shards = None
    for shared in tries(spark, placed, of):
        more = counted(split, shared, seed)
        shards = more if shards is None else shards.unionByName(more)
    return words, settle(placed.join(summed(shards, parts, least), ["part", "place"]).select(*SYMBOLS, "n"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, most: int = MOST) -> DataFrame:
    """Each lang's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    spark = docs.sparkSession
    words, counts = phrase_counts(docs, least, most)
    known = counts.select(F.filter(F.array(*SYMBOLS), lambda x: x != 0).alias("p"), F.col("n").alias("f"))
    known = settle(known.withColumn("__shard", shard_of(spark, F.col("p"))))
    candidates = known.where(F.size("p") > 1).withColumnRenamed("f", "a")

    def wide(c):
        return F.col(c).cast("decimal(38,0)")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("p") - 1), lambda k: F.transform(
        F.sequence(F.lit(1), F.size("p") - k + 1), lambda i: F.slice("p", i, k))))
    covering = (candidates.where(F.size("p") > 2).select(F.explode(inner).alias("p"), "a")
                .groupBy("p").agg(F.max("a").alias("longer")))
    kept = (candidates.join(covering, "p", "left").where(F.col("longer").isNull() | (100 * wide("longer") < 80 * wide("a")))
            .select("p", "a", "__shard"))
    cuts = kept.select("p", "a", "__shard", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"))
    found = known.select(F.col("p").alias("part"), "f")
    left = attach(cuts.withColumn("part", F.slice("p", 1, F.col("k"))), found, "part").withColumnRenamed("f", "l")
    both = attach(left.withColumn("part", F.slice("p", F.col("k") + 1, F.size("p"))), found, "part").withColumnRenamed("f", "r")
    scored = both.withColumn("score", F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    best = scored.groupBy("p", "a", "__shard").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("b"))
    spelt = attach(best.select("p", "a", "b", "__shard", F.posexplode("p").alias("i", "symbol")), words.select("symbol", "lang", "word"), "symbol")
    named = (spelt.groupBy("p", "a", "b").agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("i", "word"))).alias("w"))
             .select("lang", F.array_join("w.word", " ").alias("phrase"), "a", "b.l", "b.r", "b.score"))
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    parts = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    first = named.withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
