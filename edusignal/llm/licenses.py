"""Licence scan: Aho-Corasick finds identifier tags and notice phrases, a shunting-yard
parser evaluates licence expressions with AND, OR and WITH.

Words are runs of a-z, 0-9 and non-ASCII characters of the text with A-Z lower-cased.  Base labels are
places where a base phrase's words stand consecutively.  The method adds: labels of further
notice phrases, and licences of expressions behind identifier tags (``SPDX-License-Identifier:``
and the like), whose identifiers are the operands, unknown ones by their own name.  ``a or b`` offers both,
``a and b`` asks for both, ``x with e`` is one licence with an exception, which the expression keeps.

Defined cases: null counts as empty: no words, no labels, null places, score 0; equal
places of different phrases all count; a tag with an expression that can't be parsed gives the
identifiers it has up to the fault; null doc_ids and repeated rows are scanned like any other, long texts whole; an empty table
gives no rows; extra columns are not read.
"""

from __future__ import annotations

import re
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text

# Base phrases and labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Notice phrases of well-known licences and their labels.
NOTICES = {
    "mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license": "apache-2",
    "apache software license": "apache-2",
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "bsd 2 clause license": "bsd-2-clause",
    "bsd 3 clause license": "bsd-3-clause",
    "isc license": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "boost software license": "bsl",
    "creative commons attribution": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by 4 0": "cc-by",
    "cc0 1 0": "cc0",
    "all rights reserved": "all-rights-reserved",
}

# Tags that an identifier expression follows.
TAGS = ("spdx-license-identifier:", "license-expression:", "\"license\":", "license:")
# The tags that only identifiers follow, and how identifiers of one's own begin.
SURE, REFERENCE = TAGS[:2], ("licenseref-", "documentref-")

# Identifiers (lower case) and their labels.
IDENTIFIERS = {
    "mit": "mit", "mit-0": "mit-0", "apache-2.0": "apache-2", "apache-1.1": "apache-1.1",
    "gpl-2.0": "gpl-2", "gpl-2.0-only": "gpl-2", "gpl-2.0-or-later": "gpl-2", "gpl-2.0+": "gpl-2",
    "gpl-3.0": "gpl-3", "gpl-3.0-only": "gpl-3", "gpl-3.0-or-later": "gpl-3", "gpl-3.0+": "gpl-3",
    "lgpl-2.1": "lgpl", "lgpl-2.1-only": "lgpl", "lgpl-2.1-or-later": "lgpl", "lgpl-3.0": "lgpl",
    "lgpl-3.0-only": "lgpl", "lgpl-3.0-or-later": "lgpl", "agpl-3.0": "agpl", "agpl-3.0-only": "agpl", "agpl-3.0-or-later": "agpl",
    "mpl-2.0": "mpl", "epl-2.0": "epl", "bsd-2-clause": "bsd-2-clause", "bsd-3-clause": "bsd-3-clause", "isc": "isc",
    "unlicense": "unlicense", "bsl-1.0": "bsl", "cc-by-4.0": "cc-by", "cc-by-sa-4.0": "cc-by-sa", "cc-by-nc-4.0": "cc-by-nc",
    "cc-by-nd-4.0": "cc-by-nd", "cc0-1.0": "cc0", "zlib": "zlib",
}

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: ASCII bytes that aren't a-z or 0-9, made spaces.
SPLIT = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
POWER = {"or": 1, "and": 2, "with": 3}
TOKEN = re.compile(r"[ \t\"']*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+-]*)")


def words_of(text: str) -> list[str]:
    return text.encode("utf-8", "surrogatepass").translate(LOWER).translate(SPLIT).decode("utf-8", "surrogatepass").split(" ")


def tokens(text: str, at: int) -> list[str]:
    """Words and brackets from ``at`` to the end of the line or the first other character."""
    out = []
    while m := TOKEN.match(text, at):
        out.append(m[1].lower())
        at = m.end()
    return out


def parse(parts: list[str]) -> list[str]:
    """Shunting-yard: the expression in postfix order, as far as it is well formed."""
    out, stack, operand = [], [], False
    for p in parts:
        if p in POWER:
            if not operand:
                break
            while stack and stack[-1] != "(" and POWER[stack[-1]] >= POWER[p]:
                out.append(stack.pop())
            stack.append(p)
            operand = False
        elif p == "(":
            if operand:
                break
            stack.append(p)
        elif p == ")":
            if not operand or "(" not in stack:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        else:
            if operand:
                break
            out.append(p)
            operand = True
    if not operand and stack and stack[-1] in POWER:  # the line ends with an operator
        stack.pop()
    return out + [s for s in reversed(stack) if s != "("]


def evaluate(postfix: list[str], sure: bool = True) -> tuple[str, set[str]]:
    """The expression with labels for identifiers, and its labels.  An unknown identifier is its own label where the tag
    makes ``sure`` that it is one, beside a known one, or if it says so itself (``LicenseRef-``); else the word is prose."""
    operands = [p for p in postfix if p not in POWER]
    if not (sure or any(p in IDENTIFIERS or p.startswith(REFERENCE) for p in operands)):
        return "", set()
    stack: list[tuple[str, set[str]]] = []
    for p in postfix:
        if p not in POWER:
            label = IDENTIFIERS.get(p, p)
            stack.append((label, {label}))
        elif len(stack) > 1:
            (b, more), (a, some) = stack.pop(), stack.pop()
            # one licence with its exception: the exception is no licence of its own
            stack.append((f"({a} {p} {b})", some if p == "with" else some | more))
    return stack[-1] if stack else ("", set())


@cache
def automata():
    """(phrases over the space-joined words, tags over the lower-cased text)."""
    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for p in {*BASE, *NOTICES}:
        phrases.add_word(f" {p} ", p)
    for t in TAGS:
        tags.add_word(t, t)
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def scan(text: str | None) -> dict:
    """n_words, n_base, first_word, last_word, base_labels, labels, expressions and score of a text."""
    phrases, tags = automata()
    text = text or ""
    words = [w for w in words_of(text) if w]
    line = f" {' '.join(words)} "
    places, base, more, spaces, at = [], set(), set(), 0, 0
    for end, phrase in phrases.iter(line):
        if phrase in NOTICES:
            more.add(NOTICES[phrase])
        if phrase in BASE:
            base.add(BASE[phrase])
            spaces, at = spaces + line.count(" ", at, end), end
            places.append(spaces - phrase.count(" ") - 1)
    expressions, offered = [], set()
    low = text.encode("utf-8", "surrogatepass").translate(LOWER).decode("utf-8", "surrogatepass")
    for end, tag in tags.iter(low):
        shown, found = evaluate(parse(tokens(low, end + 1)), tag in SURE)
        if found:
            expressions.append(shown)
            offered |= found
    labels = base | more | offered
    score = 1.0 if base or offered else 0.8 if more else 0.0
    return {"n_words": len(words), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": score, "expressions": expressions}


def find_licenses(docs: DataFrame) -> DataFrame:
    """One row a document with what :func:`scan` gives."""
    kind = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>"

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([scan(t) for t in texts], columns=[c.split()[0] for c in kind.split(", ")])
        return out.astype({"first_word": "Int64", "last_word": "Int64"})
    return id_text(docs).select("doc_id", run("text").alias("__r")).select("doc_id", "__r.*")
