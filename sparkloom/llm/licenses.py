"""License scans: tags, notice phrases and licence expressions.

The lower-cased text is reduced to its words, one blank between them, and an Aho-Corasick automaton
over all phrases and identifier tags runs once over a block of many texts.  The base phrases count
wherever their words stand consecutively.  A tag is one where its words are written
``SPDX-License-Identifier`` with a colon behind; a licence expression of any length follows, up to the
end of its line or text, which a shunting-yard parser evaluates (``with`` binds closest, then ``and``,
then ``or``): its licences become labels, and the expression as a whole tells whether the text may be
used under permissive terms alone.

Defined results: null and empty texts have no words and no label; a malformed expression gives the
licences that it names and no verdict; labels are sorted, and one that several phrases or tags give
counts once; texts are scanned whole, in time linear in their length; repeated rows and rows with null
or repeated ids give one result each; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from sparkloom.llm import _blocks as B
from sparkloom.llm import _map

#: Base phrases, counted and labelled as the contract of the query says.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further notice phrases (words only) and their labels.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license": "apache-2",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "neither the name of the copyright holder nor the names of its contributors": "bsd-3-clause",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl-1.0",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0": "cc0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "all rights reserved": "all-rights-reserved",
}
#: Identifiers of licences with permissive terms, in lower case; a ``+`` or a suffix ``-or-later`` changes
#: nothing.
PERMISSIVE = frozenset(
    "0bsd afl-3.0 apache-1.0 apache-1.1 apache-2.0 artistic-2.0 blueoak-1.0.0 bsd-1-clause bsd-2-clause bsd-2-clause-patent "
    "bsd-3-clause bsd-3-clause-clear bsd-4-clause bsl-1.0 cc-by-1.0 cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-4.0 cc0-1.0 curl "
    "ecl-2.0 fsfap ftl hpnd icu isc libpng mit mit-0 mit-modern-variant mulanpsl-2.0 ncsa ofl-1.1 openssl php-3.01 postgresql "
    "psf-2.0 python-2.0 unicode-3.0 unicode-dfs-2016 unlicense upl-1.0 w3c wtfpl x11 zlib zpl-2.1".split()
)
#: The words of an identifier tag, and how it is written.
TAG = "spdx license identifier"
_TAG = re.compile(rb"spdx-license-identifier\x20*+:", re.I)
#: What an expression may reach over: the rest of the line, up to a colon, which no expression holds
#: (so a line of many tags is read once).
_REST = re.compile(rb"[^\r\n:]*")
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+-]+")
_RANK = {"with": 3, "and": 2, "or": 1}


def parse_expression(text: str) -> tuple[list, list[str], int]:
    """(postfix form, licence names, characters used) of the expression at the start of a text.

    Reading stops at the first token that can't continue the expression.  The postfix form is empty
    if the expression is malformed.
    """
    output: list = []
    stack: list[str] = []
    names: list[str] = []
    operand, used, depth = True, 0, 0
    for m in _TOKEN.finditer(text):
        if text[used : m.start()].strip():
            break
        token, low = m.group(), m.group().lower()
        if token == "(":
            if not operand:
                break
            stack.append("(")
            depth += 1
        elif token == ")":
            if operand or not depth:
                break
            while stack[-1] != "(":
                output.append(stack.pop())
            stack.pop()
            depth -= 1
        elif low in _RANK:
            if operand:
                break
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[low]:
                output.append(stack.pop())
            stack.append(low)
            operand = True
        else:
            if not operand:
                break
            output.append((token,))
            if not (stack and stack[-1] == "with"):
                names.append(low.strip(".-"))
            operand = False
        used = m.end()
    if operand or depth:
        return [], names, used
    return output + stack[::-1], names, used


def permissive(postfix: list) -> bool | None:
    """Whether the licensee can choose permissive terms alone; None for a malformed expression."""
    if not postfix:
        return None
    stack: list[bool] = []
    for token in postfix:
        if isinstance(token, tuple):
            name = token[0].lower().strip(".-")
            stack.append(name.removesuffix("+").removesuffix("-or-later") in PERMISSIVE)
            continue
        right, left = stack.pop(), stack.pop()
        stack.append(left if token == "with" else left and right if token == "and" else left or right)
    return stack[0]


@dataclass
class _Scanner:
    """The automaton; built once a process."""

    def __post_init__(self) -> None:
        self.automaton = ahocorasick.Automaton()
        self.labels = []
        for phrase, label in [*BASE.items(), *NOTICES.items()]:
            i = len(self.labels)
            self.labels.append(label)
            self.automaton.add_word(f" {phrase} ", (i, len(phrase) + 2))
        self.automaton.add_word(f" {TAG} ", (-1, len(TAG) + 2))
        self.automaton.make_automaton()


_scanner: list[_Scanner] = []


def _tag(raw: bytes, begin: int, stop: int) -> tuple[list[str], bool | None] | None:
    """(licences, verdict) of the tag whose words begin there; None if it isn't written as one or
    nothing follows."""
    m = _TAG.match(raw, begin, stop)
    if m is None or m.end() >= stop or raw[m.end()] in b"\r\n":
        return None
    postfix, names, _ = parse_expression(_REST.match(raw, m.end(), stop).group().decode("utf-8", "replace"))
    return names, permissive(postfix)


def scanned(block: B.Block) -> dict:
    """Columns of ``scan_licenses`` for a block."""
    if not _scanner:
        _scanner.append(_Scanner())
    scanner = _scanner[0]
    n = block.n
    data, w = B.words(block, B.ALNUM)
    # Words of all rows with one blank after each; every row begins with a line feed and a blank.
    length = w.end - w.start
    head = np.zeros(len(length), np.int64)
    rows_with = np.flatnonzero(w.counts > 0)
    head[w.first[rows_with]] = 2
    place = np.cumsum(length + 1 + head) - length - 1
    plain = np.full(int((length + 1 + head).sum()), 32, np.uint8)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[w.start] = 1
    inside[w.end] -= 1
    letters = data[np.cumsum(inside[:-1]).astype(bool)]
    plain[B.ranges(place, length)] = letters
    plain[place[w.first[rows_with]] - 2] = 10
    hits = [(end - size + 2, i) for end, (i, size) in scanner.automaton.iter(plain.tobytes().decode("latin-1"))]
    n_base = np.zeros(n, np.int64)
    first = np.full(n, -1, np.int64)
    last = np.full(n, -1, np.int64)
    base: list[set] = [set() for _ in range(n)] if hits else []
    more: dict[int, set] = {}
    free = [None] * n
    tags: dict[int, int] = {}
    if hits:
        raw = block.data.tobytes()
        at = np.searchsorted(place, [h[0] for h in hits])
        row = np.searchsorted(w.first, at, "right") - 1
        for word, begin, r, (_, i) in zip((at - w.first[row]).tolist(), w.start[at].tolist(), row.tolist(), hits):
            if i < 0:
                found = _tag(raw, begin, int(block.offsets[r + 1]))
                if found is not None:
                    names, verdict = found
                    more.setdefault(r, set()).update(f"spdx:{x}" for x in names if x)
                    tags[r] = tags.get(r, 0) + 1
                    if verdict is not None:
                        free[r] = verdict if free[r] is None else free[r] and verdict
                continue
            more.setdefault(r, set()).add(scanner.labels[i])
            if i < len(BASE):
                n_base[r] += 1
                base[r].add(scanner.labels[i])
                first[r] = word if first[r] < 0 else min(first[r], word)
                last[r] = max(last[r], word)
    labels = [""] * n
    score = np.zeros(n)
    for r, own in more.items():
        labels[r] = ",".join(sorted(own))
        weight = n_base[r] + 2 * tags.get(r, 0) + len(own)
        score[r] = weight / (weight + 1)
    absent = first < 0
    return {
        "n_words": w.counts,
        "n_base": n_base,
        "first_word": np.ma.array(first, mask=absent).tolist(),
        "last_word": np.ma.array(last, mask=absent).tolist(),
        "base_labels": [",".join(sorted(x)) for x in base] if base else [""] * n,
        "labels": labels,
        "score": score,
        "permissive": free,
    }


SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, permissive boolean"
)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: words, base places and labels, all labels, score and verdict.

    ``score`` is w / (w + 1) for the weight w of all evidence (a base place or label 1, a tag 2), 0
    without any.  ``permissive`` joins the verdicts of all well-formed tag expressions by and; null
    without one.
    """
    return _map.measured(docs, id_col, text_col, SCHEMA, scanned)
