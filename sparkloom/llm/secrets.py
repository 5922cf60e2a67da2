"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings.

Base kinds (leftmost, non-overlapping per kind): ``assign`` (a key word, a separator and a value of
six characters or more), ``access`` (AKIA and at least 16 more upper-case letters or digits) and
``hex`` (24 or more lower-case hex digits).  The method adds kind ``entropy``: runs of 20 or more
characters of one of the classes in ``CLASSES`` are candidates; a window slides over each, its
symbol counts change by one in and one out at every step, and so does the sum of c * log2(c) from
which the Shannon entropy follows.  A candidate whose best window reaches its class's limit is a
finding unless the allow-list knows it (identifiers, paths, plain words, sample values).  Where base
findings overlap a run, the parts between them of 20 or more characters are candidates instead.

Offsets are code points, ends exclusive; findings of one start come in the order of ``KINDS``.  A row
is scanned whole in time linear in its length, and by itself: repeated rows and rows with null or
repeated ids give one result each.  Null and empty texts have no findings; empty tables give empty
results; other columns are ignored by ``find_secrets`` and handed on by ``redact``.
"""

from __future__ import annotations

import hashlib
import re
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkloom.llm import _blocks as B
from sparkloom.llm import _map

ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
_KEY = re.compile(rb"passw(?:ord|d)|secret|token|api_?key")
KINDS = ("assign", "access", "hex", "entropy")

_UPPER_DIGIT = np.zeros(256, bool)
_UPPER_DIGIT[48:58] = _UPPER_DIGIT[65:91] = True
_HEX = np.zeros(256, bool)
_HEX[48:58] = _HEX[97:103] = True
_TOKEN = np.zeros(256, bool)
_TOKEN[48:58] = _TOKEN[65:91] = _TOKEN[97:123] = True
_TOKEN[list(b"+/_=-")] = True

#: name: (window, entropy in bits that the best window must reach)
CLASSES = {"hex": (20, 3.0), "token": (20, 3.9)}
#: Patterns that never go back over what they have read (possessive parts, each decided by its first
#: character), so a candidate of any length is judged in linear time.
ALLOWED = (
    re.compile(rb"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),  # UUID
    re.compile(rb"[0-9+/_=-]++"),  # numbers, dates, rules
    re.compile(rb"[/_+=-]*+(?>[A-Z]?[a-z]++|[A-Z]++)(?:[/_+=-]++(?>[A-Z]?[a-z]++|[A-Z]++|[0-9]++))*+[/_+=-]*+"),  # words, paths
    re.compile(rb"(?:[A-Z]?[a-z]{2,}+)++"),  # camel case
    re.compile(rb"[xX]{8,}+.*+"),
)
#: Whoever writes one of these shows a value, and has none.
SAMPLES = (b"example", b"sample", b"placeholder")


def window_entropy(value: bytes, window: int) -> float:
    """Largest Shannon entropy (bits) of any window of the value, by incremental counts."""
    window = min(window, len(value))
    if window == 0:
        return 0.0
    part = [0.0] + [c * log2(c) for c in range(1, window + 1)]
    count = [0] * 256
    total = best = 0.0
    for i, c in enumerate(value):
        if i >= window:
            old = value[i - window]
            total += part[count[old] - 1] - part[count[old]]
            count[old] -= 1
        total += part[count[c] + 1] - part[count[c]]
        count[c] += 1
        if i >= window - 1:
            best = max(best, log2(window) - total / window)
    return best


def _suspicious(value: bytes) -> bool:
    low = value.lower()
    if any(rule.fullmatch(value) for rule in ALLOWED) or any(x in low for x in SAMPLES):
        return False
    kind = "hex" if re.fullmatch(rb"[0-9a-fA-F]+", value) else "token"
    window, limit = CLASSES[kind]
    return window_entropy(value, window) >= limit


def _long_runs(data: np.ndarray, table: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    r = B.runs(table[data], offsets)
    long = r.end - r.start >= least
    return r.start[long], r.end[long]


def _assign(block: B.Block) -> list[tuple[int, int]]:
    """Byte spans of the assign kind.  Key words are looked for in the lower-cased block; the whole
    pattern then runs over those rows alone that have one, each by itself."""
    raw = block.data.tobytes()
    low = raw.lower()
    if not any(x in low for x in (b"passw", b"secret", b"token", b"api")):
        return []
    places = np.fromiter((m.start() for m in _KEY.finditer(low)), np.int64)
    out = []
    for row in B.uniq(np.searchsorted(block.offsets, places, "right") - 1).tolist():
        base = int(block.offsets[row])
        text = raw[base : int(block.offsets[row + 1])]
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 6:
                out.append((base + m.start(), base + m.end()))
    return out


def _access(block: B.Block) -> list[tuple[int, int]]:
    raw = block.data.tobytes()
    out, at = [], raw.find(b"AKIA")
    while at >= 0:
        row = int(np.searchsorted(block.offsets, at, "right")) - 1
        stop, end = int(block.offsets[row + 1]), at + 4
        while end < stop and _UPPER_DIGIT[raw[end]]:
            end += 1
        if at + 4 <= stop and end - at >= 20:
            out.append((at, end))
        at = raw.find(b"AKIA", max(end, at + 4) if at + 4 <= stop else at + 1)
    return out


def findings(block: B.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, end byte, kind) of all findings of a block, by start and then kind."""
    spans = [(s, e, 0) for s, e in _assign(block)] + [(s, e, 1) for s, e in _access(block)]
    s, e = _long_runs(block.data, _HEX, block.offsets, 24)
    spans += [(a, b, 2) for a, b in zip(s.tolist(), e.tolist())]
    base = np.array(sorted(spans), np.int64).reshape(-1, 3)
    bs, be = B.cover(base[:, 0], base[:, 1])
    raw = None
    s, e = _long_runs(block.data, _TOKEN, block.offsets, 20)
    for a, b in zip(s.tolist(), e.tolist()):
        k = int(np.searchsorted(be, a, "right"))
        # Base findings hold parts of it; the others are candidates if they are long enough.
        while a < b:
            stop = min(int(bs[k]), b) if k < len(bs) else b
            if stop - a >= 20:
                if raw is None:
                    raw = block.data.tobytes()
                if _suspicious(raw[a:stop]):
                    spans.append((a, stop, 3))
            if stop == b:
                break
            a, k = int(be[k]), k + 1
    all_ = np.array(sorted(spans), np.int64).reshape(-1, 3)
    return all_[:, 0], all_[:, 1], all_[:, 2]


def _digest(spans: list[str]) -> str:
    return hashlib.sha256(",".join(spans).encode()).hexdigest()


_NONE = _digest([])


def scanned(block: B.Block) -> dict:
    """Columns of ``find_secrets`` for a block."""
    n = block.n
    start, end, kind = findings(block)
    row = np.searchsorted(block.offsets, start, "right") - 1
    out = {f"n_{k}": np.bincount(row[kind == i], minlength=n) for i, k in enumerate(KINDS)}
    base, spans = [_NONE] * n, [""] * n
    if len(start):
        points = np.zeros(len(block.data) + 1, np.int64)
        np.cumsum(B.LEAD[block.data], out=points[1:])
        origin = points[block.offsets[row]]
        cs, ce = points[start] - origin, points[end] - origin
        text = [f"{KINDS[k]}:{a}:{b}" for k, a, b in zip(kind.tolist(), cs.tolist(), ce.tolist())]
        first = np.searchsorted(row, np.arange(n + 1))
        for r in B.uniq(row).tolist():
            own = range(first[r], first[r + 1])
            base[r] = _digest([text[i] for i in own if kind[i] < 3])
            spans[r] = ",".join(text[i] for i in own)
    return out | {"base_sha256": base, "spans": spans}


SCHEMA = "n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string"


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: findings per kind, the base findings' digest, all spans."""
    return _map.measured(docs, id_col, text_col, SCHEMA, scanned)


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[secret]", length_col: str | None = "n_chars") -> DataFrame:
    """All rows and columns; findings in the text are replaced by ``mask``.

    ``length_col``, where present, is set to the new length of texts that changed.  Null stays null.
    """
    at = docs.columns.index(text_col)
    length = docs.columns.index(length_col) if length_col in docs.columns else -1

    def run(batches):
        for batch in batches:
            texts, lengths = None, None
            for block in B.blocks(batch.column(at)):
                start, end, _ = findings(block)
                if len(start) == 0:
                    continue
                start, end = B.cover(start, end)
                row = np.searchsorted(block.offsets, start, "right") - 1
                if texts is None:
                    texts = batch.column(at).to_pylist()
                    lengths = batch.column(length).to_pylist() if length >= 0 else None
                raw = block.data.tobytes()
                for r in B.uniq(row).tolist():
                    parts, last = [], int(block.offsets[r])
                    for i in np.flatnonzero(row == r).tolist():
                        parts += [raw[last : start[i]], mask.encode()]
                        last = int(end[i])
                    parts.append(raw[last : int(block.offsets[r + 1])])
                    texts[block.lo + r] = new = b"".join(parts).decode()
                    if lengths is not None:
                        lengths[block.lo + r] = len(new)
            if texts is not None:
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
                if lengths is not None:
                    batch = batch.set_column(length, batch.schema.field(length), pa.array(lengths, batch.schema.field(length).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)
