"""Quality rules: counts over words and lines, and the divergence of a text from language references.

A reference holds a language's shares of character classes and the shares of its common words among
all words.  Of each whole text three histograms are taken: of character classes, of a language's common
words among themselves, and of all words, where those that aren't common are one class.  Each is
compared with every reference by Jensen-Shannon distance (base 2, so 0 to 1), in multiples of the
reference's limit; the nearest counts.  A text is rejected when one of the three lies beyond the limit,
unless there is too little in the histogram for it to say anything (``min_chars``,
``min_common_words``, ``min_all_words``; such a distance is 0).  A text without common words diverges by
that alone, however long it is.  A text whose letters are mostly of scripts that no reference covers
isn't judged by distances.  The base rules (too few words, too much repetition) reject by themselves.

``fit`` learns references from all rows with known languages, and their limits from all rows known to be
good; ``BUILT_IN`` ones stand in for languages of which there are too few rows.  Markup, code
and tables diverge from prose, and go.

Defined results: null and empty texts have no words and fail the base rule; repeated rows, and rows with
repeated or null ids, are judged one by one; texts of any length are judged whole, in near-linear time; of
equally near references any gives the same verdict; an empty table gives an empty result, and
``BUILT_IN`` references; columns other than the named ones are ignored by ``quality_scores`` and handed on
unchanged by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm import _blocks as B
from sparkloom.llm import _map
from sparkloom.llm._components import ensure_checkpoint_dir

#: Character classes: ASCII ones, then letters by script (told by a character's first byte).
CLASS_NAMES = (
    "lower", "upper", "digit", "space", "punct", "symbol", "control", "latin", "beyond", "greek", "cyrillic", "semitic", "indic", "cjk", "hangul"
)
_SCRIPTS = slice(9, 15)
_LETTERS = [0, 1, 7, *range(9, 15)]


@dataclass(frozen=True)
class Reference:
    """A language: shares of ``CLASS_NAMES``, of its common words among all words, and the distances
    (classes, common words, all words) that its texts keep to."""

    lang: str
    classes: tuple[float, ...]
    words: tuple[tuple[str, float], ...]
    limits: tuple[float, float, float] = (0.21, 0.80, 0.33)


def _built_in() -> tuple[Reference, ...]:
    """Rough references for a start: common words with shares among themselves (a quarter of all words),
    and shares of lower, upper, digit, space, punctuation, symbol and further Latin characters."""
    words = {
        "en": "the:23 of:12 and:11 to:10 a:8 in:8 is:5 that:4 for:4 it:3 as:3 was:3 on:3 with:3",
        "de": "der:16 die:16 und:13 in:9 den:6 das:6 zu:5 von:5 mit:4 ist:4 des:4 ein:3 eine:3 im:3 für:3",
        "fr": "de:20 la:14 le:12 et:10 les:9 des:8 à:6 en:5 un:5 une:4 du:4 que:3",
        "es": "de:19 la:13 el:11 que:9 y:9 en:9 los:6 las:4 un:5 una:4 con:4 por:4 se:3",
        "it": "di:17 e:13 che:9 la:9 il:9 in:8 a:7 per:5 un:5 è:5 del:4 della:4 non:4 una:4 le:4 si:4 con:4",
        "pt": "de:17 a:12 o:11 que:9 e:11 do:7 da:7 em:6 um:5 para:5 uma:4 com:4 os:4 no:3 não:3",
        "nl": "de:20 van:13 het:11 een:10 en:10 in:9 is:6 dat:5 op:5 te:5 die:4 voor:3 met:3 zijn:3",
    }
    shapes = {
        "en": (0.775, 0.025, 0.005, 0.165, 0.025, 0.001, 0.004), "de": (0.775, 0.050, 0.005, 0.135, 0.020, 0.001, 0.014),
        "fr": (0.745, 0.022, 0.005, 0.160, 0.025, 0.001, 0.042), "es": (0.765, 0.022, 0.005, 0.165, 0.023, 0.001, 0.019),
        "it": (0.785, 0.022, 0.005, 0.155, 0.025, 0.001, 0.007), "pt": (0.755, 0.022, 0.005, 0.165, 0.023, 0.001, 0.029),
        "nl": (0.785, 0.022, 0.005, 0.160, 0.025, 0.001, 0.002),
    }
    out = []
    for lang, listed in words.items():
        pairs = [(w, float(x)) for w, x in (p.split(":") for p in listed.split())]
        whole = 4 * sum(x for _, x in pairs)
        lower, upper, digit, space, punct, symbol, latin = shapes[lang]
        classes = (lower, upper, digit, space, punct, symbol, 0.0, latin, *[0.0] * 7)
        out.append(Reference(lang, classes, tuple((w, x / whole) for w, x in pairs)))
    return tuple(out)


BUILT_IN = _built_in()
SYMBOLS = b"#*$%&|<>"

_CLASS = np.full(256, 6, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[list(b"!\"'(),-./:;?[]{}")] = 4
_CLASS[list(b"#$%&*+<=>@\\^_`|~")] = 5
_CLASS[0x80:0xC0] = 15  # continuation bytes: not characters of their own
_CLASS[0xC0:] = 8  # punctuation, symbols and what else stands beyond ASCII
_CLASS[0xC3:0xCE], _CLASS[0xCE:0xD0], _CLASS[0xD0:0xD5], _CLASS[0xD5:0xE0] = 7, 9, 10, 11
_CLASS[0xE0:0xE2], _CLASS[0xE3:0xEA], _CLASS[0xEA:0xEE] = 12, 13, 14
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_WORD_CHAR = B.LEAD & B.NONSPACE
_PLAIN = B.ALNUM | ((np.arange(256) >= 65) & (np.arange(256) < 91))


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of every row of p (counts or shares) from the distribution q."""
    p = p / np.maximum(p.sum(1, keepdims=True), 1e-300)
    q = (q / q.sum())[None, :]
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


@lru_cache(maxsize=4)
def _vocabulary(references: tuple[Reference, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sorted hashes of all common words, and the places of every reference's own among them."""
    names = sorted({w for r in references for w, _ in r.words})
    raw = [w.encode() for w in names]
    end = np.cumsum([len(x) for x in raw]).astype(np.int64)
    h = B.hash_spans(np.frombuffer(b"".join(raw), np.uint8), end - np.array([len(x) for x in raw], np.int64), end) if raw else np.zeros(0, B.U64)
    order = np.argsort(h)
    place = {names[i]: k for k, i in enumerate(order.tolist())}
    return h[order], [np.array([place[w] for w, _ in r.words], np.int64) for r in references]


def _lines(block: B.Block) -> np.ndarray:
    """Per row: lines with a word that equal an earlier line of the row."""
    data, off = block.data, block.offsets
    line = B.runs(data != 10, off)
    if len(line.start) == 0:
        return np.zeros(block.n, np.int64)
    solid = np.zeros(len(data) + 1, np.int32)
    np.cumsum(B.NONSPACE[data], out=solid[1:])
    keep = solid[line.end] > solid[line.start]
    row = line.row[keep]
    h = B.hash_spans(data, line.start[keep], line.end[keep], 3)
    h = B.mix(h + row.astype(B.U64) * B.U64(0x9E3779B97F4A7C15))
    order = np.argsort(h, kind="stable")
    h = h[order]
    again = order[1:][h[1:] == h[:-1]]
    return np.bincount(row[again], minlength=block.n)


def _repeats(first: np.ndarray, h: np.ndarray, n: int = 3) -> np.ndarray:
    """Per row: words inside n-word windows that occur twice or more in the row."""
    at = B.window_starts(first, n)
    rows = len(first) - 1
    if len(at) == 0:
        return np.zeros(rows, np.int64)
    row = np.searchsorted(first, at, "right") - 1
    key = B.mix(B.chain(h, n)[at] + row.astype(B.U64) * B.U64(0xD1342543DE82EF95))
    order = np.sort(key)
    twice = B.uniq(order[1:][order[1:] == order[:-1]])
    if len(twice) == 0:
        return np.zeros(rows, np.int64)
    place = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    hit = at[twice[place] == key]
    mark = np.zeros(len(h), bool)
    for k in range(n):
        mark[hit + k] = True
    return B.sums(mark, first)


@dataclass(frozen=True)
class Rules:
    """The base rule, and how much a text must hold for its histograms to be judged."""

    min_words: int = 50
    max_repeat_percent: int = 50
    min_chars: int = 200
    min_common_words: int = 10
    min_all_words: int = 40


def _classes(block: B.Block) -> np.ndarray:
    """Characters of each class, a row a text."""
    row = np.repeat(np.arange(block.n), np.diff(block.offsets))
    return np.bincount(row * 16 + _CLASS[block.data], minlength=block.n * 16).reshape(-1, 16)[:, :15].astype(float)


def distances(block: B.Block, references: tuple[Reference, ...], rules: Rules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distances of a block's rows (last axis) from every reference, by each of the three histograms."""
    vocabulary, places = _vocabulary(references)
    classes = _classes(block)
    low, plain = B.words(block, _PLAIN)
    out = np.zeros((3, len(references), block.n))
    some = np.flatnonzero(classes.sum(1) >= rules.min_chars)
    for k, r in enumerate(references):
        out[0, k, some] = js_distance(classes[some], np.array(r.classes))
    rows = np.flatnonzero(plain.counts >= min(rules.min_common_words, rules.min_all_words))
    if len(vocabulary) == 0 or len(rows) == 0:
        return out[0], out[1], out[2]
    number = np.full(block.n, -1)
    number[rows] = np.arange(len(rows))
    h = B.hash_spans(low, plain.start, plain.end)
    place = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    row = number[plain.row]
    hit = (vocabulary[place] == h) & (row >= 0)
    common = np.bincount(row[hit] * len(vocabulary) + place[hit], minlength=len(rows) * len(vocabulary)).reshape(len(rows), -1)
    counts = plain.counts[rows]
    enough = counts >= rules.min_all_words
    for k, r in enumerate(references):
        q = np.array([x for _, x in r.words])
        own = common[:, places[k]].astype(float)
        total = own.sum(1)
        judged = total >= rules.min_common_words
        out[1, k, rows[judged]] = js_distance(own[judged], q)
        every = np.column_stack((own, counts - total))[enough]
        out[2, k, rows[enough]] = js_distance(every, np.append(q, max(1 - q.sum(), 1e-9)))
    return out[0], out[1], out[2]


def _uncovered(block: B.Block, references: tuple[Reference, ...]) -> np.ndarray:
    """Rows whose letters are mostly of scripts that no reference has."""
    classes = _classes(block)
    covered = np.max([r.classes for r in references], axis=0)[_SCRIPTS] >= 0.05
    letters = classes[:, _LETTERS].sum(1)
    return classes[:, _SCRIPTS][:, ~covered].sum(1) > 0.5 * letters


def judged(block: B.Block, references: tuple[Reference, ...] = BUILT_IN, rules: Rules = Rules()) -> dict[str, np.ndarray]:
    """All counts, distances and verdicts of a block's rows."""
    data, w = B.words(block, B.NONSPACE, lower=False)
    by = distances(block, references, rules)
    limits = np.array([r.limits for r in references]).T
    repeats = _repeats(w.first, B.hash_spans(data, w.start, w.end))
    base_failed = (w.counts < rules.min_words) | (100 * repeats > rules.max_repeat_percent * w.counts)
    odd = np.zeros(block.n, bool)
    for d, limit in zip(by, limits):
        odd |= (d > limit[:, None]).all(0)
    odd &= ~_uncovered(block, references)
    return {
        "n_words": w.counts,
        "word_chars": B.sums(_WORD_CHAR[data], block.offsets),
        "n_symbols": B.sums(_SYMBOL[data], block.offsets),
        "n_dup_lines": _lines(block),
        "n_repeat_words": repeats,
        "base_failed": base_failed,
        "kept": ~base_failed & ~odd,
        "class_distance": by[0].min(0),
        "word_distance": by[1].min(0),
        "all_words_distance": by[2].min(0),
    }


@dataclass(frozen=True)
class Fit:
    """Production parameters of ``fit``.  ``sample`` bounds the ids learnt from, where that is wanted."""

    sample: int | None = None
    words: int = 50
    least_rows: int = 100
    quantile: float = 0.999
    margin: float = 1.1
    seed: int = 11


#: Up to so many ids of good rows are broadcast; beyond, a shuffle brings them to their rows.
BROADCAST_IDS = 2_000_000
#: Shares are summed as whole multiples of 1 / _UNIT, so that the order of rows changes nothing.
_UNIT = 1 << 32
_BINS = 4096


def fit(
    docs: DataFrame, good: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    s: Fit = Fit(), rules: Rules = Rules(),
) -> tuple[Reference, ...]:
    """References of the languages in ``docs`` with at least ``s.least_rows`` rows to learn from.

    These are all rows whose ids are in ``good``, rows known to be good, or else all; every row of a
    repeated id counts.  With ``s.sample`` they are the rows of that many ids, those with the smallest hash.
    Limits are learnt from good rows alone: the distance that all but
    1 - ``s.quantile`` of a language's rows keep to, times ``s.margin``; else they are the built-in ones.
    Languages of ``BUILT_IN`` that aren't learnt stay as they are.
    """
    known = docs.where(F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull())
    key = F.col(f"`{id_col}`").alias("id")
    rows = known.select(key, F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    ensure_checkpoint_dir(docs)
    if good is not None or s.sample is not None:
        ids = (known if good is None else good).select(key).where("id is not null").distinct()
        if s.sample is not None:
            ids = ids.orderBy(F.xxhash64("id", F.lit(s.seed)), "id").limit(s.sample)
        ids = ids.checkpoint()
        few = ids.count() <= BROADCAST_IDS
        rows = rows.join(F.broadcast(ids) if few else ids, "id", "left_semi")
        if not few:
            rows = rows.checkpoint()

    def shares(block: B.Block) -> dict:
        own = _classes(block)
        total = own.sum(1)
        parts = np.rint(own / np.maximum(total, 1)[:, None] * _UNIT).astype(np.int64).tolist()
        return {"shares": [x if n >= rules.min_chars else None for x, n in zip(parts, total.tolist())]}

    measured = _map.measured(rows, "id", "text", "shares array<long>", shares, also=("lang",))
    sums = [F.sum(F.col("shares")[k]).alias(f"s{k}") for k in range(len(CLASS_NAMES))]
    per_lang = measured.groupBy("lang").agg(F.count("*").alias("n"), F.count("shares").alias("judged"), *sums)
    classes = {
        r.lang: tuple(r[f"s{k}"] / _UNIT / r.judged for k in range(len(CLASS_NAMES)))
        for r in per_lang.where(F.col("judged") >= s.least_rows).orderBy("lang").collect() if r.judged
    }
    if not classes:
        return BUILT_IN
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = rows.where(F.col("lang").isin(list(classes))).select("lang", F.explode(F.regexp_extract_all(low, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))).alias("word"))
    words = words.groupBy("lang", "word").agg(F.count("*").alias("n")).checkpoint()
    total = {r.lang: r.n for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    top = words.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word")))
    common: dict[str, list[tuple[str, float]]] = {}
    for r in top.where(F.col("rank") <= s.words).orderBy("lang", "rank").collect():
        common.setdefault(r.lang, []).append((r.word, r.n / total[r.lang]))
    learnt = [Reference(x, classes[x], tuple(common[x])) for x in classes if x in common]
    if good is not None and learnt:
        learnt = _limited(rows, learnt, s, rules)
    have = {r.lang for r in learnt}
    return (*learnt, *(r for r in BUILT_IN if r.lang not in have))


def _limited(rows: DataFrame, references: list[Reference], s: Fit, rules: Rules) -> list[Reference]:
    """The references with limits learnt from good rows of their languages."""
    refs = tuple(references)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in B.blocks(batch.column(1)):
                by = np.stack(distances(block, refs, rules))
                lang = batch.column(0).slice(block.lo, block.n).to_pylist()
                at = {r.lang: k for k, r in enumerate(refs)}
                own = [by[:, at[x], i].tolist() if x in at else None for i, x in enumerate(lang)]
                yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(own, pa.list_(pa.float64()))], names=["lang", "own"])

    measured = rows.select("lang", "text").mapInArrow(run, "lang string, own array<double>").where("own is not null")
    each = measured.select("lang", F.posexplode("own").alias("k", "d")).where("d > 0").withColumn("bin", F.floor(F.col("d") * _BINS)).checkpoint()
    bins: dict[tuple[str, int], list[tuple[int, int]]] = {}
    for r in each.groupBy("lang", "k", "bin").agg(F.count("*").alias("n")).orderBy("bin").collect():
        bins.setdefault((r.lang, r.k), []).append((r.bin, r.n))
    # The quantile lies between two ranks: the values of their bins alone are looked at.
    ranks: dict[tuple[str, int], tuple[int, float]] = {}
    wanted: list[tuple[str, int, int]] = []
    for at, listed in bins.items():
        end = np.cumsum([n for _, n in listed])
        if end[-1] >= s.least_rows:
            place = (int(end[-1]) - 1) * s.quantile
            lower = int(place)
            first, last = (int(np.searchsorted(end, min(x, int(end[-1]) - 1), "right")) for x in (lower, lower + 1))
            ranks[at] = lower - (int(end[first - 1]) if first else 0), place - lower
            wanted += [(*at, listed[i][0]) for i in sorted({first, last})]
    values: dict[tuple[str, int], list[tuple[float, int]]] = {}
    if wanted:
        few = rows.sparkSession.createDataFrame(wanted, "lang string, k int, bin long")
        for r in each.join(F.broadcast(few), ["lang", "k", "bin"]).groupBy("lang", "k", "d").agg(F.count("*").alias("n")).orderBy("d").collect():
            values.setdefault((r.lang, r.k), []).append((r.d, r.n))
    out = []
    for r in references:
        limits = list(r.limits)
        for k in range(3):
            if (r.lang, k) in ranks:
                (lower, part), listed = ranks[r.lang, k], values[r.lang, k]
                end = np.cumsum([n for _, n in listed])
                pair = [listed[int(np.searchsorted(end, min(x, int(end[-1]) - 1), "right"))][0] for x in (lower, lower + 1)]
                limits[k] = float(np.quantile(pair, part)) * s.margin
        out.append(Reference(r.lang, r.classes, r.words, tuple(limits)))
    return out


SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, class_distance double, word_distance double, all_words_distance double"
)


def quality_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", references: tuple[Reference, ...] = BUILT_IN, rules: Rules = Rules()) -> DataFrame:
    """One row per document: the counts, the distances, ``base_failed`` and ``kept``."""
    return _map.measured(docs, id_col, text_col, SCHEMA, lambda block: judged(block, references, rules))


def keep_good(docs: DataFrame, text_col: str = "text", references: tuple[Reference, ...] = BUILT_IN, rules: Rules = Rules()) -> DataFrame:
    """The documents that pass, with all their columns."""
    return _map.filtered(docs, text_col, lambda block: judged(block, references, rules)["kept"])
