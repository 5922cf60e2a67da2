"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's features are all n-grams of 2, 3 and 4 bytes of its lower-cased words (digits and
punctuation count as blanks; blanks bound the words), hashed into ``buckets`` rows of an embedding
table.  Their mean goes through a linear layer and a softmax.  Both layers are
trained by mini-batch stochastic gradient descent in numpy on a bounded sample of labelled rows, whose
texts are learnt from whole: only their bags (buckets and shares) travel, of at most ``buckets``
entries however long the text is.
For prediction the two layers are multiplied into one table of logits a bucket, so a feature costs
one look-up of a few numbers.  Temperature and rejection limit are fitted on a part of the sample
that training doesn't see: ``rejected`` marks predictions less sure than all but ``reject_share`` of
the right ones.

Defined results: null texts and texts without a letter are ``und`` with score 0; without any labelled
row everything is ``und``; of equally likely languages the first by name counts; texts of any length are
read whole; a null id counts as the empty one for the fold, and repeated rows, or rows with repeated or
null ids, are judged one by one; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import _blocks as B
from sparkloom.llm import _map

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[0x80:] = np.arange(0x80, 256)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


@dataclass(frozen=True)
class Settings:
    """Production parameters.  ``sample`` bounds the labelled rows used in training."""

    sample: int = 4000
    buckets: int = 1 << 15
    dim: int = 16
    epochs: int = 6
    batch: int = 32
    rate: float = 0.5
    reject_share: float = 0.001
    seed: int = 7


@dataclass
class Model:
    """Trained parameters: logits a bucket, bias, temperature, rejection limit."""

    labels: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    limit: float


def features(block: B.Block, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every feature, row offsets): all 2-grams, then 3-grams, then 4-grams."""
    n = len(block.data)
    text = np.full(n + 4, 32, np.uint32)
    text[:n] = _FOLD[block.data]
    out = []
    for k in (2, 3, 4):
        code = text[:n].copy()
        for j in range(1, k):
            code = (code << np.uint32(8)) | text[j : n + j]
        if k > 2:
            code = code * np.uint32(2654435761) + np.uint32(k * 0x9E37)
        else:
            code *= np.uint32(2246822519)
        code ^= code >> np.uint32(15)
        code *= np.uint32(2246822519)
        code >>= np.uint32(32 - int(buckets).bit_length() + 1)
        # No n-gram crosses the end of its row: those that would become the blank feature 0.
        last = block.offsets[1:]
        for j in range(1, k):
            edge = last - j
            edge = edge[(edge >= block.offsets[:-1]) & (edge >= 0)]
            code[edge] = 0
        out.append(code)
    return np.concatenate(out), block.offsets


def _mean(table: np.ndarray, block: B.Block, buckets: int) -> np.ndarray:
    """Mean table row of each text's features, by running sums a column."""
    codes, offsets = features(block, buckets)
    n = len(block.data)
    out = np.zeros((block.n, table.shape[1]))
    for c in range(table.shape[1]):
        column = np.ascontiguousarray(table[:, c])
        for k in range(3):
            out[:, c] += B.sums(column[codes[k * n : (k + 1) * n]], offsets)
    return out / np.maximum(3 * np.diff(offsets), 1)[:, None]


Bag = tuple[np.ndarray, np.ndarray]


def bags_of(block: B.Block, buckets: int) -> list[Bag]:
    """(buckets, their shares) of every text of a block."""
    codes, off = features(block, buckets)
    n = len(block.data)
    out = []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        own, count = B.uniq_counts(np.concatenate([codes[j * n + a : j * n + b] for j in range(3)]))
        out.append((own, (count / max(3 * (b - a), 1)).astype(np.float32)))
    return out


def train(texts: list[str], labels: list[str], s: Settings = Settings()) -> Model:
    """Fits a model to labelled texts."""
    column = pa.array(texts, pa.large_string())
    return train_bags([bag for block in B.blocks(column) for bag in bags_of(block, s.buckets)], labels, s)


def train_bags(bags: list[Bag], labels: list[str], s: Settings = Settings()) -> Model:
    """Fits a model to the bags of labelled texts."""
    names = sorted(set(labels))
    k = len(names)
    if k == 0:
        return Model([], np.zeros((s.buckets, 1), np.float32), np.zeros(1), 1.0, 0.0)
    rng = np.random.default_rng(s.seed)
    y = np.searchsorted(names, labels)
    order = rng.permutation(len(bags))
    held, seen = order[: len(bags) // 8], order[len(bags) // 8 :]
    emb = rng.normal(0, 0.1, (s.buckets, s.dim)).astype(np.float32)
    out = np.zeros((s.dim, k), np.float32)
    bias = np.zeros(k, np.float32)
    steps, step = s.epochs * (len(seen) // s.batch + 1), 0
    for _ in range(s.epochs):
        rng.shuffle(seen)
        for lo in range(0, len(seen), s.batch):
            own = seen[lo : lo + s.batch]
            rate = s.rate * (1 - step / steps)
            step += 1
            used = B.uniq(np.concatenate([bags[i][0] for i in own]))
            bag = np.zeros((len(own), len(used)), np.float32)
            for j, i in enumerate(own):
                bag[j, np.searchsorted(used, bags[i][0])] = bags[i][1]
            x = bag @ emb[used]
            z = x @ out + bias
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(own)), y[own]] -= 1
            p /= len(own)
            back = p @ out.T
            out -= rate * 10 * (x.T @ p)
            bias -= rate * 0.1 * p.sum(0)
            emb[used] -= rate * 200 * (bag.T @ back)
    model = Model(names, (emb @ out).astype(np.float32), bias.astype(np.float64), 1.0, 0.0)
    if len(held):
        z = np.array([bags[i][1].astype(np.float64) @ model.table[bags[i][0]] for i in held]) + model.bias
        truth = y[held]
        best = min((_loss(z / t, truth), t) for t in np.geomspace(0.05, 20, 41))
        model.temperature = float(best[1])
        p = _softmax(z / model.temperature)
        right = p.argmax(1) == truth
        if right.any():
            model.limit = float(np.quantile(p.max(1)[right], s.reject_share))
    return model


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    p = _softmax(z)
    return float(-np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean())


def _logits(model: Model, block: B.Block) -> np.ndarray:
    return _mean(model.table, block, len(model.table)) + model.bias


def predicted(block: B.Block, model: Model) -> dict:
    """Columns of ``identify`` for a block."""
    letter = B.sums(_ASCII_LETTER[block.data], block.offsets) > 0
    for r in np.flatnonzero(~letter).tolist():
        letter[r] = any(c.isalpha() for c in block.text(r))
    if not model.labels:
        return {"lang_pred": ["und"] * block.n, "score": np.zeros(block.n), "rejected": np.ones(block.n, bool)}
    p = _softmax(_logits(model, block) / model.temperature)
    best = p.argmax(1)
    score = np.where(letter, p.max(1), 0.0)
    names = np.array(model.labels, object)[best]
    names[~letter] = "und"
    return {"lang_pred": names.tolist(), "score": score, "rejected": ~letter | (score < model.limit)}


def held_out(id_col: str, folds: int = 5, fold: int = 0):
    """Whether crc32 of the id as text falls into the fold that is never learnt from."""
    return F.pmod(F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", s: Settings = Settings()) -> Model:
    """Trains on at most ``s.sample`` labelled rows outside the held-out fold.

    The sample is the rows with the smallest hash of the id: the same rows at any partitioning.  Rows
    whose hash is too large to be among them are left out before anything is sorted or sent.
    """
    labelled = docs.where(~held_out(id_col) & F.col(f"`{lang_col}`").isNotNull())
    share = min(1.0, 1.3 * s.sample / max(labelled.count(), 1))
    order = F.xxhash64(F.col(f"`{id_col}`"), F.lit(s.seed))
    rows = labelled.where((order <= min(int(share * 2**64) - 2**63, 2**63 - 1)) & F.col(f"`{text_col}`").isNotNull())
    rows = rows.select(order.alias("order"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in B.blocks(batch.column(2)):
                bags = bags_of(block, s.buckets)
                part = batch.slice(block.lo, block.n)
                packed = [pa.array([x.tobytes() for x in column], pa.binary()) for column in zip(*bags)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *packed], names=["order", "lang", "own", "share"])

    got = rows.mapInArrow(run, "order long, lang string, own binary, share binary").orderBy("order", "lang", "own", "share").limit(s.sample).collect()
    bags = [(np.frombuffer(r.own, np.uint32), np.frombuffer(r.share, np.float32)) for r in got]
    return train_bags(bags, [r.lang for r in got], s)


SCHEMA = "lang_pred string, score double, rejected boolean"


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the held-out flag, the language, its probability, and the rejection.

    The model is broadcast; its size is fixed by ``Settings`` (buckets times languages).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    got = _map.measured(docs, id_col, text_col, SCHEMA, lambda block: predicted(block, shared.value))
    return got.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score", "rejected")
