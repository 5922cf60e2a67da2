import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import _exchange as X
from sparkloom.llm import lm, repeats


def text(rng, n):
    return "".join(rng.choice("ab é\n") for _ in range(n))


def corpus(seed=5, n=60):
    rng = random.Random(seed)
    base = [text(rng, 400) for _ in range(6)]
    rows = []
    for i in range(n):
        k = rng.random()
        if k < 0.2:
            t = rng.choice(base)
        elif k < 0.7:
            parts = []
            for _ in range(rng.randint(1, 6)):
                b, a = rng.choice(base), rng.randint(0, 200)
                parts.append(b[a : a + rng.randint(50, 250)] + text(rng, rng.randint(0, 30)))
            t = "".join(parts)
        elif k < 0.8:
            t = "ab" * rng.randint(0, 300)
        elif k < 0.85:
            t = "a" * rng.randint(90, 300)
        else:
            t = text(rng, rng.randint(0, 150))
        rows.append((i * 7 % 61, t))
    return rows


def ordered(rows):
    """Rows by id, null last, those with the same id as they are read."""
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))


def brute_repeats(rows, length):
    seen, out = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        mark = [0] * len(b)
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if s in seen:
                mark[p : p + length] = [1] * length
            seen.add(s)
        spans = sum(1 for p in range(len(b)) if mark[p] and (p == 0 or not mark[p - 1]))
        kept = bytes(x for x, m in zip(b, mark) if not m)
        out.setdefault(i, []).append((len(b), sum(mark), spans, hashlib.sha256(kept).hexdigest()))
    return {i: sorted(x) for i, x in out.items()}


def run_repeats(df, **kw):
    out = {}
    for r in repeats.remove_repeats(df, **kw).collect():
        out.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    return {i: sorted(x) for i, x in out.items()}


@pytest.mark.parametrize("crowded,most,length,gram", [(64, 4096, 100, 40), (1, 4096, 100, 40), (64, 1, 100, 40), (2, 3, 30, 9), (64, 4096, 8, 8), (64, 4096, 13, 5)])
def test_repeats_equal_brute_force(spark, monkeypatch, crowded, most, length, gram):
    """By suffix arrays, and where phrases crowd by hashes."""
    monkeypatch.setattr(repeats, "CROWDED", crowded)
    monkeypatch.setattr(repeats, "MOST", most)
    rows = [*corpus(), (100, None), (101, ""), (7, "x" * 99), (7, "ab" * 80), (7, "ab" * 90 + "c"), (102, "é" * 120)]
    rows += [(None, t[10:] + "q") for _, t in corpus()[:12]]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id as chunk", "text as id", "'x' as row")
    assert run_repeats(df, length=length, gram=gram) == brute_repeats(ordered(rows), length)


@pytest.mark.parametrize("length", [1, 7, 8, 20, 100])
def test_suffix_order(length):
    rng = np.random.default_rng(length)
    data = rng.integers(97, 99, 3000, dtype=np.uint8)
    data[500:900] = data[1500:1900]
    start = rng.permutation(len(data) - length + 1)[:2000]
    order, group = repeats.suffix_order(data, start, length)
    raw = data.tobytes()
    found = [raw[s : s + length] for s in start[order].tolist()]
    assert found == sorted(found)
    assert [a == b for a, b in zip(found, found[1:])] == (group[1:] == group[:-1]).tolist()
    assert len(repeats.suffix_order(data, start[:0], length)[0]) == 0


def test_chunks(spark, monkeypatch):
    """Chunks are bounded whatever the ids are, keep all rows, and lie evenly."""
    monkeypatch.setattr(X, "CHUNK_BYTES", 3000)
    df = spark.createDataFrame([(None, f"t{i}" * 20) for i in range(3000)] + [(1, "x" * 9000)], "doc_id long, text string").repartition(5)
    rows = X.chunked(df, 8, id=F.col("doc_id"), text=F.col("text")).withColumn("p", F.spark_partition_id()).collect()
    tables = [X._opened(pa.table({"to": [r.to], "number": [r.number], "body": [bytes(r.body)]}))[1] for r in rows]
    assert len({r.to for r in rows}) == len(rows) and sum(t.num_rows for t in tables) == 3001
    assert sorted(sum(len(x) for x in t["text"].to_pylist()) > 3000 for t in tables)[-2:] == [False, True]
    most = Counter(r.p for r in rows)
    assert len(most) == 8 and max(most.values()) <= len(rows) / 8 + 5


def test_repeats_edge_tables(spark):
    assert run_repeats(spark.createDataFrame([], "doc_id long, text string")) == {}
    same = [(3, "q" * 150), (3, "q" * 150), (None, "q" * 150)]
    got = run_repeats(spark.createDataFrame(same, "doc_id long, text string"))
    assert [x[1] for x in got[3]] == [51 + 49 + 49 + 1 - 1, 150] or sum(x[1] for x in got[3]) > 150
    assert got[None][0][1] == 150


def test_repeats_ignores_partitioning(spark):
    df = spark.createDataFrame(corpus(9), "doc_id long, text string")
    assert run_repeats(df.repartition(1)) == run_repeats(df.repartition(7))


def brute_lm(rows, order, mu):
    words = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})), "</s>"]) for i, t in rows]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in words}
    grams = [Counter() for _ in range(order + 1)]
    for i, ws in words:
        if not held[i]:
            seq = ["</s>", *ws]
            for k in range(1, order + 1):
                for p in range(1 if k == 1 else k - 1, len(seq)):
                    grams[k][tuple(seq[p - k + 1 : p + 1])] += 1
    n, v = sum(grams[1].values()), len(grams[1])
    out = {}
    for i, ws in words:
        seq, base, score = ["</s>", *ws], 0.0, 0.0
        for p in range(1, len(seq)):
            q = (grams[1][(seq[p],)] + 1) / (n + v + 1)
            base += math.log10(q)
            for k in range(2, order + 1):
                if p >= k - 1:
                    g = tuple(seq[p - k + 1 : p + 1])
                    h = grams[k - 1][g[:-1]]
                    if h >= (1 if k == 2 else lm.STATE):
                        m = mu[min(k - 2, len(mu) - 1)]
                        q = (grams[k][g] + m * q) / (h + m)
            score += math.log10(q)
        out[i] = (held[i], len(ws), sum(grams[1][(w,)] > 0 for w in ws), n, base, score)
    return out


def lm_rows(seed=2, n=50):
    rng = random.Random(seed)
    rows = [(i, "".join(rng.choice(["a ", "B ", "cc\n", "d  ", "É ", "zz ", f"q{rng.randrange(40)} "]) for _ in range(rng.randint(0, 30)))) for i in range(n)]
    long = "".join(rng.choice(["a ", "b ", "cc ", "once "]) for _ in range(700))
    return [*rows, (900, None), (901, ""), (902, "only here"), (903, long), (904, long), (905, long + "x")]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_equal_brute_force(spark, order):
    rows = lm_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as held", "text as score")
    want = brute_lm(rows, order, (3.0, 0.5))
    got = {r.doc_id: tuple(r)[1:] for r in lm.score_texts(df, order=order, mu=(3.0, 0.5)).collect()}
    assert got.keys() == want.keys()
    for i, w in want.items():
        assert got[i][:4] == w[:4]
        assert got[i][4:] == pytest.approx(w[4:], rel=1e-9)


def built(rows, order, mu):
    """(automaton, tokens, offsets) of a small corpus in one piece."""
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    table = pa.table({"text": [t for _, t in rows], "held": held})
    tokens, first = lm._tokens(table)
    seen = lm._seen(table, first)
    grams = [lm._distinct(tokens, first, seen, k) for k in range(1, order + 1)]
    counts = [g.training for g in grams]
    totals = np.array([counts[0].sum(), (counts[0] > 0).sum()])
    return lm.Automaton.build(tokens, grams, counts, totals, mu), tokens, first


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_automaton(order):
    """The traversal gives the model's probability however texts are cut into runs, and what leaves a
    state adds up to one."""
    rows = lm_rows(order)
    model, tokens, first = built(rows, order, (2.0, 1.0))
    want = brute_lm(rows, order, (2.0, 1.0))
    for run in (1, 5, 64, 10**6):
        assert model.traverse(tokens, first, order, run) == pytest.approx([want[i][5] for i, _ in rows])
    vocabulary = np.append(np.unique(tokens), lm.B.U64(12345))
    known = {t for i, t in enumerate(tokens.tolist()) if i not in set(first.tolist())}
    in_training = [i for i, (d, _) in enumerate(rows) if not want[d][0]]
    trained = {t for i in in_training for t in tokens[first[i] + 1 : first[i + 1]].tolist()}
    assert trained < known
    for state in range(len(model.failure)):
        use = np.array([t for t in vocabulary.tolist() if t in trained] + [12345], np.uint64)
        _, met = model.step(np.full(len(use), state), use)
        assert (10**met).sum() == pytest.approx(1)


def test_key_steps():
    rng = np.random.default_rng(1)
    for keys in (rng.integers(0, 1 << 63, 5000, dtype=np.uint64), rng.integers(0, 1 << 63, 3, dtype=np.uint64), np.zeros(0, np.uint64), np.zeros(1, np.uint64), np.array([7, 7, 7], np.uint64)):
        keys.sort()
        thin = X.thin(keys)
        assert np.array_equal(X.thick(*X.unpack(X.pack(*thin))), keys)


def test_scores_without_training_rows(spark):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    rows = lm.score_texts(spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")).collect()
    assert all(r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in rows)
    assert lm.score_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
