import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import _components, jaccard


def corpus(seed=6, n=420):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 12, 20, 40, 80, 150, 300]))] for _ in range(40)]
    rows = []
    for i in range(n):
        b = list(rng.choice(base[:12] if i % 2 else base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            k = rng.randrange(max(len(b), 1))
            if rng.random() < 0.5 and b:
                b[k] = rng.choice(vocabulary)
            elif rng.random() < 0.5:
                b.insert(k, rng.choice(vocabulary))
            elif b:
                b.pop(k)
        rows.append((i * 13 % 997, " ".join(b)))
    return [*rows, (2000, None), (2001, ""), (2002, " \n "), (2003, "A b"), (2004, "a  B")]


def brute(rows, percent=90):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    ids = sorted(sets)
    parent, degree = {i: i for i in ids}, dict.fromkeys(ids, 0)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            x, y = sets[i], sets[j]
            same = len(x & y)
            if x and y and 100 * same >= percent * (len(x) + len(y) - same):
                degree[i] += 1
                degree[j] += 1
                u, v = find(i), find(j)
                parent[max(u, v)] = min(u, v)
    return {i: (len(sets[i]), degree[i], find(i)) for i in ids}


def run(df, **kw):
    return {r.doc_id: tuple(r)[1:] for r in jaccard.similar(df, **kw).collect()}


@pytest.mark.parametrize("limit,one_task,percent", [(1024, 10**6, 90), (6, 0, 90), (6, 10**6, 70)])
def test_join_equals_brute_force(spark, monkeypatch, limit, one_task, percent):
    """Also with regions so small that they are split by pivots and blocks, and components by tables."""
    monkeypatch.setattr(_components.components, "__defaults__", (one_task,))
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "text as id", "'x' as region")
    assert run(df, limit=limit, percent=percent) == brute(rows, percent)


def test_one_dense_region(spark):
    """Near copies of one text, all near each other: pivots can't split them, blocks do."""
    rng = random.Random(1)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):
        b = list(base)
        b[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(b)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(df, limit=8) == brute(rows)


def test_edge_tables(spark):
    assert run(spark.createDataFrame([], "doc_id long, text string")) == {}
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A  b c d\te f")]
    got = jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_similar, r.component_id) for r in got) == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]


def test_keep_one(spark):
    rows = corpus(n=100)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id * 2 as more")
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, x in brute(rows).items() if x[2] == i)


NEAR = " ".join(f"n{i}" for i in range(60))
OTHER = " ".join(f"o{i}" for i in range(60))


def test_keep_one_goes_by_row(spark):
    """Repeated ids, repeated rows and null ids: exactly one row of each component stays."""
    rows = [(3, NEAR, "a"), (5, NEAR + " x", "b"), (5, OTHER, "c"), (7, "k l m n o p", "d"), (7, "k l m n o p", "d"), (7, "k l m n o p", "e"),
            (None, "q r s t u v w", "f"), (None, "Q r s t u v w", "g"), (None, OTHER + " y", "h"), (9, None, "i"), (9, None, "i"), (None, " ", "j")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(3)
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    got = [tuple(r) for r in kept.collect()]
    assert sorted(x[2][0].replace("e", "d").replace("g", "f") for x in got) == ["a", "c", "d", "f", "i", "i", "j"]
    assert set(got) <= set(rows)


def test_regions_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "REGION_BYTES", 2000)
    rows = corpus(11, 150)
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_text_ids_and_clashing_columns(spark):
    rows = [("b", NEAR, 1), ("a", NEAR + " x", 2), ("c", OTHER, 3), (None, "", 4)]
    df = spark.createDataFrame(rows, "doc_id string, text string, gone_ int").withColumn("gone", F.lit(1)).withColumn("row_", F.lit("r"))
    assert run(df) == {"a": (57, 1, "a"), "b": (56, 1, "a"), "c": (56, 0, "c"), None: (0, 0, None)}
    assert sorted(r.gone_ for r in jaccard.keep_one(df).collect()) == [2, 3, 4] and jaccard.keep_one(df).columns == df.columns


@pytest.mark.parametrize("limit", [1024, 2])
def test_null_and_repeated_ids_link(spark, limit):
    rows = [(None, NEAR), (None, NEAR + " x"), (4, NEAR + " y"), (5, OTHER), (5, "k l m n o p"), (6, "K l m n o p"), (8, OTHER + " z"), (None, "u v w"), (None, "U v w")]
    got = jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string"), limit=limit).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[3] or 0)
    want = [(None, 56, 2, 4), (None, 57, 2, 4), (4, 57, 2, 4), (5, 56, 1, 5), (5, 2, 1, 5), (6, 2, 1, 5), (8, 57, 1, 5), (None, 1, 1, None), (None, 1, 1, None)]
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_cells_never_lose_a_link():
    """Sets that link share a cell, for many sizes and distances."""
    rng = np.random.default_rng(4)
    for _ in range(3000):
        n = int(rng.integers(9, 400))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        d = int(rng.integers(0, len(a) // 9 + 1))
        b = np.setdiff1d(a, rng.choice(a, int(rng.integers(0, d + 1)), replace=False))
        b = np.union1d(b, rng.integers(0, 1 << 63, d - (len(a) - len(b)) if d > len(a) - len(b) else 0, dtype=np.uint64))
        same = len(np.intersect1d(a, b))
        if len(a) != len(b) or same < len(a):
            if 100 * same >= 90 * (len(a) + len(b) - same):
                assert np.intersect1d(jaccard.cells(a, 90), jaccard.cells(b, 90)).size


@pytest.mark.parametrize("one_task", [10**6, 0])
def test_components(spark, one_task):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        u, v = find(a), find(b)
        parent[max(u, v)] = min(u, v)
    got = {r.node: r.root for r in _components.components(spark.createDataFrame(edges, "a long, b long"), one_task).collect()}
    want = {x: find(x) for x in list(parent)}
    assert {x: r for x, r in got.items()} == {x: r for x, r in want.items() if x in got}
    assert {x for x in want if want[x] != x} <= set(got)


def families(seed, n, texts=3, length=120, edits=(0, 1, 2, 4, 7, 10), chained=0.4):
    """Copies of a few texts with some words changed, many of them copies of copies."""
    rng = random.Random(seed)
    made = [[f"f{t}x{i}" for i in range(length + 7 * t)] for t in range(texts)]
    for i in range(n):
        b = list(rng.choice(made) if rng.random() < chained else made[rng.randrange(texts)])
        for _ in range(rng.choice(edits)):
            b[rng.randrange(len(b))] = rng.choice(["q", "r", f"s{i}"])
        made.append(b)
    return [(i, " ".join(b)) for i, b in enumerate(made)]


def no_replicas(*args):
    raise AssertionError("replicated")


def test_dense_groups_are_not_replicated(spark, monkeypatch):
    """A group of more than LIMIT near copies of one text is one region, held by differences."""
    monkeypatch.setattr(jaccard, "_split", no_replicas)
    rng = random.Random(2)
    rows = []
    for i in range(jaccard.LIMIT + 44):
        b = [f"w{k}" for k in range(200)]
        for _ in range(rng.choice([1, 1, 2, 3, 4])):
            b[rng.randrange(200)] = rng.choice(["x", f"y{i}"])
        rows.append((i, " ".join(b)))
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


@pytest.mark.parametrize("room", [3000, 40000])
def test_differences_in_pivot_cells_and_blocks(spark, monkeypatch, room):
    """Regions whose differences don't fit either are split by pivots, or into blocks if all are near."""
    monkeypatch.setattr(jaccard, "REGION_BYTES", room)
    rows = families(5, 250)
    assert run(spark.createDataFrame(rows, "doc_id long, text string"), limit=20) == brute(rows)


@pytest.mark.parametrize("direct", [1000, -(10**9)])
@pytest.mark.parametrize("percent", [50, 75, 90, 100])
def test_links_from_differences(monkeypatch, percent, direct):
    """Whatever the centre: links counted by scores and links listed are those of brute force."""
    monkeypatch.setattr(jaccard, "_DIRECT", direct)
    rng = np.random.default_rng(percent)
    for k in range(40):
        base = rng.integers(0, 1 << 63, int(rng.integers(5, 120)), dtype=np.uint64)
        other = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
        sets, seen = [], set()
        for _ in range(int(rng.integers(2, 60))):
            s = base[rng.random(len(base)) > rng.choice([0, 0.02, 0.1, 0.5])]
            s = np.unique(np.concatenate((s, rng.choice(other, int(rng.integers(0, 9))))))
            if len(s) and s.tobytes() not in seen:
                seen.add(s.tobytes()), sets.append(s)
        copies = rng.integers(1, 4, len(sets))
        more, parent = np.zeros(len(sets), int), list(range(len(sets)))
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                same = len(np.intersect1d(a, b))
                if 100 * same >= percent * (len(a) + len(b) - same):
                    more[i] += copies[j]
                    more[j] += copies[i]
                    old, new = max(parent[i], parent[j]), min(parent[i], parent[j])
                    parent = [new if p == old else p for p in parent]
        for centre in (base[:0], np.unique(base), other[:0] if k % 2 else np.unique(np.concatenate((base[:30], other[:5])))):
            rest = [np.setxor1d(s, centre).tobytes() for s in sets]
            table = jaccard.pa.table({"node": list(range(len(sets))), "copies": copies, "size": [len(s) for s in sets], "set": rest,
                                      "homes": [[]] * len(sets), "at": [[]] * len(sets)})
            got = {r["node"]: (r["more"], r["root"]) for r in jaccard._verify(percent)((), table).to_pylist()}
            assert got == {i: (m, parent[i]) for i, m in enumerate(more.tolist()) if m}
