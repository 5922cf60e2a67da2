import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.functions.merge import LONG, PairTable, merge_all, merge_heap, merge_loop


def table(rows):
    cols = np.array(rows, np.int64).reshape(-1, 3)
    return PairTable(cols[:, 0], cols[:, 1], np.arange(len(cols)), cols[:, 2])


def brute(symbols, pairs):
    symbols = list(symbols)
    while True:
        ranks = [(pairs[p][0], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in pairs]
        if not ranks:
            return symbols
        rank, i = min(ranks)
        symbols[i : i + 2] = [pairs[symbols[i], symbols[i + 1]][1]]


@pytest.mark.parametrize("seed", range(120))
def test_random_tables(seed):
    """Random, mostly non-monotonic merge tables: all mergers equal the definition."""
    rng = random.Random(seed)
    base = rng.randint(4, 40)
    symbols, rows = base, []
    for _ in range(rng.randint(10, 200)):
        rows.append((rng.randrange(symbols), rng.randrange(symbols), symbols if rng.random() < 0.7 else rng.randrange(symbols)))
        symbols += 1
    t = table(rows)
    pairs = t.lookup()
    chunks = [[rng.randrange(base) for _ in range(rng.choice([0, 1, 2, 5, 30, 90, LONG, LONG + 1, 400]))] for _ in range(12)]
    want = [brute(c, pairs) for c in chunks]
    assert [merge_loop(c, pairs) for c in chunks[:6]] == want[:6]
    assert [merge_heap(c, pairs) for c in chunks] == want
    flat = np.array([x for c in chunks for x in c], np.int64)
    ids, first = merge_all(flat, np.concatenate(([0], np.cumsum([len(c) for c in chunks]))), t)
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == want


@pytest.mark.parametrize("inverted", [True, False])
@pytest.mark.parametrize("n", [1000, 257, 100, 62, 50, 32, 31, 30, 2, 1])
def test_runs_of_one_letter(inverted, n):
    """A vocabulary of runs a..a(31), each the last one plus a letter, in rank order or against it."""
    rows = [(size - 2, 0, size - 1) for size in range(2, 32)]
    if inverted:
        rows = rows[:1] + rows[:0:-1]
    t = table(rows)
    want = brute([0] * n, t.lookup())
    assert merge_heap([0] * n, t.lookup()) == want
    ids, _ = merge_all(np.zeros(n, np.int64), np.array([0, n]), t)
    assert ids.tolist() == want


def test_first_of_two_equal_pairs_counts():
    t = table([(0, 1, 5), (0, 1, 6), (0, 0, 7)])
    assert merge_all(np.array([0, 1]), np.array([0, 2]), t)[0].tolist() == [5]
    assert t.lookup()[0, 1] == (0, 5)
    assert t.find(np.array([0, 0, 1, -1]), np.array([1, 0, 1, 0])).tolist() == [0, 2, -1, -1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=40), max_size=8))
def test_batch_equals_loop(chunks):
    t = table([(0, 0, 4), (1, 2, 5), (4, 4, 6), (5, 3, 7), (2, 2, 8), (0, 1, 9)])
    first = np.concatenate(([0], np.cumsum([len(c) for c in chunks]))).astype(np.int64)
    ids, first = merge_all(np.array([x for c in chunks for x in c], np.int64), first, t)
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [merge_loop(c, t.lookup()) for c in chunks]
