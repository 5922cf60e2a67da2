"""Exact Jaccard join of documents by their word n-grams.

Two documents link when 100 |A & B| >= percent |A | B|, that is, when their Jaccard distance is at
most r = 1 - percent / 100.  Documents with the same set are one node with a count.  The join runs on
the metric in three steps, none of which loses a link:

1. *Cells.*  Almost all distances are 1, where pivots that are documents can't tell anything apart;
   the first pivots are therefore sets of n-grams.  In a class of similar sizes the n-gram space is
   cut into m parts by hash.  The parts of a document differ from those of another in no more than
   D = |A ^ B| places, and links have D <= K for a K that follows from the size, so of
   m = K + 1 + spare parts at least spare + 1 agree: nodes meet in the cell of an agreeing part.
   A document near the lower end of its class is replicated into the class below, as far as the
   triangle inequality on sizes (|A| >= (1 - r) |B|) asks.  Documents with more than ``spare`` empty
   parts meet in a cell of their own.  A cell sends one edge a node, to its smallest node.
2. *Regions.*  The components of these edges are the regions.  In a region of more than ``limit`` nodes,
   or ``REGION_BYTES`` of their sets, each set is replaced by its differences from a centre, which holds
   what most of a few sets of the region hold; |A ^ B| follows from the differences exactly, whatever
   the centre.  If they still take more than ``REGION_BYTES``, the region is split: some of its
   documents become pivots, every document belongs to its nearest pivot p (its Voronoi cell) and is
   replicated to every pivot q with d(x, q) <= d(x, p) + 2 r, which by the triangle inequality are all
   cells in which a partner can be at home.  Cells are split again while that makes them smaller; a
   region of documents that are all near its centre is cut into pairs of blocks instead.
3. *Verification* in each region finds all links of its nodes exactly: those that sizes and numbers of
   differences decide alone are counted, not listed; the others share differences, and are looked for
   under the rarest ones.  It sends, for each node, the number of linked documents and the root of its
   links, never the pairs.

Words are lower-cased runs of ``[^\\x20\\x09-\\x0D]``; a document of fewer than n words has its whole
sequence as one n-gram.  Null, empty and blank documents have no set and link with nothing.  Sets are
compared by 64-bit n-gram hashes, and told apart by a 64-bit hash of the set.  Every row is a document
of its own, also where ids repeat or are null: the join runs on keys of sets and 64-bit hashes of rows,
never on ids.  A component is named by its smallest id, null if it has none but null ones; which of several equally near
pivots is home changes no result.  Texts are taken whole, and one text's set lies in one task.  Empty
tables give empty results; other columns are ignored by ``similar`` and handed on by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm import _blocks as B
from sparkloom.llm import _exchange as X
from sparkloom.llm import _map
from sparkloom.llm._components import components, ensure_checkpoint_dir

GRAM = 5
PERCENT = 90
#: Nodes of a region, and bytes of their sets, beyond which a centre is taken for it; bytes beyond which it is split.
LIMIT = 256
REGION_BYTES = 64 << 20
#: Sets, and bytes of sets, from which a region's centre is taken.
CENTRE_SETS = 64
CENTRE_BYTES = 32 << 20
PIVOTS = 8
LEVELS = 4
_FLUSH = 2_000_000
_SEEN = 500_000
_BLOCKS = 1 << 15
#: Entries that are counted outright rather than candidates looked for first.
_DIRECT = 1000


def shingle_sets(block: B.Block, gram: int = GRAM) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each row."""
    data, w = B.words(block, B.NONSPACE)
    h = B.hash_spans(data, w.start, w.end, 31)
    s = B.chain(h, gram)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= gram:
            out.append(B.uniq(s[a : b - gram + 1]))
        elif b > a:
            out.append(B.chain(h[a:b], b - a) ^ B.U64(B.mix_int(77 + b - a)))
        else:
            out.append(h[:0])
    return out


def set_key(s: np.ndarray) -> int:
    """Signed 64-bit key of a set."""
    key = (int(s.sum(dtype=B.U64)) * 0x9E3779B97F4A7C15 + int(np.bitwise_xor.reduce(s)) + len(s)) & (2**64 - 1)
    key = B.mix_int(key)
    return key - (1 << 64) if key >> 63 else key


@lru_cache(maxsize=None)
def size_class(size: int, percent: int) -> tuple[int, int, int]:
    """(first size, last size, number of the class of a set size); classes widen by about a half."""
    lo, k = 1, 0
    while True:
        hi = max(lo, lo * 3 // 2)
        if size <= hi:
            return lo, hi, k
        lo, k = hi + 1, k + 1


@lru_cache(maxsize=None)
def plan(size: int, percent: int) -> tuple[tuple[int, int, int], ...]:
    """(class, parts, spare) of every class in which a set of that size meets partners.

    A pair meets in the class of its smaller size a.  Links have |A ^ B| <= a (100 - p) / p.
    """
    out = []
    lo, hi, k = size_class(size, percent)
    least = -(-percent * size // 100)  # sizes of partners are at least this
    while True:
        most = hi * (100 - percent) // percent
        if most:  # else only equal sets link
            spare = max(2, int(np.ceil(3 * (most + 3) * np.exp(-lo / (most + 3)) + 2)))
            out.append((k, most + 1 + spare, spare))
        if lo <= least or lo == 1:
            return tuple(out)
        lo, hi, k = size_class(lo - 1, percent)


def cells(s: np.ndarray, percent: int) -> np.ndarray:
    """Keys of all cells of a set."""
    out = []
    for k, parts, spare in plan(len(s), percent):
        seed = B.U64(B.mix_int(1_000_003 * k + 5))
        at = ((B.mix(s ^ seed) >> B.U64(32)) * B.U64(parts)) >> B.U64(32)
        at = at.astype(np.int64)
        order = np.argsort(at, kind="stable")
        sorted_at = at[order]
        new = np.flatnonzero(np.concatenate(([True], sorted_at[1:] != sorted_at[:-1])))
        total = np.add.reduceat(B.mix(s[order] * B.U64(0xD1342543DE82EF95) + seed), new)
        out.append(B.mix(total + B.mix(sorted_at[new].astype(B.U64) + seed)))
        if parts - len(new) > spare:
            out.append(B.mix(np.array([k], B.U64) + B.U64(0x656D707479)))
    return np.concatenate(out) if out else s[:0]


def _sets(docs: DataFrame, gram: int) -> DataFrame:
    """(id, row, n_shingles, key): key is null for documents without words."""

    def measure(block: B.Block) -> dict:
        sets = shingle_sets(block, gram)
        return {"n_shingles": [len(s) for s in sets], "key": [set_key(s) if len(s) else None for s in sets]}

    return _map.measured(docs, "id", "text", "n_shingles long, key long", measure, also=("row",))


def _cell_messages(docs: DataFrame, n: int, gram: int, percent: int) -> DataFrame:
    """Cells of all sets by key range; equal sets of a task are sent once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        keys, nodes, sizes, held = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held
            if keys:
                k = np.concatenate(keys)
                at = np.argsort(k)
                node = np.repeat(np.array(nodes, np.int64), [len(x) for x in keys])[at]
                size = np.repeat(np.array(sizes, np.int32), [len(x) for x in keys])[at]
                k = k[at]
                cut = X.slices(k, n)
                rows = []
                for d in range(n):
                    own = slice(cut[d], cut[d + 1])
                    rows.append((d, 0, 0, X.pack(k[own], node[own], size[own])))
                yield from X.messages(rows, n).to_batches()
            keys.clear(), nodes.clear(), sizes.clear()
            held = 0

        for batch in batches:
            for block in B.blocks(batch.column(0)):
                for s in shingle_sets(block, gram):
                    if len(s) == 0:
                        continue
                    key = set_key(s)
                    if key in seen:
                        continue
                    if len(seen) < _SEEN:
                        seen.add(key)
                    own = cells(s, percent)
                    keys.append(own), nodes.append(key), sizes.append(len(s))
                    held += len(own)
                if held > _FLUSH:
                    yield from flush()
        yield from flush()

    return docs.select("text").mapInArrow(run, X.MESSAGE)


def _edges(messages: DataFrame, percent: int) -> DataFrame:
    """(a, b): in every cell of two or more nodes, each node with the cell's smallest one."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        got = [X.unpack(b.as_py()) for b in table["body"]]
        cell, node, size = (np.concatenate(x) for x in zip(*got))
        at = np.lexsort((node, cell))
        cell, node, size = cell[at], node[at], size[at]
        keep = np.concatenate(([True], (cell[1:] != cell[:-1]) | (node[1:] != node[:-1]))) if len(cell) else np.zeros(0, bool)
        cell, node, size = cell[keep], node[keep], size[keep]
        # Sizes that can't link to any other of the cell drop out: in size order, both neighbours are
        # too far off.
        at = np.lexsort((size, cell))
        cell, node, size = cell[at], node[at], size[at].astype(np.int64)
        far = np.ones(len(cell) + 1, bool)
        far[1:-1] = (cell[1:] != cell[:-1]) | (100 * size[:-1] < percent * size[1:])
        group = np.cumsum(far[:-1])
        alone = far[:-1] & far[1:]
        group, node = group[~alone], node[~alone]
        a = b = np.zeros(0, np.int64)
        if len(group):
            new = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            least = np.repeat(np.minimum.reduceat(node, new), np.diff(np.append(new, len(group))))
            pair = np.stack((node, least), 1)[node != least]
            if len(pair):
                at = np.lexsort((pair[:, 1], pair[:, 0]))
                pair = pair[at]
                pair = pair[np.concatenate(([True], (pair[1:] != pair[:-1]).any(1)))]
                a, b = pair[:, 0], pair[:, 1]
        return pa.table([pa.array(a), pa.array(b)], names=["a", "b"])

    return messages.groupBy("to").applyInArrow(run, "a long, b long")


def _distance(x: np.ndarray, y: np.ndarray) -> float:
    same = len(np.intersect1d(x, y, assume_unique=True))
    return 1 - same / max(len(x) + len(y) - same, 1)


def _centred(chosen: DataFrame) -> DataFrame:
    """Members of large regions (with their region's ``n`` and ``bytes``), their sets replaced by what
    these differ in from the region's centre: the n-grams that most of a few sets hold."""
    thin = F.greatest(F.lit(1), (F.col("n") / CENTRE_SETS).cast("long"), (F.col("bytes") / CENTRE_BYTES).cast("long"))
    some = chosen.where(F.pmod(F.xxhash64("node", "region"), thin) == 0).select("region", "set")

    def centre(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        gram, times = np.unique(np.concatenate([np.frombuffer(b.as_py(), B.U64) for b in table["set"]]), return_counts=True)
        most = gram[2 * times > table.num_rows]
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([most.tobytes()], pa.binary())], names=["region", "centre"])

    centres = some.groupBy("region").applyInArrow(centre, "region long, centre binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                rest = np.setxor1d(np.frombuffer(row["set"], B.U64), np.frombuffer(row["centre"] or b"", B.U64), assume_unique=True)
                out.append((row["region"], row["node"], row["copies"], row["size"], rest.tobytes(), row["homes"], row["at"]))
            yield _members(out)

    return chosen.drop("n", "bytes").join(centres, "region", "left").mapInArrow(run, MEMBERS)


def _split(chosen: DataFrame, percent: int) -> DataFrame:
    """Voronoi cells of large regions, with replicas; every member's home at this level is added."""
    # Candidates for pivots are thinned by hash before they are ranked, whatever the region's size.
    some = chosen.where(F.pmod(F.xxhash64("node", "region"), F.greatest(F.lit(1), (F.col("n") / (8 * PIVOTS)).cast("int"))) == 0)
    pivots = some.groupBy("region").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.xxhash64("node").alias("h"), "set"))), 1, PIVOTS).getField("set").alias("pivots"))
    joined = chosen.drop("n", "bytes").join(pivots, "region", "left")
    r = 1 - percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                own = np.frombuffer(row["set"], B.U64)
                pivots = [np.frombuffer(p, B.U64) for p in row["pivots"] or []]
                d = [_distance(own, p) for p in pivots] or [0.0]
                home = int(np.argmin(d))
                # A pair counts in the first of its two homes, so cells after one's home need no replica.
                for q, x in enumerate(d[: home + 1]):
                    if x <= d[home] + 2 * r + 1e-9:
                        region = _child(row["region"], q)
                        out.append((region, row["node"], row["copies"], row["size"], row["set"], row["homes"] + [home], row["at"] + [q]))
            yield _members(out)

    return joined.mapInArrow(run, MEMBERS)


def _blocked(chosen: DataFrame, room: int) -> DataFrame:
    """Pairs of blocks of regions that hold ``left`` bytes: each node goes to all pairs that hold its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                blocks = min(-(-2 * row["left"] // room), _BLOCKS - 1)
                home = B.mix_int(row["node"]) % blocks
                out = []
                for other in range(blocks):
                    # The region of blocks i <= j counts the pairs between them, or, if i = j, in one.
                    # A negative home marks a level of blocks.
                    pair = min(home, other) * _BLOCKS + max(home, other)
                    region = _child(row["region"], pair)
                    out.append((region, row["node"], row["copies"], row["size"], row["set"], row["homes"] + [-1 - home], row["at"] + [pair]))
                yield _members(out)

    return chosen.mapInArrow(run, MEMBERS)


MEMBERS = "region long, node long, copies long, size long, set binary, homes array<int>, at array<int>"


def _child(region: int, q: int) -> int:
    key = B.mix_int((region * 0x9E3779B97F4A7C15 + q + 1) & (2**64 - 1))
    return key - (1 << 64) if key >> 63 else key


def _members(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32())]
    names = ["region", "node", "copies", "size", "set", "homes", "at"]
    cols = list(zip(*rows)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=names)


def scores(held: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """(scores, gain): sets of these sizes, which differ from a centre in ``held`` n-grams, link when
    score + score + gain * c >= 0, where c of those n-grams are the same for both.

    For |A ^ B| = held + held - 2 c, whatever the centre is, and 100 |A & B| >= percent |A | B| is
    (100 - percent) (|A| + |B|) >= (100 + percent) |A ^ B|.
    """
    return (100 - percent) * size - (100 + percent) * held, 2 * (100 + percent)


def linked(sets: list[np.ndarray], size: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, indexes j > i that link with i, but not by their two scores alone); sets are differences from
    a common centre, which may be empty."""
    n = len(sets)
    held = np.array([len(s) for s in sets], np.int64)
    score, gain = scores(held, size, percent)
    if n < 2 or not held.sum():
        return
    # Of what sizes allow as partners, the largest score tells how many n-grams have to be the same at
    # least, and the smallest whether any pair isn't decided by scores.
    sizes, at = np.unique(size, return_inverse=True)
    high, low = np.full(len(sizes), np.iinfo(np.int64).min), np.full(len(sizes), np.iinfo(np.int64).max)
    np.maximum.at(high, at, score)
    np.minimum.at(low, at, score)
    first = np.searchsorted(sizes, -(-percent * sizes // 100))
    last = np.searchsorted(sizes, 100 * sizes // percent, "right")
    top = np.array([high[a:b].max() for a, b in zip(first.tolist(), last.tolist())])[at]
    bottom = np.array([low[a:b].min() for a, b in zip(first.tolist(), last.tolist())])[at]
    need = np.maximum(1, -((score + top) // gain))
    asks = np.where(score + bottom < 0, np.maximum(held - need + 1, 0), 0)
    # N-grams by rarity: two sets of which t n-grams are the same share one of their rarest |.| - t + 1.
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), held)
    _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(times), np.int64)
    rank[np.argsort(times, kind="stable")] = np.arange(len(times))
    code = rank[code]
    by = np.lexsort((code, owner))
    code, bounds = code[by], np.concatenate(([0], np.cumsum(held)))
    early = np.arange(len(code)) - np.repeat(bounds[:-1], held) < np.repeat(asks, held)
    whole, rare = _postings(code, owner, np.arange(len(code))), _postings(code, owner, np.flatnonzero(early))
    mark = np.zeros(len(times), bool)
    for i in np.flatnonzero(asks).tolist():
        a, b = bounds[i], bounds[i + 1]
        own = rare[1][a : a + asks[i]], rare[2][a : a + asks[i]]
        cost = int(own[1].sum())
        if cost == 0:
            continue
        if int(whole[2][a:b].sum()) <= 4 * cost + _DIRECT:
            j, same = _times(whole[0][B.ranges(whole[1][a:b], whole[2][a:b])], n)
            sums = score[i] + score[j]
        else:
            j, _ = _times(rare[0][B.ranges(*own)], n)
            sums = score[i] + score[j]
            able = (sums < 0) & (sums + gain * np.minimum(held[i], held[j]) >= 0)
            j, sums = j[able], sums[able]
            mark[code[a:b]] = True
            parts = []
            for part in np.split(j, np.flatnonzero(np.diff(np.cumsum(held[j]) // _FLUSH)) + 1) if len(j) else []:
                hit = np.concatenate(([0], np.cumsum(mark[code[B.ranges(bounds[part], held[part])]])))
                end = np.cumsum(held[part])
                parts.append(hit[end] - hit[end - held[part]])
            same = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            mark[code[a:b]] = False
        j = j[(sums < 0) & (sums + gain * same >= 0)]
        if len(j):
            yield i, j


def _postings(code: np.ndarray, owner: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owners by code, and for every entry where its code's later owners start, and how many)."""
    by = entry[np.argsort(code[entry], kind="stable")]
    end = np.searchsorted(code[by], code[by], "right")
    start, count = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
    start[by] = np.arange(1, len(by) + 1)
    count[by] = end - start[by]
    return owner[by], start, count


def _times(values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values below n, and how often they occur."""
    if 8 * len(values) < n:
        return np.unique(values, return_counts=True)
    count = np.bincount(values, minlength=n)
    found = np.flatnonzero(count)
    return found, count[found]


def _counted(homes: np.ndarray, at: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(group of every member, which groups' pairs count in this region): members of the same homes, as
    far as they matter, are a group; a pair counts in one region alone."""
    sides = np.zeros(homes.shape, np.int64)
    for level, q in enumerate(at):
        home = homes[:, level]
        if home[0] < 0:  # a level of blocks
            sides[:, level] = -1 - home
        else:
            sides[:, level] = np.sign(home - q)
    kinds, group = np.unique(sides, axis=0, return_inverse=True)
    ok = np.ones((len(kinds), len(kinds)), bool)
    for level, q in enumerate(at):
        a, b = kinds[:, None, level], kinds[None, :, level]
        if homes[0, level] < 0:
            ok &= np.minimum(a, b) * _BLOCKS + np.maximum(a, b) == q
        else:
            ok &= np.minimum(a, b) == 0
    return group.reshape(-1), ok


def _verify(percent: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        node = table["node"].to_numpy()
        copies = table["copies"].to_numpy()
        size = table["size"].to_numpy()
        sets = [np.frombuffer(b.as_py(), B.U64) for b in table["set"]]
        n = len(node)
        group, ok = np.zeros(n, np.int64), np.ones((1, 1), bool)
        if len(table["at"][0]):
            group, ok = _counted(np.array(table["homes"].to_pylist(), np.int64), table["at"][0].as_py())
        more = np.zeros(n, np.int64)
        # Links by scores alone are counted, not listed; all of these nodes link with that of the best score.
        score, _ = scores(np.array([len(s) for s in sets], np.int64), size, percent)
        best = int(np.argmax(score))
        y = np.flatnonzero(score + score[best] >= 0)
        y = y[y != best]
        x, y = [np.full(len(y), best)], [y]
        if len(y[0]):
            for t in range(len(ok)):
                other = np.flatnonzero(group == t)
                other = other[np.argsort(score[other])]
                after = np.append(np.cumsum(copies[other][::-1])[::-1], 0)
                own = np.flatnonzero(ok[group, t])
                more[own] += after[np.searchsorted(score[other], -score[own])]
            itself = ok[group, group] & (score >= 0)
            more[itself] -= copies[itself]
        for i, j in linked(sets, size, percent):
            x.append(np.full(len(j), i))
            y.append(j)
            j = j[ok[group[i], group[j]]]
            more[i] += copies[j].sum()
            more[j] += copies[i]
        root = node.copy()
        x, y = np.concatenate(x), np.concatenate(y)
        while len(x):
            low = np.minimum(root[x], root[y])
            before = root.copy()
            np.minimum.at(root, x, low)
            np.minimum.at(root, y, low)
            if np.array_equal(before, root):
                break
        keep = (more > 0) | (root != node)
        return pa.table([pa.array(node[keep]), pa.array(more[keep]), pa.array(root[keep])], names=["node", "more", "root"])

    return run


def similar(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, percent: int = PERCENT, limit: int = LIMIT
) -> DataFrame:
    """One row per document: size of its set, number of other documents linked directly, component."""
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = _grouped(docs.withColumn("row", F.xxhash64("id", "text")), gram, percent, limit)
    return out.select(
        F.col("id").alias(id_col),
        "n_shingles",
        F.when(F.col("key").isNull(), 0).otherwise(F.col("copies") - 1 + F.coalesce("more", F.lit(0))).cast("long").alias("n_similar"),
        F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("least.id")).alias("component_id"),
    )


def _grouped(docs: DataFrame, gram: int, percent: int, limit: int) -> DataFrame:
    """(id, row, n_shingles, key, copies, more, least) of documents (id, text, row).

    ``row`` is a hash of the row, ``copies`` counts the rows of its set, ``more`` those of linked sets;
    ``least`` holds id and row of the component's first row: by id, null ones last, then by hash.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must lie between 50 and 100")
    ensure_checkpoint_dir(docs)
    n = X.parts(docs)
    sets = _sets(docs, gram).checkpoint()
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row"))
    nodes = sets.where("key is not null").groupBy("key").agg(first.alias("least"), F.count("*").alias("copies"))
    found = components(_edges(_cell_messages(docs, n, gram, percent), percent))
    wanted = found.join(nodes, found.node == nodes.key).select("node", F.col("least.row").alias("place"), "copies", F.col("root").alias("region"))

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in B.blocks(batch.column(3)):
                own = shingle_sets(block, gram)
                part = batch.slice(block.lo, block.n)
                empty = pa.array([[]] * block.n, pa.list_(pa.int32()))
                size = pa.array([len(s) for s in own], pa.int64())
                cols = [part.column(2), part.column(0), part.column(1), size, pa.array([s.tobytes() for s in own], pa.binary()), empty, empty]
                ok = pa.array([set_key(s) == k if len(s) else False for s, k in zip(own, part.column(0).to_pylist())], pa.bool_())
                yield pa.RecordBatch.from_arrays(cols, names=["region", "node", "copies", "size", "set", "homes", "at"]).filter(ok)

    members = wanted.join(docs, F.col("place") == F.col("row")).select("node", "copies", "region", "text")
    members = members.mapInArrow(with_sets, MEMBERS).dropDuplicates(["node"])
    members = members.checkpoint()
    split = False
    ready: list[DataFrame] = []
    before = None
    for level in range(LEVELS + 1):
        counts = members.groupBy("region").agg(F.count("*").alias("n"), F.sum(F.octet_length("set")).alias("bytes"))
        # A pair is never split.  Large regions are few beside nodes, so they are broadcast.
        big = F.broadcast(counts.where(((F.col("n") > limit) | (F.col("bytes") > REGION_BYTES)) & (F.col("n") > 2)).checkpoint())
        if big.isEmpty():
            ready.append(members)
            break
        ready.append(members.join(big, "region", "left_anti"))
        chosen = members.join(big, "region")
        centred = _centred(chosen).checkpoint()
        left = centred.groupBy("region").agg(F.sum(F.octet_length("set")).alias("left")).join(big, "region").select("region", "left", "bytes").checkpoint()
        over = left.where(F.col("left") > REGION_BYTES)
        largest = over.agg(F.max("left")).first()[0]
        ready.append(centred.join(F.broadcast(over), "region", "left_anti"))
        if largest is None:
            break
        split = True
        last = level == LEVELS or (before is not None and largest >= 0.7 * before)
        before = largest
        # Regions that are all near their centre fall into no cells.
        dense = F.lit(True) if last else 4 * F.col("left") <= F.col("bytes")
        ready.append(_blocked(centred.join(F.broadcast(over.where(dense).select("region", "left")), "region"), REGION_BYTES))
        if last:
            break
        members = _split(chosen.join(F.broadcast(over.where(~dense).select("region")), "region", "left_semi"), percent).checkpoint()
    members = reduce(DataFrame.unionByName, ready)
    results = members.groupBy("region").applyInArrow(_verify(percent), "node long, more long, root long").checkpoint()
    if split:
        joined = components(results.select(F.col("node").alias("a"), F.col("root").alias("b")))
        per_node = results.groupBy("node").agg(F.sum("more").alias("more"))
        results = per_node.join(joined, "node", "left").select("node", "more", F.coalesce("root", "node").alias("root"))
    results = results.withColumnRenamed("node", "key")
    roots = nodes.join(results, "key").groupBy("root").agg(F.min("least").alias("least_of_all"))
    results = results.join(roots, "root").select("key", "more", "least_of_all")
    info = nodes.join(results, "key", "left").select("key", "copies", "more", F.coalesce("least_of_all", "least").alias("least"))
    return sets.join(info, "key", "left")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """Exactly one row of every component, with all columns: the one with the smallest id.

    Null ids come last; of several rows with that id the one with the smallest hash over its columns
    stays, of equal rows any.  Rows without words have no component and all stay.
    """
    columns, row, rank, out = docs.columns, "row", "rank", "gone"
    while {row, rank, out} & set(columns):
        row, rank, out = row + "_", rank + "_", out + "_"
    # Maps have no hash; rows that differ in them alone count as equal.
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    keyed = docs.withColumn(row, F.xxhash64(*hashed, *[c.isNull() for c in hashed]))
    slim = keyed.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(row).alias("row"))
    groups = _grouped(slim, gram, percent, LIMIT)
    gone = groups.where(F.col("key").isNotNull() & (F.col("row") != F.col("least.row"))).select(F.col("row").alias(out)).distinct()
    left = keyed.join(gone, keyed[row] == F.col(out), "left_anti")
    # Equal rows of the first one: the exchange of the join serves the ranking too.
    ranked = left.withColumn(rank, F.row_number().over(Window.partitionBy(row).orderBy(row)))
    wordless = ~F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return ranked.where((F.col(rank) == 1) | wordless).select(*[F.col(f"`{c}`") for c in columns])
