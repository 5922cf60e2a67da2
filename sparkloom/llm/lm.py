"""Language-model scoring with a weighted backoff automaton.

States are n-gram histories seen in training: the empty one, all single tokens, and longer ones that
occur at least ``STATE`` times.  A state h has an arc for every token w that followed it, which carries
log10 p(w | h) = log10((c(hw) + mu p(w | h')) / (c(h) + mu)) for the shortened history h' and leads to
the longest state that ends hw; and a failure arc to h' with the weight log10(mu / (c(h) + mu)).  The
empty state's arcs carry the add-one unigram (c(w) + 1) / (N + V + 1); a token never seen leaves it with
1 / (N + V + 1), back into it.  A text is traversed once from left to right: the state carried so far is
left by the token's arc, or over failure arcs first, and the weights met are added up.

The automaton is never in one place.  Each chunk of texts asks for the counts of just those n-grams
that its texts contain (``_exchange``), for longer ones only where their history is a state and other chunks
can have them too, so one round of questions follows the other.  From the answers it builds the part of the automaton that its
texts can reach, as arrays of states, failure arcs and a hash table of arcs, and traverses all its texts
with it, many at a time: texts are cut into runs of ``RUN`` tokens, each led by the tokens that
determine the state in which it begins.  All counts cover the whole training corpus.

Tokens: lower-cased words between white space, then one end mark; the end mark also is the history
of a text's first token.  Defined results: null and empty texts are the end mark alone; a null id
counts as the empty id for the fold; rows with repeated or null ids, and equal rows, count each time and
are scored one by one; texts are scored whole, whatever their length; with no training rows N = V = 0
and the score follows from the formulas; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm import _blocks as B
from sparkloom.llm import _exchange as X

END = B.U64(B.mix_int(0x656E64))
ORDER = 3
#: Weight of the shorter history, for histories of one token, two tokens and so on (the last one repeats).
MU = (500.0, 20.0)
#: Histories of two and more tokens are states if they occur so often.
STATE = 2
#: Tokens that one run of the traversal scores.
RUN = 64


def _mu(mu: tuple[float, ...], k: int) -> float:
    """The weight for n-grams of length k >= 2."""
    return mu[min(k - 2, len(mu) - 1)]


def _tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes, row offsets): each row is an end mark, its words, an end mark."""
    parts, counts = [], []
    for block in B.blocks(table["text"]):
        data, w = B.words(block, B.NONSPACE)
        h = B.hash_spans(data, w.start, w.end, 17)
        out = np.full(len(h) + 2 * block.n, END)
        out[np.arange(len(h)) + 2 * w.row + 1] = h
        parts.append(out)
        counts.append(w.counts + 2)
    none = np.zeros(0, np.int64)
    counts = np.concatenate(counts) if counts else none
    return (np.concatenate(parts) if parts else np.zeros(0, B.U64)), np.concatenate(([0], np.cumsum(counts)))


def _grams(tokens: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(even key, index of the last token) of every k-gram; a 1-gram is no leading end mark."""
    last = B.window_starts(first, k) + k - 1 if k > 1 else None
    if k == 1:
        keep = np.ones(len(tokens), bool)
        keep[first[:-1]] = False
        last = np.flatnonzero(keep)
        key = B.mix(tokens[last] + B.U64(1))
    else:
        key = B.chain(tokens, k)[last - k + 1]
    return key & ~B.U64(1), last


@dataclass
class _Gram:
    """The distinct n-grams of one length in a chunk, by key."""

    key: np.ndarray
    last: np.ndarray  # token index at which one of its places ends
    at: np.ndarray  # number of the n-gram that ends at each token, -1 for none
    training: np.ndarray  # how often each occurs in the chunk's training texts


def _distinct(tokens: np.ndarray, first: np.ndarray, seen: np.ndarray, k: int) -> _Gram:
    key, last = _grams(tokens, first, k)
    order = np.argsort(key)
    key, last = key[order], last[order].astype(np.int32)
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    number = np.repeat(np.arange(len(new), dtype=np.int32), np.diff(np.append(new, len(key))))
    at = np.full(len(tokens), -1, np.int32)
    at[last] = number
    return _Gram(key[new], last[new], at, np.bincount(number[seen[last]], minlength=len(new)).astype(np.int32))


def _seen(table: pa.Table, first: np.ndarray) -> np.ndarray:
    """Whether each token belongs to a training text."""
    training = ~table["held"].combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
    return np.repeat(training, np.diff(first))


def _parts(g: _Gram, shorter: _Gram) -> tuple[np.ndarray, np.ndarray]:
    """The history and the end, one token less each, of every n-gram.

    The end mark in front of a text is no n-gram of its own; as a history it is the final end mark, which
    is the chunk's last token.
    """
    history = shorter.at[g.last - 1]
    return np.where(history < 0, shorter.at[-1], history), shorter.at[g.last]


def _wanted(g: _Gram, shorter: _Gram, coded: np.ndarray, k: int) -> np.ndarray:
    """Which n-grams of k tokens are asked about: their history is a state, their end occurs, and other
    chunks have both (else the chunk has all places of the n-gram itself)."""
    history, end = (coded[x] for x in _parts(g, shorter))
    return (history >> 1 >= _least_state(k - 1)) & (end > 1) & (history & end & 1 > 0)


def _known(g: _Gram, shorter: _Gram, coded: np.ndarray, k: int, answer: np.ndarray) -> np.ndarray:
    """Answers for all n-grams whose history is a state; zero for the others."""
    is_state = coded[_parts(g, shorter)[0]] >> 1 >= _least_state(k - 1)
    out = np.where(is_state, 2 * g.training.astype(np.int64), 0)
    out[_wanted(g, shorter, coded, k)] = answer
    return out


def _least_state(k: int) -> int:
    """How often a history of k tokens must occur to be a state."""
    return STATE if k > 1 else 1


def _question(n: int, k: int):
    """A round: n-grams of k tokens, given the answers about shorter ones."""

    def run(chunk: X.Chunk, table: pa.Table, answers: pa.Table | None = None) -> X.Rows:
        tokens, first = _tokens(table)
        seen = _seen(table, first)
        g = _distinct(tokens, first, seen, k)
        key, training = g.key, g.training
        if answers is not None:
            grams, coded, _ = _counted(tokens, first, seen, answers, k - 1)
            wanted = _wanted(g, grams[-1], coded[-1], k)
            key, training = key[wanted], training[wanted]
        cut = X.slices(key, n)
        return [(d, chunk.to, 0, X.pack(*X.thin(key[cut[d] : cut[d + 1]]), _small(training[cut[d] : cut[d + 1]]))) for d in range(n)]

    return run


def _counted(tokens: np.ndarray, first: np.ndarray, seen: np.ndarray, answers: pa.Table, order: int) -> tuple[list[_Gram], list[np.ndarray], np.ndarray]:
    """The chunk's n-grams of every length up to ``order``, the answers about them (twice the count, plus
    one if other chunks have the n-gram too), and (N, V).  Answers of kind k are about n-grams of k."""
    grams = [_distinct(tokens, first, seen, k) for k in range(1, order + 1)]
    coded: list[np.ndarray] = []
    for k in range(1, order + 1):
        got = X.collect(answers, k)
        answer = np.concatenate([_coded(a[1], a[2]) for a in got])
        if k == 1:
            totals = sum(a[0] for a in got)
            coded.append(answer)
        else:
            coded.append(_known(grams[k - 1], grams[k - 2], coded[-1], k, answer))
    return grams, coded, totals


def _coded(count: np.ndarray, shared: np.ndarray) -> np.ndarray:
    return 2 * count.astype(np.int64) + np.unpackbits(shared, count=len(count))


def _small(x: np.ndarray) -> np.ndarray:
    """Counts in the narrowest unsigned type that holds them."""
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32 if top < 1 << 32 else np.uint64)


def _respond(asked: list[list[np.ndarray]]) -> list[tuple]:
    """(N, V) of the range's keys; each message's summed counts; and whether other messages have the key."""
    parts = [X.thick(*a[:3]) for a in asked]
    keys = np.concatenate(parts)
    counts = np.concatenate([a[3].astype(np.int64) for a in asked])
    at = np.argsort(keys, kind="stable")
    keys = keys[at]
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    total = np.add.reduceat(counts[at], new) if len(new) else new
    totals = np.array([total.sum(), (total > 0).sum()], np.int64)
    size = np.diff(np.append(new, len(keys)))  # a key comes once a message
    full, shared = np.empty(len(keys), np.int64), np.empty(len(keys), bool)
    full[at], shared[at] = np.repeat(total, size), np.repeat(size > 1, size)
    ends = np.cumsum([len(p) for p in parts])[:-1]
    return [(totals, _small(c), np.packbits(s)) for c, s in zip(np.split(full, ends), np.split(shared, ends))]


@dataclass
class Automaton:
    """States by number (0 is the empty history), their failure arcs, and a hash table of arcs."""

    failure: np.ndarray
    weight: np.ndarray  # log10 weight of each failure arc
    table: B.HashTable  # (state, token) to arc
    score: np.ndarray  # log10 probability of each arc
    target: np.ndarray
    unknown: float
    begin: int  # the state in front of a text

    @staticmethod
    def arc_key(state: np.ndarray, token: np.ndarray) -> np.ndarray:
        return B.mix(token ^ B.mix(state.astype(B.U64) + B.U64(1)))

    @classmethod
    def build(cls, tokens: np.ndarray, grams: list[_Gram], counts: list[np.ndarray], totals: np.ndarray, mu: tuple[float, ...]) -> Automaton:
        """The part of the automaton that texts of these n-grams can reach."""
        order, size = len(grams), 1
        whole = float(totals[0] + totals[1] + 1)
        state, chance, target = [], [], []
        failure, weight = [np.zeros(1, np.int64)], [np.zeros(1)]
        keys, scores, targets = [], [], []
        for k, (g, c) in enumerate(zip(grams, counts), 1):
            before, end = _parts(g, grams[k - 2]) if k > 1 else (None, None)
            own = np.full(len(c), -1)
            if k < order:
                # Nothing follows a final end mark.
                is_state = (c >= _least_state(k)) & ((k == 1) | (tokens[g.last] != END))
                own[is_state] = size + np.arange(int(is_state.sum()))
                size += int(is_state.sum())
                failure.append(np.zeros(int(is_state.sum()), np.int64) if k == 1 else state[-1][end[is_state]])
                m = _mu(mu, k + 1)
                weight.append(np.log10(m / (c[is_state] + m)))
            if k == 1:
                p, source, leads = (c + 1) / whole, np.zeros(len(c), np.int64), np.where(own >= 0, own, 0)
            else:
                m = _mu(mu, k)
                p = (c + m * chance[-1][end]) / (counts[k - 2][before] + m)
                source = state[-1][before]
                leads = np.where(own >= 0, own, target[-1][end])
            arc = (c > 0) & (source >= 0)
            keys.append(cls.arc_key(source[arc], tokens[g.last[arc]]))
            scores.append(np.log10(p[arc]))
            targets.append(leads[arc])
            state.append(own), chance.append(p), target.append(leads)
        begin = int(max(state[0][grams[0].at[-1]], 0)) if order > 1 and len(tokens) else 0
        return cls(np.concatenate(failure), np.concatenate(weight), B.HashTable(np.concatenate(keys)), np.concatenate(scores), np.concatenate(targets), -float(np.log10(whole)), begin)

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next state, log10 weight met) of each state and token: failure arcs, then an arc."""
        state, total = state.copy(), np.zeros(len(state))
        left = np.arange(len(state))
        while len(left):
            now = state[left]
            arc = self.table.find(self.arc_key(now, token[left]))
            found = arc >= 0
            at = left[found]
            total[at] += self.score[arc[found]]
            state[at] = self.target[arc[found]]
            stuck = ~found & (now == 0)
            total[left[stuck]] += self.unknown
            go = ~found & (now != 0)
            left = left[go]
            total[left] += self.weight[now[go]]
            state[left] = self.failure[now[go]]
        return state, total

    def traverse(self, tokens: np.ndarray, first: np.ndarray, order: int, run: int = RUN) -> np.ndarray:
        """Log10 probability of every text; a text's first token is the end mark in front."""
        length = np.diff(first) - 1  # tokens to score, one at least
        per = -(-length // run)
        row = np.repeat(np.arange(len(length)), per)
        number = B.ranges(np.zeros(len(per), np.int64), per)
        begin = first[row] + 1 + number * run
        end = np.minimum(begin + run, first[row + 1])
        lead = np.where(number > 0, order - 1, 0)
        at = begin - lead
        state = np.where(number > 0, 0, self.begin)
        by = np.argsort(at - end, kind="stable")  # the longest first: live runs are a prefix
        row, begin, end, at, state = row[by], begin[by], end[by], at[by], state[by]
        size = end - at
        total = np.zeros(len(row))
        for j in range(int(size.max(initial=0))):
            live = int(np.searchsorted(-size, -j, "left"))
            place = at[:live] + j
            state[:live], met = self.step(state[:live], tokens[place])
            total[:live] += np.where(place >= begin[:live], met, 0.0)
        return np.bincount(row, weights=total, minlength=len(length))


def _final(order: int, mu: tuple[float, ...], id_col: str, id_type: pa.DataType):
    def run(chunk: X.Chunk, table: pa.Table, answers: pa.Table) -> pa.Table:
        tokens, first = _tokens(table)
        grams, coded, totals = _counted(tokens, first, _seen(table, first), answers, order)
        counts = [c >> 1 for c in coded]
        body = np.ones(len(tokens), bool)
        body[first[:-1]] = False
        uni = np.where(body, counts[0][grams[0].at], 0)
        base = np.where(body, np.log10((uni + 1.0) / float(totals.sum() + 1)), 0.0)
        automaton = Automaton.build(tokens, grams, counts, totals, mu)
        rows = len(first) - 1
        columns = [
            table["id"].combine_chunks().cast(id_type), table["held"].combine_chunks(), pa.array(np.diff(first) - 1),
            pa.array(B.sums(body & (uni > 0), first)), pa.array(np.full(rows, int(totals[0]))),
            pa.array(_row_sums(base, first)), pa.array(automaton.traverse(tokens, first, order)),
        ]
        return pa.table(columns, names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def _row_sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of rows (none is empty), each added up by itself."""
    return np.add.reduceat(x, first[:-1]) if len(first) > 1 else np.zeros(0)


def held_out(id_col: str, folds: int = 7, fold: int = 2):
    """Whether crc32 of the id as text falls into the fold that isn't learnt from."""
    return F.pmod(F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, mu: tuple[float, ...] = MU) -> DataFrame:
    """One row per document: fold, tokens, known tokens, training tokens, unigram and model score."""
    from sparkloom.llm._map import arrow_type

    n = X.parts(docs)
    chunks = X.chunked(docs, n, id=F.col(f"`{id_col}`"), text=F.col(f"`{text_col}`").cast("string"), held=held_out(id_col))
    answers = X.answer(X.ask(chunks, n, _question(n, 1)), n, _respond, 1)
    for k in range(2, order + 1):
        answers = answers.union(X.answer(X.ask_again(chunks, answers, n, _question(n, k)), n, _respond, k))
    id_type = docs.schema[id_col].dataType
    kinds = T._parse_datatype_string("held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").fields
    schema = T.StructType([T.StructField(id_col, id_type), *kinds])
    return X.finish(chunks, answers, _final(order, mu, id_col, arrow_type(id_type)), schema)
