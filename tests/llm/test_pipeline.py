"""The pipeline against plain Python, stage by stage and as a whole."""

import re
from math import log2, sqrt

import numpy as np
import pytest

import corpus_pipeline
from sparkloom.llm import pieces, quality, secrets
from tests.llm.test_jaccard import brute as brute_similar
from tests.llm.test_row_operators import ALNUM, ASSIGN, brute_quality, lower

SF = "/root/testdata/sf0.001"


def js(p, q):
    sp, sq = sum(p), sum(q)
    p, q = [x / max(sp, 1e-300) for x in p], [x / sq for x in q]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    part = lambda a: sum(x * log2(x / y) for x, y in zip(a, m) if x > 0)
    return sqrt(min(max((part(p) + part(q)) / 2, 0), 1))


def char_class(c):
    if "a" <= c <= "z":
        return 0
    if "A" <= c <= "Z":
        return 1
    if "0" <= c <= "9":
        return 2
    if c in "\t\n\x0b\x0c\r ":
        return 3
    if c in "!\"'(),-./:;?[]{}":
        return 4
    if c in "#$%&*+<=>@\\^_`|~":
        return 5
    if ord(c) < 128:
        return 6
    return 7 if 0xC0 <= ord(c) < 0x380 else 8


def good(text, references):
    rules = quality.Rules()
    if brute_quality(text)[5]:
        return False
    hist = [0] * 15
    for c in text:
        hist[char_class(c)] += 1
    words = ALNUM.findall(lower(text))
    far = [True] * 3
    for r in references:
        own = [words.count(w) for w, _ in r.words]
        q = [x for _, x in r.words]
        d = [
            js(hist, r.classes) if len(text) >= rules.min_chars else 0,
            js(own, q) if sum(own) >= rules.min_common_words else 0,
            js([*own, len(words) - sum(own)], [*q, 1 - sum(q)]) if len(words) >= rules.min_all_words else 0,
        ]
        far = [f and x > limit for f, x, limit in zip(far, d, r.limits)]
    return not any(far)


def clean(text, items):
    """The text without hit words, or None if it is contaminated."""
    spans = [m.span() for m in ALNUM.finditer(lower(text))]
    w = ALNUM.findall(lower(text))
    hit = set()
    for item in items:
        iw = ALNUM.findall(lower(item))
        n = min(13, len(iw))
        grams = {tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)} if n else set()
        for p in range(len(w) - n + 1):
            if tuple(w[p : p + n]) in grams:
                hit |= set(range(p, p + n))
    if hit and 20 * len(hit) >= len(w):
        return None
    out, last = "", 0
    for p in sorted(hit):
        if p - 1 not in hit:
            out += text[last : spans[p][0]]
        last = spans[p][1]
    return out + text[last:]


def masked(text):
    found = [m.span() for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    found += [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    found += [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    for m in re.finditer(r"[0-9A-Za-z+/_=-]{20,}", text):
        if not any(a < m.end() and m.start() < b for a, b in found) and secrets._suspicious(m.group().encode()):
            found.append(m.span())
    out, last = "", 0
    merged = []
    for a, b in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out, last = out + text[last:a] + "[secret]", b
    return out + text[last:]


@pytest.fixture(scope="module")
def plain(spark):
    import sentencepiece

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stages = []
    table, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    references = quality.fit(table, labels.where("quality = 1"))
    docs = {i: t for i, t in docs.items() if good(t, references)}
    stages.append(docs)
    groups = brute_similar(list(docs.items()))
    docs = {i: t for i, t in docs.items() if groups[i][2] == i}
    stages.append(docs)
    docs = {i: c for i, t in docs.items() if (c := clean(t, items)) is not None}
    stages.append(docs)
    docs = {i: masked(t) for i, t in docs.items()}
    stages.append(docs)
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    stages.append({i: model.encode(t) for i, t in docs.items()})
    return stages


def test_stages_one_by_one(spark, plain, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        column = "text" if k < 4 else "ids"
        assert {r.doc_id: r[column] for r in docs.collect()} == plain[k], name


def test_run(spark, plain):
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.ids for r in got} == plain[-1]
    v = pieces.codec(pieces.DEFAULT_MODEL).v
    for r in got:
        for ids in (r.ids, r.best):
            assert pieces.decode(v, np.array(ids, np.int64), np.array([0, len(ids)]))[0].tobytes().decode() == plain[-2][r.doc_id]
        assert len(r.best) <= len(r.ids) or sum(v.score[r.best]) >= sum(v.score[r.ids])


def test_stages_on_odd_tables(spark):
    """Empty tables, nulls and further columns."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, node int, chunk string"
    rows = [(1, None, None, None, None, "a", 1, "x"), (2, "", "en", "s", 0, None, None, None), (None, "the of and " * 40, None, None, 3, None, 2, "y")]
    for data in ([], rows):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            docs.collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "secret_scans", "sentencepiece"]
