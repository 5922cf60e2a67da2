"""What a Python step holds besides its batch and its result doesn't grow with the batch."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom import more_queries, queries
from sparkloom.api import SparkTokenizer
from sparkloom.functions.pretokenize import word_grammar
from sparkloom.operators import encode

N, ROWS = 2_000_000, 400
WORDS = ["the", " of", " tokens", " and", "\n", " 7", " été", " internationalization"]


def _steps(monkeypatch, make) -> list:
    """The Arrow functions that ``make`` puts into its columns."""
    found = []

    def arrow_udf(kind):
        def keep(f):
            found.append(f)
            return lambda *columns: F.lit(None).cast(kind)

        return keep

    with monkeypatch.context() as m:
        m.setattr(F, "arrow_udf", arrow_udf)
        make()
    return found


def _peak(step, *args) -> int:
    """MB that numpy and Python hold at most."""
    step(*[x.slice(0, 2) for x in args])
    tracemalloc.start()
    try:
        step(*args)
        return tracemalloc.get_traced_memory()[1] >> 20
    finally:
        tracemalloc.stop()


def _lists(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.linspace(0, len(values), ROWS + 1).astype(np.int32)), values)


@pytest.fixture(scope="module")
def chunks():
    return _lists(pa.array(WORDS).take(pa.array(np.arange(N) % len(WORDS))))


@pytest.fixture(scope="module")
def token_ids():
    return _lists(pa.array((np.arange(N) % 50_000).astype(np.int32)))


def _tokenizer(spark):
    return SparkTokenizer(queries._spec(queries.RANKS, word_grammar()), spark)


def test_ids_of_tokens_memory(spark, monkeypatch, token_ids):
    t = queries._auto(spark)
    (to_ids,) = _steps(monkeypatch, lambda: t.convert_tokens_to_ids(F.lit(None)))
    names = pa.array([t.spec.surface[i] for i in range(50_000)])
    assert _peak(to_ids, _lists(names.take(token_ids.values))) < 16


def test_ids_of_tokens_with_nulls_and_strangers(spark):
    t = queries._auto(spark)
    rows = [([0, 50256, 999_999, None, -1],), ([],), (None,)]
    df = spark.createDataFrame(rows, "ids array<int>")
    got = [r[0] for r in df.select(t.convert_ids_to_tokens("ids")).collect()]
    assert got == [[t.spec.surface[0], queries.END, None, None, None], [], None]
    assert [r[0] for r in df.select(t.convert_ids_to_tokens("ids", skip_special_tokens=True)).collect()] == [[t.spec.surface[0], None, None, None], [], None]
    back = spark.createDataFrame([([queries.END, "☃ no", None],), (None,)], "t array<string>").select(t.convert_tokens_to_ids("t")).collect()
    assert [r[0] for r in back] == [[50256, None, None], None]


def test_blocks_give_the_same_ids(monkeypatch):
    """Blocks end inside rows; the cache is emptied on the way; rows may be empty, or longer than a block."""
    tables = encode.Tables.of(queries._spec(queries.RANKS, word_grammar()))
    rng = np.random.default_rng(1)
    words = [*WORDS, *(f" w{i}" for i in range(300)), "long" * 100]
    rows = [rng.choice(words, n).tolist() for n in (0, 3, 0, 500, 1, 40, 0, 0, 77, 0)]
    lists = pa.array([["x"], *rows], pa.list_(pa.string())).slice(1)
    values, first = encode.rows_of(lists)
    want = encode.Merger(tables).encoded(values, first)
    for name, small in (("BLOCK_CHUNKS", 7), ("BLOCK_BYTES", 50), ("GATHER", 3), ("CACHE_CHUNKS", 40), ("CACHE_BYTES", 100)):
        monkeypatch.setattr(encode, name, small)
        m = encode.Merger(tables)
        got = m.encoded(values, first)
        assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])
        assert np.array_equal(m.counts(values, first), want[1])
        start, end = encode.spans_of(tables.lengths, *want)
        size = [sum(len(c.encode()) for c in r) for r in rows]
        assert [0 if a == b else end[b - 1] for a, b in zip(want[1][:-1], want[1][1:])] == size
        assert np.array_equal(end - start, tables.lengths[want[0]]) and all(start[a] == 0 for a, b in zip(want[1][:-1], want[1][1:]) if b > a)


def test_character_seeds(spark):
    """Byte fallback by arrays gives what the definition gives."""
    tables = encode.Tables.of(more_queries.small_spec())
    words = ["▁the", "né€\U0001f600z", "日本", "▁", "a" * 300, "▁▁x", "0", "the\x00re"]
    lists = pa.array([words, [], words[::-1]], pa.list_(pa.string()))
    got, want = (encode.Merger(tables, engine).encoded(*encode.rows_of(lists)) for engine in ("batch", "loop"))
    assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])


def test_encode_flags_memory(spark, monkeypatch, chunks):
    t = queries._auto(spark)
    (step,) = _steps(monkeypatch, lambda: t.encode_special("text"))
    inner = pa.ListArray.from_arrays(chunks.offsets, chunks.values)
    n = len(inner)
    pieces = pa.StructArray.from_arrays([pa.array(np.full(n, -1, np.int32)), inner], names=["id", "chunks"])
    assert _peak(step, pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32)), pieces)) < 48


def test_encode_first_processor_special_places(spark):
    t = queries._tokenizer(spark)
    e = queries.END
    texts = ["", e, e + e, f"a{e}", f"{e}a", f"{e}{e} b{e}c{e}{e}", None, "plain"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "text string").select(t.encode_special("text")).collect()]
    want = [None if x is None else [i for k, p in enumerate(x.split(e)) for i in ([50256] * (k > 0) + _plain(t, p))] for x in texts]
    assert got == want


def _plain(t, text: str) -> list[int]:
    import regex

    m = encode.Merger(t.encoder.tables, "loop")
    return m.encoded(*encode.rows_of(pa.array([regex.findall(word_grammar(), text)], pa.list_(pa.string()))))[0].tolist()


@pytest.mark.parametrize("what, most", [("encode", 48), ("count", 32), ("encode_packed", 48), ("encode_offsets", 80)])
def test_encoding_memory(spark, monkeypatch, chunks, what, most):
    (step,) = _steps(monkeypatch, lambda: getattr(_tokenizer(spark), what)("text"))
    texts = [pa.nulls(len(chunks), pa.string())] if what == "encode_offsets" else []
    assert _peak(step, chunks, *texts) < most


def test_decoding_memory(spark, monkeypatch, token_ids):
    (step,) = _steps(monkeypatch, lambda: _tokenizer(spark).decode(F.lit(None)))
    assert _peak(step, token_ids) < 24


def test_tokens_of_ids_memory(spark, monkeypatch, token_ids):
    (step,) = _steps(monkeypatch, lambda: queries._auto(spark).convert_ids_to_tokens(F.lit(None)))
    assert _peak(step, token_ids) < 16


@pytest.mark.parametrize("name, most", [("tok__rows", 80), ("tok__spans", 80)])
def test_sql_functions_memory(spark, monkeypatch, chunks, name, most):
    from types import SimpleNamespace

    from sparkloom.operators import sqlfunctions

    t, kept = _tokenizer(spark), {}
    e = SimpleNamespace(spark=SimpleNamespace(udf=SimpleNamespace(register=lambda n, f: kept.update({n: f})), sql=lambda q: None), shared=t.encoder.shared, engine="batch", spec=t.spec, merge_function=lambda: None, count_function=lambda: None)
    with monkeypatch.context() as m:
        m.setattr(F, "arrow_udf", lambda kind: lambda f: f)
        sqlfunctions.register(e, "tok")
    assert _peak(kept[name], chunks) < most


def test_sql_offsets_makes_no_token_strings(spark):
    _tokenizer(spark).register("tok")
    plan = spark.sql("SELECT tok_offsets(text) AS o FROM VALUES ('a b') t(text)")._jdf.queryExecution().optimizedPlan().toString()
    assert "rows(" not in plan


def test_round_trips_take_one_step(spark):
    """No cast or template between encoding and what follows, so that both run in one worker."""
    for q in (queries.decode_roundtrip, more_queries.tokens_of_ids):
        assert q(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_batches_are_small_unless_the_session_says_otherwise(spark):
    before = spark.conf.get(encode.BATCH)
    try:
        spark.conf.unset(encode.BATCH)
        _tokenizer(spark)
        assert spark.conf.get(encode.BATCH) == encode.BATCH_BYTES
        spark.conf.set(encode.BATCH, "5m")
        _tokenizer(spark)
        assert spark.conf.get(encode.BATCH) == "5m"
    finally:
        spark.conf.set(encode.BATCH, before)
