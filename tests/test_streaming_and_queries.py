import datetime
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sparkloom import queries, streaming
from sparkloom.api import SparkTokenizer

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    t = SparkTokenizer(queries.MODEL, spark)
    df = spark.createDataFrame([(i, f"text number {i}") for i in range(20)], "id int, text string")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = streaming.encode_stream(streaming.read_texts(spark, str(tmp_path / "in"), df.schema, 1), t)
    streaming.write_parquet(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    want = {r.id: r.ids for r in df.select("id", t.encode("text").alias("ids")).collect()}
    assert {r.id: r.ids for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_windows_and_late_rows(spark, tmp_path):
    t = SparkTokenizer(queries.MODEL, spark)
    at = lambda minute: datetime.datetime(2024, 1, 1, 0, minute)
    schema = "ts timestamp, kind string, text string"
    batches = [[(at(1), "a", "x y"), (at(2), "a", "z")], [(at(40), "b", "x")], [(at(41), "b", "x")], [(at(3), "a", "late late")], [(at(58), "b", "x")], [(at(59), "b", "x")]]
    seen: set[str] = set()
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for f in set(os.listdir(tmp_path / "in")) - seen:
            os.utime(tmp_path / "in" / f, (1_700_000_000 + 10 * k, 1_700_000_000 + 10 * k))
            seen.add(f)
    stream = streaming.read_texts(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, 1)
    counted = streaming.tokens_per_window(stream, t, "ts", "text", "5 minutes", "10 minutes", "kind")
    query = counted.writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    got = {(r.window.start.minute, r.kind): r.n_tokens for r in spark.table("windows").collect()}
    assert got[0, "a"] == 3 and got[40, "b"] == 2


def test_registry(spark):
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    assert entry.entry(spark).count() == 200


@pytest.mark.parametrize("name", ["pretok_digits", "pair_lengths", "merge_monotonic_check", "bytefallback_encode"])
def test_queries_without_sql(spark, name):
    df = entry.queries()[name](spark, SF)
    if name == "pretok_digits":
        import hashlib

        import regex

        from sparkloom.functions.pretokenize import word_grammar

        texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
        for r in df.collect():
            pieces = [p for x in regex.split(r"(\p{N})", texts[r.doc_id]) for p in ([x] if regex.fullmatch(r"\p{N}", x) else regex.findall(word_grammar(), x))]
            assert r.n_chunks == len(pieces) and r.chunks_md5 == hashlib.md5("\x02".join(pieces).encode()).hexdigest()
    elif name == "pair_lengths":
        for r in df.collect():
            a, b = r.n_a, r.n_b
            while a + b > 301:
                a, b = (a - 1, b) if a >= b else (a, b - 1)
            assert (r.cut_a, r.cut_b) == (a, b)
    elif name == "merge_monotonic_check":
        assert df.first().n_inversions == 0
    else:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
        texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
        assert all(r.round_trip and r.ids == " ".join(map(str, p.encode(texts[r.doc_id]))) for r in df.collect())


def test_oracles(spark):
    """A few queries against DuckDB; the rest is compared elsewhere."""
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "conversations", "events", "benchmark"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    sql = entry.oracle_sql()
    for name in ("count_tokens", "encode_left", "chat_encode", "token_frequency", "encode_offsets"):
        df = entry.queries()[name](spark, SF)
        columns = sorted(df.columns)
        want = sorted(tuple(map(str, r)) for r in c.sql(f"select {','.join(columns)} from ({sql[name]})").fetchall())
        assert sorted(tuple(map(str, r)) for r in df.select(*columns).collect()) == want, name


def test_library_does_not_import_the_optional_subpackage():
    import pathlib
    import sparkloom

    root = pathlib.Path(sparkloom.__file__).parent
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "llm" not in f.read_text(), f


def test_checkpoint_free_of_local_copies():
    import pathlib

    root = pathlib.Path(entry.__file__).parent
    for f in [*root.glob("*.py"), *root.glob("sparkloom/**/*.py")]:
        assert "localCheckpoint" not in f.read_text(), f
    assert F is not None
