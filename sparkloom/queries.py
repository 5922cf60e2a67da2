"""Registered queries of the engine, each over its whole table, and DuckDB SQL for the same result."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.api import SparkAutoTokenizer, SparkTokenizer
from sparkloom.functions.normalize import metaspace, normalize
from sparkloom.functions.pretokenize import NUMBER, at_marks, camel_grammar, generic_grammar, isolate, word_grammar
from sparkloom.operators import chat, post
from sparkloom.plans.spec import AddedToken, Spec
from sparkloom.sources import ranks, tables
from sparkloom.sources.spread import spread

Query = Callable[[SparkSession, str], DataFrame]

VOCAB = os.environ.get("SPARKLOOM_VOCAB", "/opt/tokenizers")
RANKS = f"{VOCAB}/byte_bpe_50k.tiktoken"
MULTI = f"{VOCAB}/byte_bpe_multi_50k.tiktoken"
MODEL = f"{VOCAB}/byte_bpe_50k.json"
PIECES = f"{VOCAB}/piece_bpe_32k.model"
END, START, STOP = "<|endoftext|>", "<|im_start|>", "<|im_end|>"
SPECIALS = {END: 50256, START: 50257, STOP: 50258}


@lru_cache(maxsize=None)
def _spec(path: str, grammar: str) -> Spec:
    return ranks.spec_of_ranks(ranks.read_ranks(path), grammar, SPECIALS)


def _tokenizer(spark: SparkSession, path: str = RANKS, grammar: str | None = None) -> SparkTokenizer:
    return SparkTokenizer(_spec(path, grammar or word_grammar()), spark)


def _auto(spark: SparkSession, post_processor: dict | None = None, **config) -> SparkAutoTokenizer:
    from dataclasses import replace

    return SparkAutoTokenizer(replace(_spec(RANKS, word_grammar()), post=post_processor, config=config), spark=spark)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _text(ids: Column) -> Column:
    """Ids as text, so that results compare as plain values."""
    return F.array_join(ids.cast("array<string>"), " ")


def _chunked(pieces: Column) -> list[Column]:
    return [F.size(pieces).cast("long").alias("n_chunks"), F.md5(F.array_join(pieces, "\x02").cast("binary")).alias("chunks_md5")]


def pretok_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", *_chunked(isolate(F.col("text"), (word_grammar(),))))


def pretok_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", *_chunked(isolate(F.col("text"), (generic_grammar(3),))))


def pretok_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", *_chunked(isolate(F.col("text"), (generic_grammar(1, marks=True),))))


def pretok_camel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", *_chunked(isolate(F.col("text"), (camel_grammar(3),))))


def pretok_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", *_chunked(isolate(F.col("text"), (NUMBER, word_grammar()))))


def pretok_metaspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", *_chunked(at_marks(metaspace(F.col("text"), 3))))


def chunk_frequency_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _docs(spark, sf_dir).select(F.explode(isolate(F.col("text"), (word_grammar(),))).alias("chunk"))
    return chunks.groupBy("chunk").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "chunk").limit(100)


def count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", _tokenizer(spark).count("text").alias("n_tokens"))


def encode_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", _text(_tokenizer(spark).encode("text")).alias("ids"))


def encode_generic_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tokenizer(spark, MULTI, generic_grammar(3))
    return _docs(spark, sf_dir).select("doc_id", _text(t.encode("text")).alias("ids"))


def encode_camel(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tokenizer(spark, RANKS, camel_grammar(3))
    return _docs(spark, sf_dir).select("doc_id", _text(t.encode("text")).alias("ids"))


def encode_tokenizer_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = SparkTokenizer(MODEL, spark)
    return _docs(spark, sf_dir).select("doc_id", _text(t.encode("text")).alias("ids"))


def tokens_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _docs(spark, sf_dir).select("lang", F.octet_length("text").alias("b"), _tokenizer(spark).count("text").alias("n"))
    return counted.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"), (F.sum("b") / F.sum("n")).alias("bytes_per_token"))


def tokens_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _docs(spark, sf_dir).select("source", _tokenizer(spark).count("text").alias("n"))
    return counted.groupBy("source").agg(F.sum("n").alias("n_tokens"), F.max("n").alias("longest"))


def token_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokenizer(spark).token_frequency(_docs(spark, sf_dir), "text")


def distinct_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("lang", F.explode(_tokenizer(spark).encode("text")).alias("id"))
    return rows.groupBy("lang").agg(F.countDistinct("id").alias("n_distinct"))


def encode_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = _tokenizer(spark).encode_packed("text")
    return _docs(spark, sf_dir).select("doc_id", packed.alias("p")).select("doc_id", F.octet_length("p").cast("long").alias("n_bytes"), F.md5(F.lower(F.hex("p")).cast("binary")).alias("hex_md5"))


def encode_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", _tokenizer(spark).encode_offsets("text").alias("o"))
    spans = F.transform("o.spans", lambda s: F.concat_ws(":", s.start, s.end))
    return rows.select("doc_id", F.size("o.ids").cast("long").alias("n_tokens"), F.md5(F.array_join(spans, " ").cast("binary")).alias("spans_md5"))


def encode_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _tokenizer(spark).encode_batch(_docs(spark, sf_dir).select("doc_id", "text"), "text", 512, 50256)
    return out.select("doc_id", _text(F.col("input_ids")).alias("input_ids"), F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).cast("long").alias("n_real"))


def encode_padded_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text", "source")
    out = _tokenizer(spark).encode_batch(docs, "text", None, 50256, batch="source")
    return out.select("doc_id", F.size("input_ids").cast("long").alias("width"), F.array_position(F.col("attention_mask").cast("array<int>"), 0).alias("first_padding"))


_ROBERTA = {"type": "RobertaProcessing", "cls": [END, 50256], "sep": [END, 50256]}


def encode_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _auto(spark, _ROBERTA, pad_token=END, padding_side="left", truncation_side="left")
    out = t(_docs(spark, sf_dir).select("doc_id", "text"), "text", padding="max_length", truncation=True, max_length=256)
    return out.select("doc_id", _text(F.col("input_ids")).alias("input_ids"), _text(F.col("attention_mask")).alias("attention_mask"))


_PAIRED = {
    "type": "TemplateProcessing",
    "single": [{"SpecialToken": {"id": "S", "type_id": 0}}, {"Sequence": {"id": "A", "type_id": 0}}],
    "pair": [
        {"SpecialToken": {"id": "S", "type_id": 0}}, {"Sequence": {"id": "A", "type_id": 0}}, {"SpecialToken": {"id": "E", "type_id": 0}},
        {"Sequence": {"id": "B", "type_id": 1}}, {"SpecialToken": {"id": "E", "type_id": 1}},
    ],
    "special_tokens": {"S": {"ids": [50257]}, "E": {"ids": [50258, 50256]}},
}


def encode_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _auto(spark, _PAIRED, pad_token=END)
    docs = _docs(spark, sf_dir).select("doc_id", "text", "source")
    out = t(docs, "text", "source", truncation=True, max_length=128, return_token_type_ids=True)
    return out.select("doc_id", _text(F.col("input_ids")).alias("input_ids"), _text(F.col("token_type_ids")).alias("token_type_ids"))


def pair_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closed form of cutting the longer sequence first, for pairs of a document with its twin
    without vowels."""
    t = _tokenizer(spark)
    rows = _docs(spark, sf_dir).select("doc_id", t.encode("text").alias("a"), t.encode(F.translate("text", "aeiou", "")).alias("b"))
    a, b = post.truncate_pair(F.col("a"), F.col("b"), 301)
    return rows.select("doc_id", F.size("a").cast("long").alias("n_a"), F.size("b").cast("long").alias("n_b"), F.size(a).cast("long").alias("cut_a"), F.size(b).cast("long").alias("cut_b"))


def decode_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tokenizer(spark)
    return _docs(spark, sf_dir).select("doc_id", t.decode(t.encode("text")).alias("text"))


def decode_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tokenizer(spark)
    return _docs(spark, sf_dir).select("doc_id", t.decode_packed(t.encode_packed("text")).alias("text"))


def skip_special_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _auto(spark, _ROBERTA)
    return _docs(spark, sf_dir).select("doc_id", t.decode(t.encode("text"), skip_special_tokens=True).alias("text"))


def chat_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = chat.conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return talks.select("conv_id", chat.render(F.col("messages"), "chatml", True).alias("prompt"))


def chat_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _auto(spark)
    talks = chat.conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    ids = t.apply_chat_template("messages", "chatml", add_generation_prompt=True)
    return talks.select("conv_id", ids.alias("i")).select("conv_id", F.size("i").cast("long").alias("n_tokens"), _text(F.col("i")).alias("ids"))


def special_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tokenizer(spark)
    joined = F.concat(F.lit(START), F.col("role"), F.lit(STOP), F.col("text"), F.lit(END))
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", _text(t.encode_special(joined)).alias("ids"))


def vocab_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = ranks.ranks_table(spark, RANKS)
    return table.select(F.col("rank").alias("id"), F.hex("bytes").alias("hex"), F.octet_length("bytes").alias("n_bytes"))


def vocab_special_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.vocab_table(spark, _spec(RANKS, word_grammar())).where("is_special").select("id", "token")


def merge_monotonic_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    merges = SparkTokenizer(MODEL, spark).merges()
    return tables.rank_inversions(merges).agg(F.count("*").alias("n_inversions"))


def nfc_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", normalize(F.col("text"), ("NFD", "NFC")).alias("text"))


def events_json_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    counted = events.select("event_type", _tokenizer(spark).count("props").alias("n"))
    return counted.groupBy("event_type").agg(F.count("*").alias("n_events"), F.sum("n").alias("n_tokens"))


@lru_cache(maxsize=None)
def piece_spec(path: str = PIECES) -> Spec:
    """A byte-fallback spec with space marks from a SentencePiece BPE model's pieces: every split of a
    piece into pieces is a merge, by falling score, then ids."""
    import numpy as np
    import sentencepiece

    from sparkloom.functions.merge import PairTable

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    plain, vocab = {}, {}
    for i in range(p.get_piece_size()):
        vocab[p.id_to_piece(i)] = i
        if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i)):
            plain[p.id_to_piece(i)] = i
    rows = []
    for piece, i in plain.items():
        for k in range(1, len(piece)):
            if piece[:k] in plain and piece[k:] in plain:
                rows.append((-p.get_score(i), i, plain[piece[:k]], plain[piece[k:]]))
    rows.sort()
    cols = np.array([(a, b, t) for _, t, a, b in rows], np.int64)
    merges = PairTable(cols[:, 0], cols[:, 1], np.arange(len(cols)), cols[:, 2])
    added = tuple(AddedToken(i, p.id_to_piece(i), True) for i in (0, 1, 2))
    return Spec(vocab, merges, added, metaspace=2, prepend="always", byte_fallback=True, strip_decoded=True)


def bytefallback_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = SparkTokenizer(piece_spec(), spark)
    ids = t.encode("text")
    return _docs(spark, sf_dir).select("doc_id", "text", ids.alias("i")).select(
        "doc_id", _text(F.col("i")).alias("ids"), (t.decode("i") == F.col("text")).alias("round_trip")
    )


def stream_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of the documents' files, encoded and written as it arrives, read back at its end."""
    from sparkloom import streaming

    path = f"{sf_dir}/documents.parquet"
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="stream-")
    out = f"{base.rstrip('/')}/stream_count_tokens/{os.urandom(8).hex()}"
    stream = streaming.read_texts(spark, path, spark.read.parquet(path).schema)
    counted = stream.select("doc_id", _tokenizer(spark).count("text").alias("n_tokens"))
    streaming.write_parquet(counted, f"{out}/rows", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/rows")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        pretok_word, pretok_generic, pretok_marks, pretok_camel, pretok_digits, pretok_metaspace, chunk_frequency_topk, count_tokens,
        encode_word, encode_generic_multi, encode_camel, encode_tokenizer_json, tokens_by_lang, tokens_per_source, token_frequency,
        distinct_tokens, encode_packed, encode_offsets, encode_padded, encode_padded_longest, encode_left, encode_pair, pair_lengths,
        decode_roundtrip, decode_packed, skip_special_decode, chat_render, chat_encode, special_split, vocab_lookup, vocab_special_ids,
        merge_monotonic_check, nfc_normalize, events_json_tokens, bytefallback_encode, stream_count_tokens,
    )
}
