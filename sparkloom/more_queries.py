"""Further registered queries: entry points, configurations, look-ups, SQL functions, prompts and packing."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Callable
from dataclasses import replace
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom import queries as Q
from sparkloom.api import SparkAutoTokenizer, SparkTokenizer
from sparkloom.functions.normalize import metaspace
from sparkloom.functions.pretokenize import NUMBER, at_marks, check_pattern, generic_grammar, isolate, word_grammar
from sparkloom.operators import chat, packing
from sparkloom.plans.spec import AddedToken, Spec, parse
from sparkloom.sources import ranks, tables

#: Letters that make a Latin text look like one of several scripts, and what they become.
LATIN, OTHERS = "aeotn", "日本のカé"
HAN = "[一-龥぀-ゟ゠-ヿ]+"


def _mixed(column: str = "text"):
    return F.translate(column, LATIN, OTHERS)


def pretok_cjk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three splits: digits by threes, runs of Han and kana, then words with marks."""
    stages = (f"{NUMBER}{{1,3}}", HAN, generic_grammar(3, True))
    return Q._docs(spark, sf_dir).select("doc_id", *Q._chunked(isolate(_mixed(), stages)))


def pretok_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q._docs(spark, sf_dir).select("doc_id", *Q._chunked(isolate(F.col("text"), ("[,.;|]+", f"{NUMBER}+", generic_grammar(3)))))


def pretok_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q._docs(spark, sf_dir).select("doc_id", *Q._chunked(isolate(F.col("text"), ())))


def pretok_prepend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q._docs(spark, sf_dir).select("doc_id", *Q._chunked(at_marks(metaspace(F.col("text"), 2))))


def pretok_no_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q._docs(spark, sf_dir).select("doc_id", *Q._chunked(at_marks(metaspace(F.col("text"), 3, False))))


def _encoded(spark: SparkSession, sf_dir: str, t: SparkTokenizer) -> DataFrame:
    return Q._docs(spark, sf_dir).select("doc_id", Q._text(t.encode("text")).alias("ids"))


def encode_heap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _encoded(spark, sf_dir, SparkTokenizer(Q._spec(Q.RANKS, word_grammar()), spark, engine="heap"))


def encode_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _encoded(spark, sf_dir, SparkTokenizer(Q._spec(Q.RANKS, word_grammar()), spark, engine="loop"))


def encode_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the name of a model, whose encoding has the word grammar."""
    return _encoded(spark, sf_dir, SparkTokenizer.from_encoding("davinci", Q.RANKS, check=False, spark=spark))


def encode_rank_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _encoded(spark, sf_dir, SparkAutoTokenizer.from_rank_file(Q.RANKS, word_grammar(), Q.SPECIALS, spark=spark))


def encode_auto_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _encoded(spark, sf_dir, SparkAutoTokenizer.from_file(Q.MODEL, {"eos_token": Q.END}, spark=spark))


@lru_cache(maxsize=1)
def _model_folder() -> str:
    """A model's folder on the driver, with both configurations; the second overrides the first."""
    folder = tempfile.mkdtemp(prefix="model-")
    os.symlink(Q.MODEL, os.path.join(folder, "tokenizer.json"))
    for name, content in (
        ("special_tokens_map", {"eos_token": "nothing", "pad_token": Q.END}),
        ("tokenizer_config", {"eos_token": {"content": Q.END}, "model_max_length": 1024, "padding_side": "left"}),
    ):
        with open(os.path.join(folder, f"{name}.json"), "w", encoding="utf-8") as f:
            json.dump(content, f)
    return folder


def encode_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _encoded(spark, sf_dir, SparkTokenizer.from_pretrained(_model_folder(), spark=spark))


def encode_auto_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _encoded(spark, sf_dir, SparkAutoTokenizer.from_pretrained(_model_folder(), spark=spark))


@lru_cache(maxsize=1)
def _exported() -> str:
    """The rank file as a cached tokenizer.json on the driver."""
    return ranks.cached_json(Q.RANKS, word_grammar(), Q.SPECIALS, tempfile.mkdtemp(prefix="cache-"))


def encode_cached_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks to reconstructed merges to a cached tokenizer.json, and back to ids."""
    path = _exported()
    if path != ranks.cached_json(Q.RANKS, word_grammar(), Q.SPECIALS, os.path.dirname(path)):
        raise ValueError("the cache gives the same file another name")
    return _encoded(spark, sf_dir, SparkTokenizer(path, spark))


def merges_of_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(left, right) of every token of two bytes and more, reconstructed from the ranks."""
    table = ranks.read_ranks(Q.RANKS)
    rows = []
    for token, rank in table.items():
        pair = ranks.merge_of(token, table) if len(token) > 1 else None
        if pair:
            rows.append((rank, pair[0].hex().upper(), pair[1].hex().upper()))
    return spark.createDataFrame(rows, "rank int, left_hex string, right_hex string")


def model_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(m, ranks.encoding_name(m), e.size, len(e.specials)) for e in ranks.ENCODINGS.values() for m in e.models.split()]
    return spark.createDataFrame(rows, "model string, encoding string, size int, n_specials int")


TINY = {"vocab": {"a": 0, "b": 1, "ab": 2}, "merges": ["a b"]}
LEVEL = {"type": "ByteLevel", "use_regex": True, "add_prefix_space": False}
BARE = LEVEL | {"use_regex": False}
_BYTES = {"model": TINY | {"byte_fallback": True}}
_PREPEND, _REPLACE = {"type": "Prepend", "prepend": "▁"}, {"type": "Replace", "pattern": {"String": " "}, "content": "▁"}


def _sequence(*parts: dict) -> dict:
    return {"type": "Sequence", "pretokenizers": list(parts)}


def _split(pattern: str, behavior: str = "Isolated") -> dict:
    return {"type": "Split", "behavior": behavior, "invert": False, "pattern": {"Regex": pattern}}


#: Changes to a small model's configuration by name.
CONFIGURATIONS: dict[str, dict] = {
    "byte level": {},
    "no pre-tokenizer": {"pre_tokenizer": None},
    "no model": {"model": {}},
    "list vocabulary": {"model": {"vocab": [["a", -1.0]]}},
    "word level": {"model": TINY | {"type": "WordLevel"}},
    "dropout": {"model": TINY | {"dropout": 0.1}},
    "word ends": {"model": TINY | {"end_of_word_suffix": "</w>"}},
    "unknown token": {"model": TINY | {"unk_token": "a"}},
    "normal form": {"normalizer": {"type": "NFKC"}},
    "two forms": {"normalizer": {"type": "Sequence", "normalizers": [{"type": "NFD"}, {"type": "NFC"}]}},
    "lower case": {"normalizer": {"type": "Lowercase"}},
    "bare level": {"pre_tokenizer": BARE},
    "digits one by one": {"pre_tokenizer": _sequence({"type": "Digits", "individual_digits": True}, LEVEL)},
    "digit runs": {"pre_tokenizer": _sequence({"type": "Digits"}, LEVEL)},
    "split": {"pre_tokenizer": _sequence(_split("a+"), BARE)},
    "two splits": {"pre_tokenizer": _sequence(_split("a+"), _split("b+"), BARE)},
    "three splits": {"pre_tokenizer": _sequence(_split("a"), _split(HAN), _split("b"), BARE)},
    "split and pattern": {"pre_tokenizer": _sequence(_split("a"), LEVEL)},
    "removing split": {"pre_tokenizer": _sequence(_split("a", "Removed"), BARE)},
    "anchored split": {"pre_tokenizer": _sequence(_split(r"\Ga"), BARE)},
    "split without level": {"pre_tokenizer": _sequence(_split("a"))},
    "broken split": {"pre_tokenizer": _sequence(_split("(a"), BARE)},
    "white space": {"pre_tokenizer": {"type": "Whitespace"}},
    "fallback": _BYTES | {"pre_tokenizer": None},
    "fallback, replace": _BYTES | {"pre_tokenizer": None, "normalizer": _REPLACE},
    "fallback, prepend": _BYTES | {"pre_tokenizer": None, "normalizer": {"type": "Sequence", "normalizers": [_PREPEND, _REPLACE]}},
    "fallback, metaspace": _BYTES | {"pre_tokenizer": {"type": "Metaspace", "prepend_scheme": "first"}},
    "fallback, never": _BYTES | {"pre_tokenizer": {"type": "Metaspace", "prepend_scheme": "never"}},
    "fallback, punctuation": _BYTES | {"pre_tokenizer": {"type": "Punctuation"}},
    "strip": _BYTES | {"pre_tokenizer": None, "decoder": {"type": "Sequence", "decoders": [{"type": "Strip", "content": " ", "start": 1}]}},
}


def config_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each configuration resolves to: forms, splits, space marks, prefix, fallback, strip; or an error."""
    rows = []
    for name, change in CONFIGURATIONS.items():
        try:
            s = parse({"model": TINY, "pre_tokenizer": LEVEL} | change)
            for pattern in s.stages:
                check_pattern(spark, pattern)
            rows.append((name, True, " ".join(s.forms), len(s.stages), s.metaspace, s.prepend, s.byte_fallback, s.strip_decoded))
        except ValueError:
            rows.append((name, False, "", 0, 0, "", False, False))
    return spark.createDataFrame(rows, "name string, ok boolean, forms string, n_stages int, marks int, prefix string, fallback boolean, strip boolean")


SOURCES = {
    "plain": "pat_str = 'a' + 'b'",
    "joined": "class T:\n    pat_str: str = '|'.join(['x', 'y' + 'z'])",
    "field": "self.pat_str = 'q'",
    "computed": "pat_str = make()",
    "broken": "def (",
    "absent": "other = 'a'",
}


def recovered_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k, ranks.pattern_of_source(v)) for k, v in SOURCES.items()], "name string, pattern string")


def config_specials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Special tokens from a configuration: of the tokenizer, and those that it names."""
    config = {"added_tokens_decoder": {"50256": {"content": Q.END}, "50300": {"content": "<x>"}}, "eos_token": {"content": Q.END}, "bos_token": "<x>", "unk_token": "no such token"}
    t = SparkAutoTokenizer.from_rank_file(Q.RANKS, word_grammar(), config=config, spark=spark)
    rows = [(x, i) for x, i in ranks.specials_of_config(config).items()]
    rows += [("bos", t.bos_token_id), ("eos", t.eos_token_id), ("unk", t.unk_token_id), ("pad", t.pad_token_id)]
    return spark.createDataFrame(rows, "name string, id int")


def token_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, limits, sides and special tokens of a model's folder."""
    t = SparkAutoTokenizer.from_pretrained(_model_folder(), spark=spark)
    unlimited = SparkAutoTokenizer.from_file(Q.MODEL, {"model_max_length": 10**30}, spark=spark)
    values = {
        "length": len(t), "n_vocab": t.n_vocab, "vocab_size": t.vocab_size, "vocabulary": len(t.get_vocab()), "limit": t.model_max_length,
        "no limit": unlimited.model_max_length, "padding": t.padding_side, "truncation": t.truncation_side, "eos": t.eos_token, "pad": t.pad_token,
        "sep": t.sep_token, "special ids": t.all_special_ids, "special tokens": t.all_special_tokens, "repr": repr(t),
    }
    return spark.createDataFrame([(k, None if v is None else str(v)) for k, v in values.items()], "name string, value string")


def _stripping(spark: SparkSession) -> SparkTokenizer:
    added = (AddedToken(50257, Q.START, True, lstrip=True), AddedToken(50258, Q.STOP, True, rstrip=True), AddedToken(50256, Q.END, True))
    return SparkTokenizer(replace(Q._spec(Q.RANKS, word_grammar()), added=added), spark)


def special_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added tokens that swallow white space on their left or right."""
    joined = F.concat(F.col("text"), F.lit(f" \n{Q.START} "), F.col("role"), F.lit(f" {Q.STOP}\t "), F.col("text"), F.lit(f" {Q.END} x"))
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return talks.select("conv_id", "turn", Q._text(_stripping(spark).encode_special(joined)).alias("ids"))


def special_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without added tokens, those of another model are ordinary text."""
    t = Q._tokenizer(spark).with_special_tokens({})
    joined = F.concat(F.lit(Q.START), F.col("text"), F.lit(Q.END))
    return Q._docs(spark, sf_dir).select("doc_id", Q._text(t.encode_special(joined)).alias("ids"))


def special_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other added tokens after loading, of which the longest counts."""
    t = Q._tokenizer(spark).with_special_tokens({"<t>": 60000, "<t><t>": 60001})
    joined = F.concat(F.lit("<t>"), F.col("role"), F.lit("<t><t><t>"), F.col("text"), F.lit(Q.END))
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return talks.select("conv_id", "turn", Q._text(t.encode_special(joined)).alias("ids"))


def encode_bert(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = Q._spec(Q.RANKS, word_grammar())
    spec = replace(spec, added=(AddedToken(60000, "[CLS]", True), AddedToken(60001, "[SEP]", True)), post={"type": "BertProcessing"})
    ids, types = SparkAutoTokenizer(spec, spark=spark).encoded("text", "source")
    return Q._docs(spark, sf_dir).select("doc_id", Q._text(ids).alias("ids"), Q._text(types).alias("types"))


def encode_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A processor that adds nothing: the configuration's flags count, for single sequences."""
    t = Q._auto(spark, {"type": "ByteLevel"}, bos_token=Q.START, eos_token={"content": Q.STOP}, add_bos_token=True, add_eos_token=True)
    return Q._docs(spark, sf_dir).select("doc_id", Q._text(t.encode("text")).alias("ids"), Q._text(t.encode("text", "source")).alias("pair"))


def encode_first_processor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several processors the first that adds tokens counts."""
    t = Q._auto(spark, {"type": "Sequence", "processors": [{"type": "ByteLevel"}, Q._PAIRED, Q._ROBERTA]})
    return Q._docs(spark, sf_dir).select("doc_id", Q._text(t.encode("text")).alias("ids"))


def truncate_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit that leaves room for the template, and one that leaves none."""
    t = Q._auto(spark, Q._ROBERTA)
    some, none = t.encoded("text", max_length=20)[0], t.encoded("text", max_length=1)[0]
    return Q._docs(spark, sf_dir).select("doc_id", Q._text(some).alias("ids"), Q._text(none).alias("bare"))


def tokens_of_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Q._auto(spark)
    return Q._docs(spark, sf_dir).select("doc_id", F.array_join(t.convert_ids_to_tokens(t.encode("text")), " ").alias("tokens"))


def auto_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q._docs(spark, sf_dir).select("doc_id", F.array_join(Q._auto(spark, Q._ROBERTA).tokenize("text"), " ").alias("tokens"))


def ids_of_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids to token strings and back, with one string that is no token."""
    t = Q._auto(spark)
    tokens = F.concat(t.convert_ids_to_tokens(t.encode("text")), F.array(F.lit("\u2603"), F.lit(Q.END)))
    ids = F.transform(t.convert_tokens_to_ids(tokens), lambda x: F.coalesce(x, F.lit(-1)))
    return Q._docs(spark, sf_dir).select("doc_id", Q._text(ids).alias("ids"))


def _sql(spark: SparkSession, sf_dir: str) -> None:
    Q._tokenizer(spark).register("tok")
    Q._docs(spark, sf_dir).createOrReplaceTempView("tok_documents")


def sql_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    _sql(spark, sf_dir)
    return spark.sql("SELECT doc_id, array_join(CAST(tok_encode(text) AS ARRAY<STRING>), ' ') AS ids FROM tok_documents")


def sql_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    _sql(spark, sf_dir)
    return spark.sql("SELECT doc_id, tok_count(text) AS n_tokens FROM tok_documents")


def sql_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    _sql(spark, sf_dir)
    return spark.sql("SELECT doc_id, tok_decode(tok_encode(text)) AS text FROM tok_documents")


def sql_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    _sql(spark, sf_dir)
    return spark.sql(
        "SELECT doc_id, CAST(size(o) AS BIGINT) AS n_tokens, md5(array_join(transform(o, s -> concat_ws(':', s.start, s.`end`)), ' ')) AS spans_md5 "
        "FROM (SELECT doc_id, tok_offsets(text) AS o FROM tok_documents)"
    )


def sql_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    _sql(spark, sf_dir)
    return spark.sql(
        "SELECT d.doc_id, count(*) AS n, sum(CAST(e.id AS BIGINT) * (e.pos + 1)) AS weighted, max(e.`end`) AS n_bytes, max(e.start) AS last_start "
        "FROM tok_documents d, LATERAL tok_explode(d.text) e GROUP BY d.doc_id"
    )


def vocab_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two rank files whose ids differ, or that only one has."""
    one, other = (ranks.ranks_table(spark, p).withColumnRenamed("rank", "id") for p in (Q.RANKS, Q.MULTI))
    return tables.vocab_diff(one, other).select(F.hex("bytes").alias("hex"), "id_a", "id_b")


def packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q._tokenizer(spark).pack(Q._docs(spark, sf_dir).select("doc_id", "text"), "text", "doc_id", 2048).drop("text")


def tensor_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padded rows as matrices, summed by numpy in the tasks that make them."""
    import numpy as np
    import pyarrow as pa

    out = Q._tokenizer(spark).encode_batch(Q._docs(spark, sf_dir).select("doc_id", "text"), "text", 256, 50256)
    made = packing.matrices(out.withColumn("attention_mask", F.col("attention_mask").cast("array<int>")), ("input_ids", "attention_mask"))

    def sums(batches):
        for batch in batches:
            rows = batch.to_pylist()
            ids, mask = ([np.frombuffer(r[c], "<i8").reshape(r["rows"], r["width"]) for r in rows] for c in ("input_ids", "attention_mask"))
            columns = [[len(x) for x in ids], [x.shape[1] for x in ids], [int(x.sum()) for x in ids], [int((x * m).sum()) for x, m in zip(ids, mask)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["n", "width", "total", "real"])

    got = made.mapInArrow(sums, "n long, width long, total long, real long")
    return got.groupBy("width").agg(F.sum("n").alias("n_rows"), F.sum("total").alias("total"), F.sum("real").alias("real_total"))


def _talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def chat_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _talks(spark, sf_dir).select("conv_id", chat.render(F.col("messages"), "header", True).alias("prompt"))


#: A model's own template: white space control, loop variables, filters, tests and further values.
OWN = """{%- set ns = namespace(n=0) -%}
{{- bos_token -}}
{% for message in messages %}
    {% if message.role is not string %}
{{ raise_exception('a role must be a string') }}
    {% endif %}
    {% set ns.n = ns.n + 1 %}
[{{ loop.index }}/{{ loop.length }}] {{ message['role'] | upper }}: {{ (message.content or 'none') | trim }}{{ eos_token if loop.last else '' }}
{% endfor %}
{% if add_generation_prompt %}
{{ style ~ ns.n }} >
{%- endif %}"""


def _own(spark: SparkSession) -> SparkAutoTokenizer:
    many = [{"name": "rag", "template": "no"}, {"name": "default", "template": OWN}, {"name": "tool_use", "template": "{{ tools | tojson }}"}]
    return Q._auto(spark, chat_template=many, bos_token=Q.START, eos_token=Q.STOP)


def chat_own_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _own(spark)
    prompt = t.apply_chat_template("messages", add_generation_prompt=True, tokenize=False, style="answer ")
    tools = t.apply_chat_template("messages", tokenize=False, tools=F.lit('[{"name": "é"}]'))
    return _talks(spark, sf_dir).select("conv_id", prompt.alias("prompt"), tools.alias("with_tools"))


def chat_own_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _own(spark).apply_chat_template("messages", add_generation_prompt=True, return_dict=True, style="answer ")
    rows = _talks(spark, sf_dir).select("conv_id", got.alias("g"))
    return rows.select("conv_id", Q._text(F.col("g.input_ids")).alias("ids"), F.aggregate("g.attention_mask", F.lit(0), lambda a, x: a + x).cast("long").alias("n_mask"))


def chat_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of a model's templates counts, and errors where there is none or it is faulty."""
    many = [{"name": "x", "template": "X"}, {"name": "default", "template": "D"}, {"name": "tool_use", "template": "T"}]
    cases = {"one": ("S", False), "default": (many, False), "tools": (many, True), "first": (many[:1], True), "none": (None, False), "empty": ([], False)}
    rows = []
    for name, (template, tools) in cases.items():
        try:
            rows.append((name, chat.choose(template, tools)))
        except ValueError:
            rows.append((name, "error"))
    for name, source in {"unclosed": "{% if x %}", "unknown": "{{ x | nothing }}", "open": "{{ x"}.items():
        try:
            rows.append((name, chat.compiled(source).render(x="v")))
        except ValueError:
            rows.append((name, "error"))
    return spark.createDataFrame(rows, "name string, template string")


#: Merges of a small model with space marks and byte fallback.
SMALL_MERGES = (
    "▁ t|h e|▁t he|e r|i n|o n|a n|▁ a|r e|e n|▁t h|n d|o r|t i|e s|d e|▁ o|▁o f|an d|▁a nd|in g|l a|▁ de|on e|re s|u n|c h|ti on|▁ in|▁ la|er e|s t|a t|ou r|▁ s|▁s t"
)


@lru_cache(maxsize=1)
def small_spec() -> Spec:
    """Bytes, letters and the merges above."""
    vocab = {f"<0x{b:02X}>": 3 + b for b in range(256)}
    for c in "▁" + "".join(map(chr, range(97, 123))) + "".join(map(chr, range(65, 91))):
        vocab[c] = len(vocab) + 3
    pairs = [m.split(" ") for m in SMALL_MERGES.split("|")]
    for a, b in pairs:
        vocab.setdefault(a + b, len(vocab) + 3)
    model = {
        "model": {"type": "BPE", "vocab": vocab, "merges": [list(p) for p in pairs], "byte_fallback": True},
        "normalizer": {"type": "Sequence", "normalizers": [_PREPEND, _REPLACE]},
        "decoder": {"type": "Sequence", "decoders": [{"type": "Strip", "content": " ", "start": 1, "stop": 0}]},
    }
    return parse(model)


def encode_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte fallback and space marks, with the mark in front, without it, and back to text."""
    t = SparkTokenizer(small_spec(), spark)
    ids = t.encode("text")
    return Q._docs(spark, sf_dir).select("doc_id", Q._text(ids).alias("ids"), Q._text(t.encode("text", prefix=False)).alias("bare"), t.decode(ids).alias("text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        pretok_cjk, pretok_multi, pretok_whole, pretok_prepend, pretok_no_prefix, encode_heap, encode_loop, encode_named, encode_rank_file,
        encode_auto_file, encode_folder, encode_auto_folder, encode_cached_json, merges_of_ranks, model_encodings, config_rules,
        recovered_patterns, config_specials, token_properties, special_strip, special_none, special_reset, encode_bert, encode_flags,
        encode_first_processor, truncate_single, tokens_of_ids, auto_tokenize, ids_of_tokens, sql_encode, sql_count, sql_decode, sql_offsets,
        sql_explode, vocab_diff, packed_sequences, tensor_sums, chat_header, chat_own_template, chat_own_encode, chat_choice, encode_fallback,
    )
}
