import base64
import json
import random
import unicodedata
from dataclasses import replace

import numpy as np
import pytest
import regex
import tiktoken
import tokenizers
from pyspark.sql import functions as F

from sparkloom import queries
from sparkloom.api import SparkAutoTokenizer, SparkTokenizer
from sparkloom.functions.pretokenize import NUMBER, camel_grammar, generic_grammar, isolate, to_java, word_grammar
from sparkloom.operators import chat, post
from sparkloom.plans.spec import UnsupportedTokenizer, load, parse, to_surface
from sparkloom.sources import ranks, tables

END = "<|endoftext|>"
LEVEL = {"type": "ByteLevel", "use_regex": True, "add_prefix_space": False}
BARE = LEVEL | {"use_regex": False}


def steps(*parts):
    return {"pretokenizers": list(parts), "type": "Sequence"}


def split(pattern, behavior="Isolated"):
    return dict(type="Split", behavior=behavior, invert=False, pattern=dict(Regex=pattern))


POOL = ["the", "The", " ", "  ", "\n", "\t", "'s", "'LL", "1234", "é", "ñ", "日本", "GDP", "camelCase", "!", "...", "\r\n", "ſ", "😀", "٣", END, "/", "x", "é", " ", "ǅ"]


def fuzz(seed=1, n=300, longest=30, pool=POOL):
    rng = random.Random(seed)
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, longest))) for _ in range(n)]


TEXTS = [*fuzz(), "", "a" * 3000, "ab" * 700, " " * 500, "日" * 600, "".join(map(chr, range(32, 127)))]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(-1, None)]
    return spark.createDataFrame(rows, "id int, text string").repartition(3).cache()


@pytest.fixture(scope="module")
def rank_table():
    return ranks.read_ranks(queries.RANKS)


def collect(df, *columns):
    return {r.id: r for r in df.select("id", *columns).collect()}


@pytest.mark.parametrize("grammar", [word_grammar(), generic_grammar(3), generic_grammar(1, True), generic_grammar(0), camel_grammar(3), camel_grammar(1, False)])
def test_all_entry_points_equal_the_oracle(spark, texts, rank_table, grammar):
    oracle = tiktoken.Encoding("o", pat_str=grammar, mergeable_ranks=rank_table, special_tokens={END: 50256})
    t = SparkTokenizer(ranks.spec_of_ranks(rank_table, grammar, {END: 50256}), spark)
    ids = t.encode("text")
    got = collect(
        texts, ids.alias("ids"), t.count("text").alias("n"), t.encode_packed("text").alias("packed"), t.encode_special("text").alias("special"),
        t.decode(ids).alias("back"), t.decode_packed(t.encode_packed("text")).alias("back2"), t.encode_offsets("text").alias("o"),
    )
    for i, text in enumerate(TEXTS):
        want, r = oracle.encode_ordinary(text), got[i]
        assert r.ids == want and r.n == len(want) and np.frombuffer(bytes(r.packed), "<u4").tolist() == want
        assert r.special == oracle.encode(text, allowed_special="all")
        assert r.back == text and r.back2 == text
        assert r.o.ids == want
        raw = text.encode()
        assert b"".join(raw[s.start : s.end] for s in r.o.spans) == raw
    assert all(x is None for x in got[-1][1:])


@pytest.mark.parametrize("engine", ["loop", "heap"])
def test_engines_agree(spark, rank_table, engine):
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzABC0123"
    long = ["".join(rng.choice(letters) for _ in range(n)) for n in (255, 256, 257, 1000)] + [u * k for u in ("ab", "a", "9f", "the") for k in (1, 50, 400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(long)], "id int, text string")
    spec = ranks.spec_of_ranks(rank_table, r"[\s\S]+")
    one, other = SparkTokenizer(spec, spark), SparkTokenizer(spec, spark, engine=engine)
    assert collect(df, one.encode("text").alias("x")) == collect(df, other.encode("text").alias("x"))


def test_tokenizer_json(spark, texts):
    t = SparkAutoTokenizer.from_file(queries.MODEL, spark=spark)
    oracle = tokenizers.Tokenizer.from_file(queries.MODEL)
    got = collect(texts, t.encode("text").alias("ids"), t.tokenize("text").alias("tokens"), t.decode(t.encode("text"), True).alias("plain"))
    for i, text in enumerate(TEXTS):
        e = oracle.encode(text)
        assert got[i].ids == e.ids and got[i].tokens == e.tokens
        assert got[i].plain == oracle.decode(e.ids, skip_special_tokens=True)
    assert t.spec.monotonic and len(t) == t.n_vocab == t.vocab_size == 50257
    assert t.all_special_tokens == [END] and t.all_special_ids == [50256] and t.pad_token_id == 50256
    assert t.get_vocab()["the"] == oracle.token_to_id("the") and repr(t) == "SparkAutoTokenizer(n_vocab=50257)"
    assert t.vocab().count() == 50257 and t.merges().count() == 50000 and t.added_tokens().count() == 1
    assert tables.rank_inversions(t.merges()).count() == 0


def isolated(pattern, pieces):
    out = []
    for p in pieces:
        last = 0
        for m in regex.finditer(pattern, p):
            if m.end() > m.start():
                out += [p[last : m.start()]] * (m.start() > last) + [m.group()]
                last = m.end()
        out += [p[last:]] * (last < len(p))
    return out


HAN = "[一-龥぀-ゟ゠-ヿ]+"


@pytest.mark.parametrize(
    "stages",
    [
        (NUMBER, word_grammar()),
        (f"{NUMBER}{{1,3}}", HAN, generic_grammar(3, True)),
        (r"[a-z]+(?=[A-Z])",),
        (rf"{NUMBER}+",),
    ],
)
def test_multi_split(spark, texts, stages):
    got = collect(texts, isolate(F.col("text"), stages).alias("p"))
    for i, text in enumerate(TEXTS):
        want = [text] if text else []
        for s in stages:
            want = isolated(s, want)
        assert got[i].p == want, repr(text)


def test_multi_split_equals_the_library(spark, texts):
    """Digits, a Han run, then words: against the same configuration in an independent library."""
    model = json.load(open(queries.MODEL))
    stages = [{"type": "Digits", "individual_digits": True}, split(HAN), split(generic_grammar(3, True)), LEVEL | {"use_regex": False, "trim_offsets": True}]
    model["pre_tokenizer"] = steps(*stages)
    oracle = tokenizers.Tokenizer.from_str(json.dumps(model))
    got = collect(texts, SparkTokenizer(parse(model), spark).encode_special("text").alias("ids"))
    assert all(got[i].ids == oracle.encode(t).ids for i, t in enumerate(TEXTS))


def test_long_gaps(spark):
    rows = [(0, "a" * 200_000), (1, " " * 50_000), (2, "日" * 60_000 + "1")]
    df = spark.createDataFrame(rows, "id int, text string")
    got = collect(df, isolate(F.col("text"), (NUMBER, HAN)).alias("p"))
    assert [[len(p) for p in got[i].p] for i in range(3)] == [[200_000], [50_000], [60_000, 1]]


@pytest.mark.parametrize("pattern", [r"\Aab", r"\G\d", r"x\z", r"x\Z", "[a-z&&[^b]]+"])
def test_rejected_patterns(pattern):
    with pytest.raises(ValueError):
        to_java(pattern)


def test_broken_pattern_is_rejected_at_load(spark, rank_table):
    with pytest.raises(ValueError):
        SparkTokenizer(ranks.spec_of_ranks(rank_table, "(unclosed"), spark)
    with pytest.raises(ValueError):
        SparkTokenizer(ranks.spec_of_ranks(rank_table, "x*"), spark)


TINY = {"vocab": {"a": 0, "b": 1, "ab": 2}, "merges": ["a b"]}


@pytest.mark.parametrize(
    "change",
    [
        {"normalizer": dict(type="Lowercase")},
        {"normalizer": dict(normalizers=[dict(type="NFC"), dict(type="Strip")], type="Sequence")},
        {"normalizer": dict(type="Replace", pattern=dict(Regex=" +"), content="▁")},
        {"model": TINY | dict(byte_fallback=True), "pre_tokenizer": dict(type="Punctuation")},
        {"pre_tokenizer": None},
        {"pre_tokenizer": dict(type="Whitespace")},
        {"pre_tokenizer": BARE},
        {"pre_tokenizer": steps(dict(type="Digits"))},
        {"pre_tokenizer": steps(split("a"), LEVEL)},
        {"pre_tokenizer": steps(split("a", "Removed"), BARE)},
        {"pre_tokenizer": steps(split(r"\Ga"), BARE)},
        {"pre_tokenizer": {"type": "Metaspace", "prepend_scheme": "never"}},
        {"model": {"vocab": [["a", -1.0]]}},
        {"model": {}},
        {"model": TINY | {"end_of_word_suffix": "</w>"}},
        {"model": TINY | {"dropout": 0.1}},
    ],
)
def test_rejected_configurations(change):
    with pytest.raises(UnsupportedTokenizer):
        parse({"model": TINY, "pre_tokenizer": LEVEL} | change)


def test_rejected_files(tmp_path):
    with pytest.raises(ValueError):
        load(f"{queries.VOCAB}/word_bpe_49k.json")
    (tmp_path / "x.json").write_text("{")
    with pytest.raises(ValueError):
        load(str(tmp_path / "x.json"))
    with pytest.raises(ValueError):
        load(str(tmp_path / "absent.json"))


def test_merge_ranks_skip_merges_without_tokens():
    spec = parse({"model": {"vocab": {"a": 0, "b": 1, "ab": 2, "ba": 3}, "merges": ["a c", ["b", "a"], "a b", "b a"]}, "pre_tokenizer": LEVEL})
    assert spec.merges.lookup() == {(1, 0): (0, 3), (0, 1): (1, 2)}


def test_missing_bytes_are_dropped_and_gaps_count(spark):
    model = {"model": TINY, "pre_tokenizer": LEVEL, "added_tokens": [{"id": 9, "content": "ab!", "special": True}]}
    t = SparkTokenizer(parse(model), spark)
    df = spark.createDataFrame([(0, "abcab b")], "id int, text string")
    assert collect(df, t.encode("text").alias("x"))[0].x == [2, 2, 1] and t.n_vocab == 10
    with pytest.raises(ValueError):
        t.encode_offsets("text")


def test_ignore_merges(spark):
    vocab = {c: i for i, c in enumerate("abc")} | {"abc": 7, "ab": 8}
    model = {"model": {"vocab": vocab, "merges": ["a b"], "ignore_merges": True}, "pre_tokenizer": LEVEL}
    df = spark.createDataFrame([(0, "abc"), (1, "abca")], "id int, text string")
    got = collect(df, SparkTokenizer(parse(model), spark).encode("text").alias("x"))
    assert got[0].x == [7] and got[1].x == [8, 2, 0]


@pytest.mark.parametrize("form", ["NFC", "NFD", "NFKC", "NFKD"])
def test_normalization(spark, form):
    model = json.load(open(queries.MODEL))
    model["normalizer"] = {"type": form}
    oracle = tokenizers.Tokenizer.from_str(json.dumps(model))
    bases = ["café", "naïve", "Ångström", "한국어", "ﬁne ①", "Việt Nam", "ά", "й", f"é{END}é", "plain"]
    rows = [(i, unicodedata.normalize(f, b)) for i, (b, f) in enumerate((b, f) for b in bases for f in ("NFC", "NFD"))]
    df = spark.createDataFrame(rows, "id int, text string")
    t = SparkTokenizer(parse(model), spark)
    got = collect(df, t.encode_special("text").alias("x"), t.encode("text").alias("o"), t.count("text").alias("n"))
    for i, text in rows:
        assert got[i].x == oracle.encode(text).ids and got[i].n == len(got[i].o)
    changed = next(text for _, text in rows if unicodedata.normalize(form, text) != text)
    with pytest.raises(Exception, match="normalized already"):
        spark.createDataFrame([(changed,)], "text string").select(t.encode_offsets("text")).collect()


def test_byte_fallback_equals_sentencepiece(spark):
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    t = SparkTokenizer(queries.piece_spec(), spark)
    assert not t.spec.monotonic
    texts = [x for x in fuzz(3, pool=[*"ab  the\n\té你😀", "ing", "<0x41>"])]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id int, text string")
    got = collect(df, t.encode("text").alias("x"), t.encode("text", prefix=False).alias("bare"), t.decode(t.encode("text")).alias("back"))
    for i, x in enumerate(texts):
        assert got[i].x == p.encode(x) and got[i].back == x, repr(x)
    assert t.encoder.tables.strip


@pytest.mark.parametrize("scheme,want", [("always", [2, 9, 2]), ("first", [2, 9, 0])])
def test_prefix_around_added_tokens(spark, scheme, want):
    model = {
        "model": {"vocab": {"a": 0, "▁": 1, "▁a": 2} | {f"<0x{b:02X}>": 10 + b for b in range(256)}, "byte_fallback": True, "merges": ["▁ a"]},
        "pre_tokenizer": dict(type="Metaspace", prepend_scheme=scheme),
        "added_tokens": [{"id": 9, "content": "<x>", "special": True}],
    }
    t = SparkTokenizer(parse(model), spark)
    df = spark.createDataFrame([(0, "a<x>a")], "id int, text string")
    assert collect(df, t.encode_special("text").alias("x"))[0].x == want


def test_added_tokens_match_longest_and_strip(spark, rank_table):
    from sparkloom.plans.spec import AddedToken

    spec = ranks.spec_of_ranks(rank_table, word_grammar())
    spec = replace(spec, added=(AddedToken(60000, "<a>", True), AddedToken(60001, "<a><b>", False, True, True), AddedToken(60002, "<c>", True, False, True)))
    t = SparkAutoTokenizer(spec, spark=spark)
    df = spark.createDataFrame([(0, "x <a><b>  y<a>"), (1, "<c> \n<a>"), (2, "<a")], "id int, text string")
    got = collect(df, t.encode_special("text").alias("x"), t.decode(t.encode_special("text"), True).alias("d"))
    x, y = rank_table[b"x"], rank_table[b"y"]
    assert got[0].x == [x, 60001, y, 60000] and got[0].d == "x<a><b>y"
    assert got[1].x == [60002, 60000] and got[2].x == [rank_table[b"<"], rank_table[b"a"]]


def test_decode_is_lossy_and_strict(spark):
    t = SparkTokenizer.from_ranks(queries.RANKS, word_grammar(), {END: 50256}, spark=spark)
    oracle = tiktoken.Encoding("o", pat_str=word_grammar(), mergeable_ranks=ranks.read_ranks(queries.RANKS), special_tokens={END: 50256})
    rng = random.Random(8)
    rows = [(i, [rng.randrange(50257) for _ in range(rng.randrange(60))]) for i in range(300)]
    rows += [(300, [50256, 99999, 4_000_000_000, 198]), (301, None)]
    df = spark.createDataFrame(rows, "id int, ids array<long>")
    got = {r.id: r.d for r in df.select("id", t.decode("ids").alias("d")).collect()}
    assert all(got[i] == oracle.decode(ids) for i, ids in rows[:300])
    assert got[300] == f"{END}\n" and got[301] is None
    for bad in (-1, 2**32, 2**32 + 123):
        with pytest.raises(Exception, match="between 0 and"):
            spark.createDataFrame([([bad],)], "ids array<long>").select(t.decode("ids")).collect()


def loop_truncate(a, b, budget):
    a, b = list(range(a)), list(range(b))
    while (a or b) and budget < len(b) + len(a):
        if len(a) >= len(b) and a:
            a.pop()
        else:
            b.pop()
    return len(a), len(b)


def test_pair_truncation_closed_form(spark):
    rows = [(a, b) for a in range(10) for b in range(10)]
    df = spark.createDataFrame(rows, "a int, b int").select("a", "b", F.sequence(F.lit(1), "a").alias("x"), F.sequence(F.lit(1), "b").alias("y"))
    df = df.withColumn("x", F.slice("x", 1, F.col("a"))).withColumn("y", F.slice("y", 1, F.col("b")))
    df = df.withColumn("x", F.when(F.col("a") == 0, F.array().cast("array<int>")).otherwise(F.col("x"))).withColumn("y", F.when(F.col("b") == 0, F.array().cast("array<int>")).otherwise(F.col("y")))
    for budget in (0, 1, 4, 7, 9, 12, 30):
        x, y = post.truncate_pair(F.col("x"), F.col("y"), budget)
        for r in df.select("a", "b", F.size(x).alias("p"), F.size(y).alias("q")).collect():
            assert (r.p, r.q) == loop_truncate(r.a, r.b, budget)


def auto(spark, processor, **config):
    return queries._auto(spark, processor, **config)


BERT = {"type": "BertProcessing"}


@pytest.mark.parametrize("side", ["left", "right"])
def test_call_pads_and_truncates(spark, texts, side):
    t = auto(spark, queries._ROBERTA, pad_token=END, padding_side=side, truncation_side=side)
    some = texts.where("length(text) < 60")
    plain = collect(some, t.encode("text", add_special_tokens=False).alias("x"))
    fixed = collect(t(some, "text", padding="max_length", truncation=True, max_length=12, return_token_type_ids=True), "input_ids", "attention_mask", "token_type_ids")
    free = collect(t(some, "text", padding=True), "input_ids", "attention_mask")
    width = max(len(r.x) for r in plain.values()) + 2
    for i, r in plain.items():
        body = r.x[:10] if side == "right" else r.x[max(0, len(r.x) - 10) :]
        ids, fill = [50256, *body, 50256], 12 - len(body) - 2
        want = ids + [50256] * fill if side == "right" else [50256] * fill + ids
        assert fixed[i].input_ids == want and sum(fixed[i].attention_mask) == len(ids) and fixed[i].token_type_ids == [0] * 12
        assert len(free[i].input_ids) == width == len(free[i].attention_mask) and sum(free[i].attention_mask) == len(r.x) + 2
    with pytest.raises(ValueError):
        t(some, "text", padding="max_length")


def test_templates(spark):
    spec = parse({"model": {"vocab": {"[CLS]": 5, "[SEP]": 6, "<s>": 7, "</s>": 8, "a": 0}, "merges": []}, "pre_tokenizer": LEVEL})
    a, b = F.array(F.lit(1), F.lit(2)), F.array(F.lit(3))
    row = spark.range(1)

    def both(processor, pair, **config):
        t = post.template(replace(spec, post=processor, config=config))
        ids, types = post.around(t, a, b if pair else None)
        r = row.select(ids.alias("i"), types.alias("t")).first()
        return r.i, r.t

    assert both(BERT, False) == ([5, 1, 2, 6], [0] * 4) and both(BERT, True) == ([5, 1, 2, 6, 3, 6], [0, 0, 0, 0, 1, 1])
    roberta = {"type": "RobertaProcessing", "cls": ["<s>", 7], "sep": ["</s>", 8]}
    assert both(roberta, False) == ([7, 1, 2, 8], [0] * 4) and both(roberta, True) == ([7, 1, 2, 8, 8, 3, 8], [0] * 7)
    sequence = {"type": "Sequence", "processors": [{"type": "ByteLevel"}, queries._PAIRED]}
    assert both(sequence, True) == ([50257, 1, 2, 50258, 50256, 3, 50258, 50256], [0] * 5 + [1] * 3) and both(sequence, False)[0] == [50257, 1, 2]
    flags = {"bos_token": "<s>", "eos_token": {"content": "</s>"}, "add_bos_token": True, "add_eos_token": True}
    assert both({"type": "ByteLevel"}, False, **flags)[0] == [7, 1, 2, 8] and both({"type": "ByteLevel"}, True, **flags)[0] == [1, 2, 3]
    assert both(None, False, **flags)[0] == [1, 2]


def test_encode_batch(spark, texts):
    t = SparkTokenizer(queries.MODEL, spark)
    out = collect(t.encode_batch(texts.where("id between 0 and 20"), "text", 7, 1), "input_ids", "attention_mask")
    ids = collect(texts, t.encode("text").alias("x"))
    for i in range(21):
        own = ids[i].x[:7]
        assert out[i].input_ids == own + [1] * (7 - len(own)) and list(out[i].attention_mask) == [1] * len(own) + [0] * (7 - len(own))
    empty = t.encode_batch(texts.limit(0), "text")
    assert empty.count() == 0


def test_lookups(spark):
    t = SparkAutoTokenizer.from_file(queries.MODEL, {"bos_token": END, "unk_token": {"content": "nope"}, "model_max_length": 10**30}, spark=spark)
    assert t.bos_token_id == 50256 and t.unk_token_id is None and t.eos_token_id is None and t.model_max_length is None
    df = spark.createDataFrame([(0, [0, 50256, 999999], ["!", "zzzzqq", END])], "id int, i array<int>, s array<string>")
    r = collect(df, t.convert_ids_to_tokens("i").alias("a"), t.convert_ids_to_tokens("i", True).alias("b"), t.convert_tokens_to_ids("s").alias("c"))[0]
    assert r.a == ["!", END, None] and r.b == ["!", None] and r.c == [0, None, 50256]


def test_rank_files(spark, tmp_path, rank_table):
    assert {bytes(r.bytes): r["rank"] for r in ranks.ranks_table(spark, queries.RANKS).collect()} == rank_table
    small = {bytes([b]): b for b in range(256)} | {b"th": 256, b"he": 257, b"the": 258}
    path = tmp_path / "tiktoken.model"
    path.write_bytes(b"\n".join(base64.b64encode(t) + f" {r}".encode() for t, r in small.items()) + b"\n")
    assert ranks.read_ranks(str(path)) == small
    with pytest.raises(ValueError):
        ranks.read_ranks(str(path), "0" * 64)
    with pytest.raises(ValueError):
        ranks.named("gpt-4", str(path))
    assert ranks.encoding_name("gpt-4o") == "o200k_base" and ranks.named("gpt2", str(path), check=False).size == 50257
    with pytest.raises(ValueError):
        ranks.encoding_name("unheard-of")
    with pytest.raises(ValueError):
        ranks.spec_of_ranks(small, "")
    config = {"added_tokens_decoder": {"300": {"content": "<e>"}}, "auto_map": {"AutoTokenizer": ["m.Tok", None]}, "eos_token": "<e>"}
    (tmp_path / "tokenizer_config.json").write_text(json.dumps(config))
    (tmp_path / "special_tokens_map.json").write_text(json.dumps({"eos_token": "old", "pad_token": "<e>"}))
    with pytest.raises(ValueError):
        ranks.from_folder(str(tmp_path))
    (tmp_path / "m.py").write_text('class Tok:\n    pat_str = "|".join([r"\\p{L}+", "[^a]" + "+"])\n')
    t = SparkAutoTokenizer.from_pretrained(str(tmp_path), spark=spark)
    assert t.spec.stages == (r"\p{L}+|[^a]+",) and t.eos_token_id == 300 and t.pad_token == "<e>"
    again = SparkAutoTokenizer.from_rank_file(str(path), r"\p{L}+|[^a]+", spark=spark)
    df = spark.createDataFrame([(0, "the<e>he")], "id int, text string")
    assert collect(df, t.encode("text").alias("x"))[0].x == collect(df, again.encode("text").alias("x"))[0].x == [258, 300, 257]


@pytest.mark.parametrize("pattern", [None, generic_grammar(3)])
def test_exported_json_gives_the_same_ids(spark, tmp_path, texts, pattern):
    full = ranks.read_ranks(queries.RANKS)
    small = {t: r for t, r in full.items() if r < 3000}
    path = tmp_path / "r"
    path.write_bytes(b"\n".join(base64.b64encode(t) + f" {r}".encode() for t, r in small.items()))
    exported = tmp_path / "t.json"
    exported.write_text(json.dumps(ranks.to_tokenizer_json(small, pattern, {END: 5000})))
    a = SparkTokenizer(str(exported), spark)
    b = SparkTokenizer(ranks.spec_of_ranks(small, pattern or word_grammar(), {END: 5000}), spark)
    assert collect(texts, a.encode_special("text").alias("x")) == collect(texts, b.encode_special("text").alias("x"))
    one = ranks.cached_json(str(path), generic_grammar(3), folder=str(tmp_path / "cache"))
    assert one == ranks.cached_json(str(path), generic_grammar(3), folder=str(tmp_path / "cache")) and load(one).size == 3000


@pytest.mark.parametrize("source,want", [("pat_str: str = 'a' + 'b'", "ab"), ("self.pat_str = '|'.join(('x', 'y'))", "x|y"), ("pat_str = f()", None), ("def (", None), ("other = 'a'", None)])
def test_static_patterns(source, want):
    assert ranks.pattern_of_source(source) == want


def test_surface_alphabet():
    chars = to_surface(bytes(range(256)))
    assert len(set(chars)) == 256 and chars[32] == "Ġ" and chars[65] == "A" and chars[10] == "Ċ"


def test_chat(spark):
    rows = [(1, 1, "assistant", "yo "), (1, 0, "user", "hi"), (2, 0, "system", None)]
    talks = chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in talks.select("conv_id", chat.render(F.col("messages"), "chatml", True).alias("c"), chat.render(F.col("messages"), "header").alias("h"), chat.render(F.col("messages"), "inst").alias("i")).collect()}
    assert got[1].c == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo <|im_end|>\n<|im_start|>assistant\n"
    assert got[1].h.startswith("<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n\nhi<|eot_id|>") and got[1].i == "<s>[INST] hi [/INST] yo</s>"
    assert got[2].c == "<|im_start|>system\n<|im_end|>\n<|im_start|>assistant\n"
    with pytest.raises(ValueError):
        chat.render(F.col("messages"), "none")
    with pytest.raises(ValueError):
        chat.choose(None)
    many = [{"name": "default", "template": "d"}, {"name": "tool_use", "template": "t"}]
    assert chat.choose(many) == "d" and chat.choose(many, True) == "t" and chat.choose([{"name": "x", "template": "y"}]) == "y"
    bad = chat.conversations(spark.createDataFrame([(1, 0, "robot", "x")], "conv_id long, turn long, role string, text string"))
    with pytest.raises(Exception, match="unknown role"):
        bad.select(chat.render(F.col("messages"), "inst")).collect()


def test_sql_functions(spark, texts):
    t = SparkTokenizer(queries.MODEL, spark)
    t.register("tk")
    texts.createOrReplaceTempView("texts")
    want = collect(texts, t.encode("text").alias("x"))
    for r in spark.sql("select id, text, tk_encode(text) as x, tk_count(text) as n, tk_decode(tk_encode(text)) as d from texts").collect():
        assert r.x == want[r.id].x and r.d == r.text and r.n == (None if r.x is None else len(r.x))
    spans = {r.id: r.o for r in spark.sql("select id, tk_offsets(text) as o from texts").collect()}
    assert spans == {r.id: None if r.id < 0 else r.s for r in texts.select("id", t.encode_offsets("text").spans.alias("s")).collect()}
    exploded = spark.sql("select t.pos, t.id, t.start, t.end from texts, lateral tk_explode(text) t where texts.id = 3 order by t.pos").collect()
    assert [r.id for r in exploded] == want[3].x and exploded[-1].end == len(TEXTS[3].encode())


@pytest.mark.parametrize("kind", ["word", "generic", "camel", "multi", "marks", "forms"])
def test_sql_functions_equal_columns(spark, rank_table, kind):
    """The SQL functions split by the same expressions as the columns, for every kind of model."""
    pool = [*POOL, "it'ſo", "'ſ", "ǅ", "é", "e\u0301", "ﬁ", "<0x41>"]
    rows = [(i, x) for i, x in enumerate(fuzz(11, 1500, 30, pool))] + [(-1, None)]
    df = spark.createDataFrame(rows, "id int, text string")
    if kind == "marks":
        spec = queries.piece_spec()
    elif kind == "forms":
        spec = replace(ranks.spec_of_ranks(rank_table, generic_grammar(3)), forms=("NFC",))
    else:
        spec = ranks.spec_of_ranks(rank_table, {"word": word_grammar(), "generic": generic_grammar(3), "camel": camel_grammar(3), "multi": NUMBER}[kind])
        spec = replace(spec, stages=(NUMBER, HAN, generic_grammar(3, True))) if kind == "multi" else spec
    t = SparkTokenizer(spec, spark)
    t.register("same")
    df.createOrReplaceTempView("same_texts")
    want = collect(df, t.encode("text").alias("x"), t.count("text").alias("n"))
    got = {r.id: r for r in spark.sql("select id, same_encode(text) as x, same_count(text) as n from same_texts").collect()}
    assert {i: (r.x, r.n) for i, r in got.items()} == {i: (r.x, r.n) for i, r in want.items()}


def test_with_special_tokens(spark):
    t = SparkTokenizer(queries.MODEL, spark)
    other = t.with_special_tokens({"<a>": 70000}, rstrip=True)
    df = spark.createDataFrame([(0, f"<a>  x{END}")], "id int, text string")
    assert collect(df, other.encode_special("text").alias("x"))[0].x[:2] == [70000, t.spec.ids["x"]]
    assert collect(df, t.encode_special("text").alias("x"))[0].x[-1] == 50256 and t.spec.added != other.spec.added


def test_native_split_equals_the_other(spark, rank_table):
    """Added tokens are found by native expressions where none swallows white space, with the same result."""
    from sparkloom.operators.encode import native_added, split_added
    from sparkloom.plans.spec import AddedToken

    added = (AddedToken(1, "<a>"), AddedToken(2, "<a><b>"), AddedToken(3, "$x|"), AddedToken(4, "^ .*"), AddedToken(5, "日本"), AddedToken(6, "\\E"))
    t = SparkTokenizer(replace(ranks.spec_of_ranks(rank_table, word_grammar()), added=added), spark)
    rows = [(i, x) for i, x in enumerate(fuzz(12, 1000, 14, ["<a>", "<b>", "<", "$x|", "^ .*", "日", "本", "\\E", " ", "\n", "x"]))] + [(-1, None)]
    df = spark.createDataFrame(rows, "id int, text string")
    got = collect(df, native_added(F.col("text"), added).alias("a"), split_added(F.col("text"), t.encoder.shared).alias("b"))
    assert all(r.a == r.b for r in got.values())


def test_packing(spark):
    from sparkloom.operators import packing

    rng = random.Random(3)
    rows = [(i * 3 % 1009, rng.choice([0, 1, 5, 70, 400])) for i in range(1000)]
    df = spark.createDataFrame(rows, "o long, n long").repartition(5)
    start, want = 0, {}
    for o, n in sorted(rows):
        want[o] = (start // 128, start % 128, (start + n - 1) // 128 if n else None)
        start += n
    assert {r.o: (r.first_sequence, r.offset, r.last_sequence) for r in packing.packed(df, "n", "o", 128).collect()} == want
    assert packing.packed(df.limit(0), "n", "o", 128).count() == 0
    assert packing.packed(df.limit(1), "n", "o", 128).first().first_sequence == 0


def test_tensors(spark, texts):
    t = SparkTokenizer(queries.MODEL, spark)
    out = t.encode_batch(texts.where("id between 0 and 20"), "text", 7, 1)
    want = collect(out, "input_ids")
    got = np.concatenate([x["input_ids"] for x in t.tensors(out.orderBy("id"), ("input_ids",))])
    assert got.dtype == np.int64 and got.tolist() == [want[i].input_ids for i in range(21)]
    with pytest.raises(ValueError):
        next(t.tensors(out, ("input_ids",), "tf"))
    with pytest.raises(Exception, match="one length"):
        list(t.tensors(texts.select("id", t.encode("text").alias("input_ids")), ("input_ids",)))


def test_vocab_diff(spark):
    a = spark.createDataFrame([(0, b"a"), (1, b"b"), (2, b"c")], "id int, bytes binary")
    b = spark.createDataFrame([(0, b"a"), (5, b"b"), (2, b"d")], "id int, bytes binary")
    assert {(bytes(r.bytes), r.id_a, r.id_b) for r in tables.vocab_diff(a, b).collect()} == {(b"b", 1, 5), (b"c", 2, None), (b"d", None, 2)}


@pytest.mark.parametrize(
    "source,want",
    [
        ("a\n{% if x %}\nb\n{% endif %}\nc", "a\nb\nc"),
        ("  {% if not x %}\n q\n  {% elif x == 'v' %}\n r\n  {% else %}\n{% endif %}\n!", " r\n!"),
        ("{{- x -}}  y", "vy"),
        ("{% for i in l %}{{ i }}{% if not loop.last %}, {% endif %}{% else %}none{% endfor %}", "1, 2, 3"),
        ("{% for i in l if i > 5 %}{{ i }}{% else %}none{% endfor %}", "none"),
        ("{% for k, v in d.items() %}{{ k ~ v }};{% endfor %}", "p1;q2;"),
        ("{% set y = l[1:] %}{{ y | join('-') }}{{ l[-1] }}{{ l | length }}", "2-333"),
        ("{% set ns = namespace(n=0) %}{% for i in l %}{% set ns.n = ns.n + i * 2 %}{% endfor %}{{ ns.n // 5 }} {{ ns.n % 5 }}", "2 2"),
        ("{% set z = 1 %}{% for i in l %}{% set z = 5 %}{% endfor %}{{ z }}", "1"),
        ("{{ 'yes' if d.p is defined and d.r is not defined else 'no' }}", "yes"),
        ("{{ 1 + 2 * 3 - -1 }}{{ 'a' 'b' + \"c\\n\" }}", "8abc\n"),
        ("{{ d['p'] in l and 'x' not in x }}{{ none is none }}{{ x is string }}", "TrueTrueTrue"),
        ("{{ gone.more | default('d') }}{{ gone }}{{ x.upper() }}{{ x.__class__ }}", "dV"),
        ("{# note #}\n{{ d | tojson }}", '{"p": 1, "q": 2}'),
        ("{{ [1, (2, 3), {'a': true}] }}", "[1, (2, 3), {'a': True}]"),
    ],
)
def test_template_language(source, want):
    assert chat.compiled(source).render(x="v", l=[1, 2, 3], d={"p": 1, "q": 2}) == want


@pytest.mark.parametrize("source", ["{% macro f() %}{% endmacro %}", "{{ x | nope }}", "{{ x is nope }}", "{% for %}", "{{ 1 + }}", "{% if x %}", "{{ x", "{% endif %}", "{{ x y }}"])
def test_faulty_templates(source):
    with pytest.raises(ValueError):
        chat.compiled(source)


def test_template_errors_reach_the_caller():
    with pytest.raises(ValueError, match="bad role"):
        chat.compiled("{{ raise_exception('bad role') }}").render()
    with pytest.raises(ValueError):
        chat.compiled("{% set x.y = 1 %}").render(x={"y": 0})


@pytest.mark.parametrize("kind", ["WordLevel", "WordPiece", "Unigram"])
def test_other_models_are_rejected(kind):
    with pytest.raises(UnsupportedTokenizer):
        parse({"model": TINY | {"type": kind}, "pre_tokenizer": LEVEL})


def test_unknown_tokens():
    full = {c: i for i, c in enumerate(to_surface(bytes(range(256))))}
    assert parse({"model": {"vocab": full, "merges": [], "unk_token": to_surface(b"a")}, "pre_tokenizer": LEVEL}).size == 256
    with pytest.raises(UnsupportedTokenizer):
        parse({"model": TINY | {"unk_token": "a"}, "pre_tokenizer": LEVEL})


def test_frequency(spark, texts):
    from collections import Counter

    t = SparkTokenizer(queries.MODEL, spark)
    want = Counter(i for r in collect(texts, t.encode("text").alias("x")).values() for i in r.x or [])
    assert {r.id: r.n for r in t.token_frequency(texts, "text").collect()} == want


def test_plan_has_no_shuffle(spark):
    """Encoding is a map: native splitting and one Arrow step, and only the columns it needs are read."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    t = SparkTokenizer(queries.MODEL, spark)
    plan = df.select("doc_id", t.encode("text").alias("x"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1 and "lang" not in plan


def test_one_character_pieces_skip_later_splits(spark):
    """Pieces of one character stay as they are, without a regular expression; the pieces are the same."""
    from sparkloom.functions.pretokenize import stage_pattern

    rows = [("",), (None,), ("a",), ("\U0001f600",), ("12345",), ("日a本 b1の2é́ ć\r\n  x",), ("a日" * 50,), (" \n",)]
    df = spark.createDataFrame(rows, "text string").repartition(2)
    stages = (r"\p{N}{1,3}", "[一-龥぀-ゟ゠-ヿ]+", generic_grammar(3, True))

    def split(p):
        return lambda x: F.regexp_extract_all(x, F.lit(stage_pattern(p)), F.lit(0))

    plain = split(stages[0])(F.col("text"))
    for p in stages[1:]:
        plain = F.flatten(F.transform(plain, split(p)))
    got = df.select(isolate(F.col("text"), stages).alias("a"), plain.alias("b"))
    assert all(r.a == r.b for r in got.collect())
    assert "char_length(lambda" in got.select("a")._jdf.queryExecution().optimizedPlan().toString()
