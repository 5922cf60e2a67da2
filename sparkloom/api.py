"""Tokenizers for DataFrames: ``SparkTokenizer`` (ids only) and ``SparkAutoTokenizer`` (a model's own
special tokens, templates, padding and chat prompts)."""

from __future__ import annotations

import os
from collections.abc import Iterator
from copy import copy
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.pretokenize import check_pattern
from sparkloom.operators import chat, decode, packing, post, sqlfunctions
from sparkloom.operators.encode import Encoder, looked_up, token_frequency
from sparkloom.plans.spec import AddedToken, Spec, load
from sparkloom.sources import ranks, tables


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


class SparkTokenizer:
    """Encoding and decoding of text columns with one tokenizer."""

    def __init__(self, path_or_spec: str | Spec, spark: SparkSession | None = None, engine: str = "batch") -> None:
        self.spark = spark or SparkSession.builder.getOrCreate()
        self.spec = path_or_spec if isinstance(path_or_spec, Spec) else load(path_or_spec)
        for pattern in self.spec.stages:
            check_pattern(self.spark, pattern)
        self.encoder = Encoder(self.spark, self.spec, engine)

    @classmethod
    def from_ranks(cls, path: str, pattern: str, specials: dict[str, int] | None = None, **kw) -> SparkTokenizer:
        """From a rank file and its split pattern."""
        return cls(ranks.spec_of_ranks(ranks.read_ranks(path), pattern, specials), **kw)

    @classmethod
    def from_encoding(cls, name: str, path: str, check: bool = True, **kw) -> SparkTokenizer:
        """A named encoding, or the one of a named model, with its rank file."""
        return cls(ranks.named(name, path, check), **kw)

    @classmethod
    def from_pretrained(cls, folder: str, **kw) -> SparkTokenizer:
        """From a model's local folder."""
        return cls(ranks.from_folder(folder), **kw)

    def encode(self, text: Column | str, prefix: bool = True) -> Column:
        """array<int>; special tokens in the text are ordinary text."""
        return self.encoder.ids(_column(text), prefix)

    def encode_special(self, text: Column | str) -> Column:
        """array<int>; added tokens in the text become their ids."""
        return self.encoder.special(_column(text))

    def count(self, text: Column | str) -> Column:
        """Number of ids."""
        return self.encoder.count(_column(text))

    def encode_packed(self, text: Column | str) -> Column:
        """Ids as little-endian 32-bit integers."""
        return self.encoder.packed(_column(text))

    def encode_offsets(self, text: Column | str) -> Column:
        """struct(ids, spans) with byte spans."""
        return self.encoder.offsets(_column(text))

    def chunks(self, text: Column | str) -> Column:
        """Pre-tokens."""
        return self.encoder.chunks(_column(text))

    def decode(self, ids: Column | str) -> Column:
        return decode.decode(self.encoder, _column(ids))

    def decode_packed(self, packed: Column | str) -> Column:
        return decode.decode_packed(self.encoder, _column(packed))

    def encode_batch(self, df: DataFrame, text: str, max_length: int | None = None, pad_id: int = 0, batch: str | None = None) -> DataFrame:
        """The frame with ``input_ids`` and ``attention_mask`` of one width: ``max_length``, which cuts
        on the right, or the longest row's (of each ``batch``, if named)."""
        out = df.withColumn("input_ids", self.encode(text))
        if max_length is None:
            out, width = post.longest(out, "input_ids", batch)
        else:
            out, width = out.withColumn("input_ids", post.truncate(F.col("input_ids"), max_length)), F.lit(max_length)
        out = out.withColumn("attention_mask", post.mask(F.col("input_ids"), width).cast("array<tinyint>"))
        return out.withColumn("input_ids", post.pad(F.col("input_ids"), width, pad_id)).drop("_width")

    def token_frequency(self, df: DataFrame, text: str) -> DataFrame:
        """(id, n) over a column of texts."""
        return token_frequency(df, self.encoder, F.col(text))

    def vocab(self) -> DataFrame:
        return tables.vocab_table(self.spark, self.spec)

    def merges(self) -> DataFrame:
        return tables.merges_table(self.spark, self.spec)

    def added_tokens(self) -> DataFrame:
        return tables.added_table(self.spark, self.spec)

    @property
    def n_vocab(self) -> int:
        return self.spec.size

    def __len__(self) -> int:
        return self.spec.size

    def __repr__(self) -> str:
        return f"{type(self).__name__}(n_vocab={self.spec.size})"

    def register(self, prefix: str = "tok") -> None:
        """SQL functions {prefix}_encode, {prefix}_count, {prefix}_offsets, {prefix}_decode and {prefix}_explode."""
        sqlfunctions.register(self.encoder, prefix)

    def with_special_tokens(self, tokens: dict[str, int], special: bool = True, lstrip: bool = False, rstrip: bool = False, prepend: str | None = None) -> SparkTokenizer:
        """A tokenizer of the same kind whose added tokens are these; ``prepend`` says where space marks go
        around them (none, always, first)."""
        added = tuple(AddedToken(i, t, special, lstrip, rstrip) for t, i in tokens.items())
        other = copy(self)
        other.spec = replace(self.spec, added=added, prepend=self.spec.prepend if prepend is None else prepend)
        other.encoder = Encoder(self.spark, other.spec, self.encoder.engine)
        return other

    def pack(self, df: DataFrame, text: str, order: str, size: int) -> DataFrame:
        """The frame with each row's place in sequences of ``size`` ids, filled in the order of ``order``."""
        return packing.packed(df.withColumn("n_tokens", self.count(text)), "n_tokens", order, size)

    def tensors(self, df: DataFrame, columns: tuple[str, ...] = ("input_ids", "attention_mask"), kind: str = "np") -> Iterator[dict]:
        """Matrices of a frame of padded rows, batch by batch: numpy arrays, or torch tensors ("pt")."""
        return packing.tensors(df, columns, kind)


class SparkAutoTokenizer(SparkTokenizer):
    """A tokenizer with its model's configuration."""

    def __init__(self, path_or_spec: str | Spec, config: dict | str | None = None, spark: SparkSession | None = None, engine: str = "batch") -> None:
        spec = path_or_spec if isinstance(path_or_spec, Spec) else load(path_or_spec, config)
        super().__init__(spec, spark, engine)
        c = spec.config
        names = ("bos", "eos", "unk", "sep", "cls", "mask")
        self.bos_token, self.eos_token, self.unk_token, self.sep_token, self.cls_token, self.mask_token = (post.token_text(c.get(f"{n}_token")) for n in names)
        usual = (t for t in "<pad> [PAD] <|pad|> <|endoftext|>".split() if t in spec.ids)
        self.pad_token = post.token_text(c.get("pad_token")) or self.eos_token or next(usual, None)
        limit = c.get("model_max_length")
        self.model_max_length = limit if isinstance(limit, int) and limit < 10**15 else None
        self.padding_side, self.truncation_side = (c.get(f"{what}_side", "right") for what in ("padding", "truncation"))
        self.template = post.template(spec)
        self.chat_template = c.get("chat_template")

    @classmethod
    def from_file(cls, path: str, config: dict | str | None = None, **kw) -> SparkAutoTokenizer:
        return cls(path, config, **kw)

    @classmethod
    def from_rank_file(cls, path: str, pattern: str, specials: dict[str, int] | None = None, config: dict | None = None, **kw) -> SparkAutoTokenizer:
        """From a rank file; special tokens are by default those of the configuration."""
        if not pattern:
            raise ValueError("rank files hold no split pattern; it must be given")
        folder = os.path.dirname(os.path.abspath(path))
        if config is None and os.path.exists(os.path.join(folder, "tokenizer_config.json")):
            import json

            with open(os.path.join(folder, "tokenizer_config.json"), encoding="utf-8") as f:
                config = json.load(f)
        specials = ranks.specials_of_config(config or {}) if specials is None else specials
        return cls(ranks.spec_of_ranks(ranks.read_ranks(path), pattern, specials, config), **kw)

    def _id(self, token: str | None) -> int | None:
        return self.spec.ids.get(token) if token is not None else None

    bos_token_id = property(lambda self: self._id(self.bos_token))
    eos_token_id = property(lambda self: self._id(self.eos_token))
    pad_token_id = property(lambda self: self._id(self.pad_token))
    unk_token_id = property(lambda self: self._id(self.unk_token))
    vocab_size = property(lambda self: self.spec.size)
    all_special_ids = property(lambda self: self.spec.special_ids)
    all_special_tokens = property(lambda self: [self.spec.surface[i] for i in self.spec.special_ids])

    def get_vocab(self) -> dict[str, int]:
        return dict(self.spec.ids)

    def encode(self, text: Column | str, text_pair: Column | str | None = None, add_special_tokens: bool = True) -> Column:
        """array<int> with added tokens found and the model's template around."""
        return self.encoded(text, text_pair, add_special_tokens)[0]

    def encoded(self, text: Column | str, text_pair: Column | str | None = None, add_special_tokens: bool = True, max_length: int | None = None) -> tuple[Column, Column]:
        """(ids, type ids); with ``max_length`` the content is cut so that the template still fits."""
        a = self.encode_special(text)
        b = None if text_pair is None else self.encode_special(text_pair)
        t = self.template if add_special_tokens else post._PLAIN
        if max_length:
            budget = max(0, max_length - t.overhead(b is not None))
            if b is None:
                a = post.truncate(a, budget, self.truncation_side)
            else:
                a, b = post.truncate_pair(a, b, budget, self.truncation_side)
        return post.around(t, a, b)

    def __call__(
        self, df: DataFrame, text: str, text_pair: str | None = None, add_special_tokens: bool = True, padding: bool | str = False,
        truncation: bool = False, max_length: int | None = None, return_attention_mask: bool = True,
        return_token_type_ids: bool = False, batch: str | None = None,
    ) -> DataFrame:
        """The frame with input_ids and, as asked, attention_mask and token_type_ids.

        ``padding``: True for the longest row (of each ``batch``), "max_length" for that width.
        """
        if padding == "max_length" and max_length is None:
            raise ValueError("padding to max_length needs max_length")
        a = df.withColumn("_a", self.encode_special(text))
        b = None
        if text_pair is not None:
            a, b = a.withColumn("_b", self.encode_special(text_pair)), F.col("_b")
        t = self.template if add_special_tokens else post._PLAIN
        left = F.col("_a")
        if truncation and max_length:
            budget = max(0, max_length - t.overhead(b is not None))
            if b is None:
                left = post.truncate(left, budget, self.truncation_side)
            else:
                left, b = post.truncate_pair(left, b, budget, self.truncation_side)
        ids, types = post.around(t, left, b)
        out = a.withColumn("token_type_ids", types).withColumn("input_ids", ids).drop("_a", "_b")
        width: Column = F.size("input_ids")
        if padding == "max_length":
            width = F.lit(max_length)
        elif padding:
            out, width = post.longest(out, "input_ids", batch)
        side = self.padding_side
        out = out.withColumn("attention_mask", post.mask(F.col("input_ids"), width, side))
        out = out.withColumn("token_type_ids", post.pad(F.col("token_type_ids"), width, 0, side))
        out = out.withColumn("input_ids", post.pad(F.col("input_ids"), width, self.pad_token_id or 0, side)).drop("_width")
        drop = [c for c, keep in (("attention_mask", return_attention_mask), ("token_type_ids", return_token_type_ids)) if not keep]
        return out.drop(*drop)

    def decode(self, ids: Column | str, skip_special_tokens: bool = False) -> Column:
        return decode.decode(self.encoder, _column(ids), skip_special_tokens)

    def tokenize(self, text: Column | str, add_special_tokens: bool = False) -> Column:
        """Token strings of a text."""
        return self.convert_ids_to_tokens(self.encode(text, None, add_special_tokens))

    def convert_ids_to_tokens(self, ids: Column | str, skip_special_tokens: bool = False) -> Column:
        """Token strings of ids, null for unknown ones."""
        names, special = self.spec.surface, self.spec.special_ids if skip_special_tokens else []
        own = self.spark.sparkContext.broadcast((pa.array(list(names), pa.int64()), pa.array(list(names.values()), pa.string())))

        @F.arrow_udf("array<string>")
        def run(lists: pa.Array) -> pa.Array:
            return looked_up(lists, *own.value, special)

        return run(_column(ids))

    def convert_tokens_to_ids(self, tokens: Column | str) -> Column:
        """Ids of token strings, null for unknown ones."""
        ids = self.spec.ids
        own = self.spark.sparkContext.broadcast((pa.array(list(ids), pa.string()), pa.array(list(ids.values()), pa.int32())))

        @F.arrow_udf("array<int>")
        def run(lists: pa.Array) -> pa.Array:
            return looked_up(lists, *own.value)

        return run(_column(tokens))

    def apply_chat_template(
        self, messages: Column | str, name: str | None = None, add_generation_prompt: bool = False, tokenize: bool = True,
        tools: Column | None = None, return_dict: bool = False, **values,
    ) -> Column:
        """The prompt's ids, or its text: by a named template, or by the model's own, which also sees
        ``values``.  ``return_dict``: a struct of input_ids and attention_mask."""
        messages = _column(messages)
        if name is not None:
            text = chat.render(messages, name, add_generation_prompt)
        else:
            names = {f"{n}_token": getattr(self, f"{n}_token") or "" for n in ("bos", "eos", "unk", "pad")}
            own = chat.choose(self.chat_template, tools is not None)
            text = chat.render_own(messages, own, names | values, add_generation_prompt, tools)
        if not tokenize:
            return text
        ids = self.encode_special(text)
        return F.struct(ids.alias("input_ids"), F.array_repeat(F.lit(1), F.size(ids)).alias("attention_mask")) if return_dict else ids
