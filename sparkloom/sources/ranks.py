"""Rank files (base64 token, blank, rank) and the named encodings that use them."""

from __future__ import annotations

import ast
import base64
import hashlib
import json
import os
import tempfile
from dataclasses import dataclass
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.merge import PairTable
from sparkloom.functions.pretokenize import NUMBER, camel_grammar, generic_grammar, to_java, word_grammar
from sparkloom.plans.spec import AddedToken, Spec, to_surface


@dataclass(frozen=True)
class Encoding:
    """A named encoding: its split pattern, special tokens, size, and the digest of its rank file."""

    pattern: str
    specials: dict[str, int]
    size: int
    sha256: str
    models: str = ""


_END = "<|endoftext|>"
_FIM = [f"<|fim_{part}|>" for part in ("prefix", "middle", "suffix")]
_R50K = "306cd27f03c1a714eca7108e03d66b7dc042abe8c258b44c199a7ed9838dd930"
_P50K = "94b5ca7dff4d00767bc256fdd1b27e5b17361d7b8a5f968547f9f23eb70d2069"

ENCODINGS: dict[str, Encoding] = {
    "gpt2": Encoding(word_grammar(), {_END: 50256}, 50257, _R50K, "gpt2"),
    "r50k_base": Encoding(
        word_grammar(), {_END: 50256}, 50257, _R50K,
        "ada babbage curie davinci text-ada-001 text-babbage-001 text-curie-001 text-davinci-001",
    ),
    "p50k_base": Encoding(word_grammar(), {_END: 50256}, 50281, _P50K, "code-cushman-001 code-davinci-002 text-davinci-002 text-davinci-003"),
    "p50k_edit": Encoding(
        word_grammar(), {_END: 50256} | {t: 50281 + i for i, t in enumerate(_FIM)}, 50284, _P50K,
        "code-davinci-edit-001 text-davinci-edit-001",
    ),
    "cl100k_base": Encoding(
        generic_grammar(3, breaks=r"\s*[\r\n]"), {_END: 100257} | {t: 100258 + i for i, t in enumerate(_FIM)} | {"<|endofprompt|>": 100276},
        100277, "223921b76ee99bde995b7ff738513eef100fb51d18c93597a113bcffe865b2a7",
        "gpt-3.5 gpt-3.5-turbo gpt-4 gpt-4-32k gpt-4-turbo text-embedding-3-large text-embedding-3-small text-embedding-ada-002",
    ),
    "o200k_base": Encoding(
        camel_grammar(3), {_END: 199999, "<|endofprompt|>": 200018}, 200019,
        "446a9538cb6c348e3516120d7c08b09f57c36495e2acfffe59a5bf8b0cfb1a2d", "gpt-4o gpt-4o-mini o1 o1-mini o1-preview o3 o3-mini",
    ),
}


def encoding_name(name: str) -> str:
    """An encoding's name, from itself or from a model's name."""
    if name in ENCODINGS:
        return name
    for encoding, e in ENCODINGS.items():
        if name in e.models.split():
            return encoding
    raise ValueError(f"unknown encoding or model: {name!r}")


def read_ranks(path: str, sha256: str | None = None) -> dict[bytes, int]:
    """Token bytes to rank; ValueError for a file whose digest isn't the expected one."""
    with open(path, "rb") as f:
        raw = f.read()
    if sha256 and hashlib.sha256(raw).hexdigest() != sha256:
        raise ValueError(f"{path} isn't the expected file: its SHA-256 differs")
    out = {}
    for line in raw.splitlines():
        if line.strip():
            token, rank = line.split()
            out[base64.b64decode(token)] = int(rank)
    return out


def ranks_table(spark: SparkSession, path: str) -> DataFrame:
    """(rank int, bytes binary) of a rank file, read by Spark."""
    parts = F.split(F.col("value"), " ")
    rows = spark.read.text(path).where(F.trim("value") != "")
    return rows.select(F.element_at(parts, 2).cast("int").alias("rank"), F.unbase64(F.element_at(parts, 1)).alias("bytes"))


def merge_of(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts whose merge gives a token: its bytes, merged down to two parts."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        options = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks and a + b != token]
        if not options:
            return None
        i = min(options)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


def _pairs(ranks: dict[bytes, int]) -> PairTable:
    """All pairs of tokens whose bytes together are a token: it has the pair's rank and is its target.

    No merges need to be reconstructed: the rank of a pair is that of its concatenation.
    """
    rows = []
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            a, b = ranks.get(token[:k]), ranks.get(token[k:])
            if a is not None and b is not None:
                rows.append((a, b, rank))
    cols = np.array(rows, np.int64).reshape(-1, 3)
    return PairTable(cols[:, 0], cols[:, 1], cols[:, 2], cols[:, 2])


def spec_of_ranks(ranks: dict[bytes, int], pattern: str, specials: dict[str, int] | None = None, config: dict | None = None) -> Spec:
    """The spec of ranks with a split pattern."""
    if not pattern:
        raise ValueError("rank files hold no split pattern; it must be given")
    to_java(pattern)
    vocab = {to_surface(token): rank for token, rank in ranks.items()}
    added = tuple(AddedToken(i, t, True) for t, i in (specials or {}).items())
    return Spec(vocab, _pairs(ranks), added, stages=(pattern,), config=dict(config or {}))


def named(name: str, path: str, check: bool = True) -> Spec:
    """The spec of a named encoding (or of a model that uses it) with its rank file at ``path``."""
    e = ENCODINGS[encoding_name(name)]
    return spec_of_ranks(read_ranks(path, e.sha256 if check else None), e.pattern, e.specials)


def to_tokenizer_json(ranks: dict[bytes, int], pattern: str | None, specials: dict[str, int] | None = None) -> dict:
    """The ranks as a tokenizer.json; without a pattern the word grammar of ByteLevel itself."""
    merges = []
    for token in sorted(ranks, key=ranks.__getitem__):
        pair = merge_of(token, ranks) if len(token) > 1 else None
        if pair:
            merges.append([to_surface(pair[0]), to_surface(pair[1])])
    level = {"type": "ByteLevel", "use_regex": pattern is None, "add_prefix_space": False, "trim_offsets": True}
    split = {"type": "Split", "behavior": "Isolated", "invert": False, "pattern": {"Regex": pattern}}
    return {
        "model": {"merges": merges, "vocab": {to_surface(t): r for t, r in ranks.items()}, "type": "BPE"},
        "pre_tokenizer": level if pattern is None else {"type": "Sequence", "pretokenizers": [split, level]},
        "decoder": dict(type="ByteLevel"),
        "added_tokens": [{"id": i, "content": t, "special": True} for t, i in (specials or {}).items()],
    }


def cached_json(path: str, pattern: str, specials: dict[str, int] | None = None, folder: str | None = None) -> str:
    """Path of the tokenizer.json of a rank file, made once and moved into place whole."""
    folder = folder or os.path.join(os.path.expanduser("~"), ".cache", "sparkloom")
    os.makedirs(folder, exist_ok=True)
    key = hashlib.sha1("\n".join([os.path.abspath(path), pattern, json.dumps(specials or {}, sort_keys=True)]).encode()).hexdigest()[:16]
    target = os.path.join(folder, f"{key}.json")
    if not os.path.exists(target):
        handle, part = tempfile.mkstemp(dir=folder)
        os.close(handle)
        Path(part).write_text(json.dumps(to_tokenizer_json(read_ranks(path), pattern, specials)), "utf-8")
        os.replace(part, target)
    return target


def specials_of_config(config: dict) -> dict[str, int]:
    """Special tokens of a tokenizer_config.json's ``added_tokens_decoder``."""
    return {t["content"]: int(i) for i, t in (config.get("added_tokens_decoder") or {}).items()}


def _static_text(node: ast.AST) -> str | None:
    """The text of an expression of literals, sums and joins; None if it is anything else."""
    match node:
        case ast.Constant(value=str() as text):
            return text
        case ast.BinOp(left=left, op=ast.Add(), right=right):
            sides = _static_text(left), _static_text(right)
            return None if None in sides else "".join(sides)
        case ast.Call(func=ast.Attribute(value=glue, attr="join"), args=[ast.List(elts=items) | ast.Tuple(elts=items)]):
            between, parts = _static_text(glue), [_static_text(x) for x in items]
            return None if between is None or None in parts else between.join(parts)
    return None


def pattern_of_source(source: str) -> str | None:
    """The value of ``pat_str`` in a Python module's source, by reading it; nothing is executed."""
    try:
        nodes = list(ast.walk(ast.parse(source)))
    except SyntaxError:
        return None
    for node in nodes:
        match node:
            case ast.Assign(targets=targets, value=value):
                pass
            case ast.AnnAssign(target=target, value=ast.AST() as value):
                targets = [target]
            case _:
                continue
        named = {getattr(t, "id", None) or getattr(t, "attr", None) for t in targets}
        if "pat_str" in named and (text := _static_text(value)):
            return text
    return None


def from_folder(folder: str) -> Spec:
    """The spec of a model's local folder: tokenizer.json, or else tiktoken.model with the pattern
    recovered from the module that tokenizer_config.json names.

    tokenizer_config.json overrides special_tokens_map.json.
    """
    from sparkloom.plans.spec import load

    config: dict = {}
    for stem in "special_tokens_map tokenizer_config".split():
        place = Path(folder, f"{stem}.json")
        if place.exists():
            config.update(json.loads(place.read_text("utf-8")))
    path = os.path.join(folder, "tokenizer.json")
    if os.path.exists(path):
        return load(path, config)
    path = os.path.join(folder, "tiktoken.model")
    if not os.path.exists(path):
        raise ValueError(f"{folder} holds neither tokenizer.json nor tiktoken.model; models must lie in a local folder")
    for entry in (config.get("auto_map") or {}).values():
        for item in entry if isinstance(entry, list) else [entry]:
            place = os.path.join(folder, f"{str(item).split('--')[-1].split('.')[0]}.py")
            if os.path.exists(place):
                with open(place, encoding="utf-8") as f:
                    pattern = pattern_of_source(f.read())
                if pattern:
                    return spec_of_ranks(read_ranks(path), pattern, specials_of_config(config), config)
    raise ValueError(f"{folder} has a rank file, but its split pattern couldn't be found: give it to from_rank_file")
