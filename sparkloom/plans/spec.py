"""A tokenizer's configuration, read once on the driver and rejected if it can't be reproduced."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import cached_property
from operator import itemgetter
from pathlib import Path

import numpy as np

from sparkloom.functions.merge import PairTable
from sparkloom.functions.normalize import MARK
from sparkloom.functions.pretokenize import NUMBER, to_java, word_grammar

FORMS = ("NFC", "NFD", "NFKC", "NFKD")


class UnsupportedTokenizer(ValueError):
    """The configuration asks for something that would change the result and isn't modelled."""


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = {}, 256
    for b in range(256):
        out[b] = chr(b if b in plain else spare)
        spare += b not in plain
    return out


_TO_CHAR = byte_alphabet()
_TO_BYTE = {c: b for b, c in _TO_CHAR.items()}


def to_surface(raw: bytes) -> str:
    """Bytes in the byte alphabet."""
    return "".join(_TO_CHAR[b] for b in raw)


def from_surface(token: str) -> bytes:
    """The bytes of a byte-level token; characters outside the alphabet are their own UTF-8."""
    return b"".join(bytes([_TO_BYTE[c]]) if c in _TO_BYTE else c.encode() for c in token)


@dataclass(frozen=True)
class AddedToken:
    """An added token; ``lstrip`` and ``rstrip``: it swallows white space around it."""

    id: int
    content: str
    special: bool = False
    lstrip: bool = False
    rstrip: bool = False


@dataclass(frozen=True)
class Spec:
    """All that decides a tokenizer's result."""

    vocab: dict[str, int]
    merges: PairTable
    added: tuple[AddedToken, ...] = ()
    forms: tuple[str, ...] = ()
    stages: tuple[str, ...] = ()
    metaspace: int = 0  # 0 none, 1 replace, 2 replace and prepend, 3 prepend where missing
    prepend: str = "none"  # around added tokens: none, always, first
    byte_fallback: bool = False
    ignore_merges: bool = False
    strip_decoded: bool = False
    post: dict | None = None
    config: dict = field(default_factory=dict)

    @cached_property
    def size(self) -> int:
        """Largest id plus one, over vocabulary and added tokens."""
        return max([*self.vocab.values(), *(a.id for a in self.added)], default=-1) + 1

    @cached_property
    def token_bytes(self) -> list[bytes]:
        """Bytes of every id; added tokens fill ids that are still empty."""
        out = [b""] * self.size
        for token, i in self.vocab.items():
            out[i] = self._bytes(token)
        for a in self.added:
            out[a.id] = out[a.id] or a.content.encode()
        return out

    def _bytes(self, token: str) -> bytes:
        if not self.byte_fallback:
            return from_surface(token)
        if len(token) == 6 and token.startswith("<0x") and token.endswith(">"):
            try:
                return bytes([int(token[3:5], 16)])
            except ValueError:
                pass
        return token.replace(MARK, " ").encode()

    @cached_property
    def byte_ids(self) -> np.ndarray:
        """Token of every single byte, -1 for none; spelt in the byte alphabet first, then smallest."""
        out = np.full(256, -1, np.int64)
        spelt = np.zeros(256, bool)
        for token, i in sorted(self.vocab.items(), key=itemgetter(1)):
            raw = self._bytes(token)
            if len(raw) != 1:
                continue
            b = raw[0]
            proper = token == (f"<0x{b:02X}>" if self.byte_fallback else _TO_CHAR[b])
            if out[b] < 0 or (proper and not spelt[b]):
                out[b] = i
            spelt[b] |= proper
        return out

    @cached_property
    def surface(self) -> dict[int, str]:
        """Token string of every id; an added token's wins."""
        return {i: t for t, i in self.vocab.items()} | {a.id: a.content for a in self.added}

    @cached_property
    def ids(self) -> dict[str, int]:
        """Id of every token string."""
        return {t: i for i, t in self.surface.items()}

    @cached_property
    def special_ids(self) -> list[int]:
        return sorted({a.id for a in self.added if a.special})

    @cached_property
    def whole_chunks(self) -> dict[bytes, int]:
        """Token of a whole chunk's bytes, for models that try that before merging."""
        out: dict[bytes, int] = {}
        if self.ignore_merges and not self.byte_fallback:
            for i, raw in enumerate(self.token_bytes):
                if raw:
                    out.setdefault(raw, i)
        return out

    @cached_property
    def monotonic(self) -> bool:
        """Whether every token is made by merges of lower rank than those that use it."""
        m = self.merges
        made = np.full(self.size, -1, np.int64)
        used = np.full(self.size, np.iinfo(np.int64).max)
        np.maximum.at(made, m.target, m.rank)
        for side in (m.left, m.right):
            np.minimum.at(used, side, m.rank)
        return bool((made < used).all())


def _listed(part: dict | None, name: str) -> list[dict]:
    if not part:
        return []
    return list(part.get(name) or []) if part.get("type") == "Sequence" else [part]


def _is_prepend(stage: dict) -> bool:
    return stage.get("type") == "Prepend" and stage.get("prepend") == MARK


def _is_replace(stage: dict) -> bool:
    return stage.get("type") == "Replace" and stage.get("content") == MARK and (stage.get("pattern") or {}).get("String") == " "


def _normalizer(part: dict | None) -> tuple[tuple[str, ...], bool, bool]:
    """(forms, whether marks are prepended, whether they replace blanks)."""
    stages = _listed(part, "normalizers")
    for s in stages:
        if s.get("type") not in FORMS and not _is_prepend(s) and not _is_replace(s):
            raise UnsupportedTokenizer(f"unsupported normalizer: {s.get('type') or 'unknown'}")
    forms = tuple(s["type"] for s in stages if s["type"] in FORMS)
    return forms, any(map(_is_prepend, stages)), any(map(_is_replace, stages))


def _split_stages(part: dict | None) -> tuple[str, ...]:
    """Patterns of a byte-level model's pre-tokenizer, in order."""
    if not part:
        raise UnsupportedTokenizer("a byte-level model needs a pre-tokenizer")
    if part.get("type") == "ByteLevel":
        if part.get("add_prefix_space"):
            raise UnsupportedTokenizer("add_prefix_space isn't supported")
        if part.get("use_regex", True) is False:
            raise UnsupportedTokenizer("ByteLevel without a pattern isn't supported")
        return (word_grammar(),)
    if part.get("type") != "Sequence":
        raise UnsupportedTokenizer(f"unsupported pre-tokenizer: {part.get('type')}")
    out: list[str] = []
    levels = []
    splits = 0
    for p in part.get("pretokenizers") or []:
        kind = p.get("type")
        if kind == "ByteLevel":
            if p.get("add_prefix_space"):
                raise UnsupportedTokenizer("add_prefix_space isn't supported")
            levels.append(p.get("use_regex", True) is not False)
        elif kind == "Digits":
            out.append(NUMBER if p.get("individual_digits") else f"{NUMBER}+")
        elif kind == "Split":
            pattern = (p.get("pattern") or {}).get("Regex")
            if p.get("behavior") != "Isolated" or p.get("invert") or pattern is None:
                raise UnsupportedTokenizer("only isolating, not inverted splits by a regex are supported")
            splits += 1
            try:
                to_java(pattern)
            except ValueError as error:
                raise UnsupportedTokenizer(str(error)) from None
            out.append(pattern)
        else:
            raise UnsupportedTokenizer(f"unsupported pre-tokenizer: {kind}")
    if not levels:
        raise UnsupportedTokenizer("a byte-level model needs ByteLevel")
    if levels[-1]:
        if splits:
            raise UnsupportedTokenizer("a split pattern and ByteLevel's own pattern exclude each other")
        out.append(word_grammar())
    if not out:
        raise UnsupportedTokenizer("the pre-tokenizer splits nothing")
    return tuple(out)


def _merge_table(vocab: dict[str, int], merges: list) -> PairTable:
    """Merges whose halves and result are tokens; the rank is the place among those."""
    rows = []
    for m in merges:
        a, b = m if isinstance(m, (list, tuple)) else m.split(" ", 1) if " " in m else (m, "")
        i, j, k = vocab.get(a), vocab.get(b), vocab.get(a + b)
        if None not in (i, j, k):
            rows.append((i, j, k))
    cols = np.array(rows, np.int64).reshape(-1, 3)
    return PairTable(cols[:, 0], cols[:, 1], np.arange(len(cols)), cols[:, 2])


def parse(model: dict, config: dict | None = None) -> Spec:
    """The spec of a parsed tokenizer.json and tokenizer_config.json."""
    core = model.get("model") or {}
    vocab = core.get("vocab")
    if not isinstance(vocab, dict):
        raise UnsupportedTokenizer("the model has no vocabulary of tokens and ids")
    if core.get("type") not in (None, "BPE"):
        raise UnsupportedTokenizer(f"unsupported model: {core['type']}")
    for name, neutral in (("dropout", (None, 0, 0.0)), ("continuing_subword_prefix", (None, "")), ("end_of_word_suffix", (None, ""))):
        if core.get(name) not in neutral:
            raise UnsupportedTokenizer(f"{name} isn't supported")
    vocab = {str(t): int(i) for t, i in vocab.items()}
    forms, prepends, replaces = _normalizer(model.get("normalizer"))
    pre = model.get("pre_tokenizer") or None
    kinds = [p.get("type") for p in _listed(pre, "pretokenizers")]
    mark = next((p for p in _listed(pre, "pretokenizers") if p.get("type") == "Metaspace"), None)
    mode = 3 if mark is not None else (2 if prepends else 1) if replaces else 0
    scheme = mark.get("prepend_scheme", "always") if mark is not None else "always" if prepends else "none"
    if scheme not in ("none", "always", "first"):
        raise UnsupportedTokenizer(f"unsupported prepend_scheme: {scheme}")
    fallback = bool(core.get("byte_fallback"))
    stages: tuple[str, ...] = ()
    if fallback or mode:
        if pre is not None and kinds != ["Metaspace"]:
            raise UnsupportedTokenizer(f"unsupported pre-tokenizer for this kind of model: {kinds}")
    else:
        stages = _split_stages(pre)
    decoders = _listed(model.get("decoder"), "decoders")
    added = tuple(
        AddedToken(int(a["id"]), a["content"], bool(a.get("special")), bool(a.get("lstrip")), bool(a.get("rstrip")))
        for a in model.get("added_tokens") or []
    )
    spec = Spec(
        vocab, _merge_table(vocab, core.get("merges") or []), added, forms, stages, mode, scheme, fallback,
        bool(core.get("ignore_merges")), any(d.get("type") == "Strip" and d.get("content") == " " for d in decoders),
        model.get("post_processor"), dict(config or {}),
    )
    # With a token for every byte nothing is unknown, so neither unk_token nor fuse_unk matters.
    if core.get("unk_token") in vocab and (spec.byte_ids < 0).any():
        raise UnsupportedTokenizer("unk_token isn't supported where bytes have no token")
    return spec


def load(path: str, config: dict | str | None = None) -> Spec:
    """The spec of a tokenizer.json file; ValueError if it can't be read or reproduced."""
    try:
        model = json.loads(Path(path).read_text("utf-8"))
    except (OSError, UnicodeDecodeError, json.JSONDecodeError) as error:
        raise ValueError(f"{path} can't be read as a tokenizer: {error}") from error
    if isinstance(config, str):
        config = json.loads(Path(config).read_text("utf-8"))
    return parse(model, config)
