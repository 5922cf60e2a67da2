"""Unicode normalization and the space-mark rewriting of SentencePiece-style models."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "▁"


def normalize_text(text: str, forms: tuple[str, ...]) -> str:
    """The text in the given forms, one after the other; text in form already is returned as it is."""
    for form in forms:
        if not text.isascii() and not unicodedata.is_normalized(form, text):
            text = unicodedata.normalize(form, text)
    return text


def normalize(text: Column, forms: tuple[str, ...]) -> Column:
    """Column of normalized texts; without forms the column itself, with no Python involved."""
    return normal_function(forms)(text) if forms else text


def normal_function(forms: tuple[str, ...]):
    """The Arrow function that normalizes texts."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else normalize_text(t, forms) for t in texts.to_pylist()], pa.string())

    return run


def metaspace(text: Column, mode: int, prefix: bool | Column = True) -> Column:
    """Spaces as marks, with a mark in front: never (mode 1), always (2), unless there is one (3).

    The empty text stays empty.
    """
    marked = F.translate(text, " ", MARK)
    led = F.concat(F.lit(MARK), marked)
    if mode == 2:
        full = led
    elif mode == 3:
        full = F.when(F.startswith(marked, F.lit(MARK)), marked).otherwise(led)
    else:
        return marked
    full = F.when(text == "", text).otherwise(full)
    if prefix is True:
        return full
    if prefix is False:
        return marked
    return F.when(prefix, full).otherwise(marked)
