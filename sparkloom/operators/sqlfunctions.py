"""A tokenizer's SQL functions: SQL expressions over the native split, with one Arrow step for merging."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sparkloom.functions.normalize import MARK
from sparkloom.functions.pretokenize import MARK_PIECES, stage_pattern
from sparkloom.operators.decode import decode_lists
from sparkloom.operators.encode import Encoder, merger, rows_of, spans_of


def literal(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def chunks_sql(encoder: Encoder, text: str, normal: str) -> str:
    """The pre-tokens of a text, as a SQL expression; ``normal`` names the function that normalizes."""
    s = encoder.spec
    if s.forms:
        text = f"{normal}({text})"
    if s.metaspace:
        marked = f"translate({text}, ' ', '{MARK}')"
        led = f"concat('{MARK}', {marked})"
        if s.metaspace == 2:
            marked = f"if({text} = '', {text}, {led})"
        elif s.metaspace == 3:
            marked = f"if({text} = '' OR startswith({marked}, '{MARK}'), {marked}, {led})"
        return f"regexp_extract_all({marked}, {literal(MARK_PIECES)}, 0)"
    pieces = ""
    for k, pattern in enumerate(s.stages):
        split = f"regexp_extract_all({f'p{k}' if k else text}, {literal(stage_pattern(pattern))}, 0)"
        pieces = f"flatten(transform({pieces}, p{k} -> {split}))" if k else split
    return pieces or f"if({text} = '', CAST(array() AS ARRAY<STRING>), if({text} IS NULL, NULL, array({text})))"


def register(encoder: Encoder, prefix: str) -> None:
    """Registers {prefix}_encode, {prefix}_count, {prefix}_offsets, {prefix}_decode and the table function
    {prefix}_explode; helpers begin with {prefix}__.

    They give what the columns of the tokenizer give: the text is split by the same expressions.
    """
    spark = encoder.spark
    shared, engine = encoder.shared, encoder.engine

    @F.arrow_udf("array<struct<id: int, token: string, start: int, `end`: int>>")
    def rows(lists: pa.Array) -> pa.Array:
        m, t = merger(shared.value, engine), shared.value
        values, first = rows_of(lists)
        ids, first = m.encoded(values, first)
        start, end = spans_of(t.lengths, ids, first)
        seen = np.zeros(len(t.lengths), bool)
        seen[ids] = True
        names = pa.array([t.arena[t.arena_first[i] : t.arena_first[i + 1]].tobytes().decode("utf-8", "replace") if k else None for i, k in enumerate(seen.tolist())], pa.string())
        fields = [pa.array(ids), names.take(pa.array(ids)), pa.array(start), pa.array(end)]
        mask = lists.is_null() if lists.null_count else None
        return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.StructArray.from_arrays(fields, names=["id", "token", "start", "end"]), mask=mask)

    @F.arrow_udf("array<struct<start: int, `end`: int>>")
    def spans(lists: pa.Array) -> pa.Array:
        m = merger(shared.value, engine)
        values, first = rows_of(lists)
        ids, first = m.encoded(values, first)
        fields = [pa.array(x) for x in spans_of(shared.value.lengths, ids, first)]
        mask = lists.is_null() if lists.null_count else None
        return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.StructArray.from_arrays(fields, names=["start", "end"]), mask=mask)

    @F.arrow_udf("string")
    def text_of(lists: pa.Array) -> pa.Array:
        return decode_lists(shared.value, lists)

    spark.udf.register(f"{prefix}__ids", encoder.merge_function())
    spark.udf.register(f"{prefix}__count", encoder.count_function())
    spark.udf.register(f"{prefix}__rows", rows)
    spark.udf.register(f"{prefix}__spans", spans)
    spark.udf.register(f"{prefix}_decode", text_of)
    if encoder.spec.forms:
        spark.udf.register(f"{prefix}__normal", encoder.normal_function())
    chunks = chunks_sql(encoder, "t", f"{prefix}__normal")
    for name, kind, body in (
        ("encode", "ARRAY<INT>", f"{prefix}__ids({chunks})"),
        ("count", "BIGINT", f"{prefix}__count({chunks})"),
        ("offsets", "ARRAY<STRUCT<start: INT, `end`: INT>>", f"{prefix}__spans({chunks})"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}_{name}(t STRING) RETURNS {kind} RETURN {body}")
    columns = "pos INT, id INT, token STRING, start INT, `end` INT"
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}_explode(t STRING) RETURNS TABLE({columns}) RETURN "
        f"SELECT pos, r.id, r.token, r.start, r.`end` FROM (SELECT posexplode({prefix}__rows({chunks})) AS (pos, r))"
    )
