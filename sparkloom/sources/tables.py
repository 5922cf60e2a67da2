"""A tokenizer as tables: vocabulary, merges and added tokens."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.plans.spec import Spec


def vocab_table(spark: SparkSession, spec: Spec) -> DataFrame:
    """(id, token, bytes, is_added, is_special) of every id that has a token."""
    added = {a.id for a in spec.added}
    special = set(spec.special_ids)
    raw = spec.token_bytes
    rows = [(i, t, raw[i], i in added, i in special) for i, t in sorted(spec.surface.items())]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["id", "token", "bytes", "is_added", "is_special"]), "id int, token string, bytes binary, is_added boolean, is_special boolean")


def merges_table(spark: SparkSession, spec: Spec) -> DataFrame:
    """(rank, left_id, right_id, target_id)."""
    m = spec.merges
    frame = pd.DataFrame({"rank": m.rank, "left_id": m.left, "right_id": m.right, "target_id": m.target}).astype("int32")
    return spark.createDataFrame(frame, "rank int, left_id int, right_id int, target_id int")


def added_table(spark: SparkSession, spec: Spec) -> DataFrame:
    """(id, content, special, lstrip, rstrip)."""
    rows = [(a.id, a.content, a.special, a.lstrip, a.rstrip) for a in spec.added]
    return spark.createDataFrame(rows, "id int, content string, special boolean, lstrip boolean, rstrip boolean")


def rank_inversions(merges: DataFrame) -> DataFrame:
    """Tokens that are used by a merge of no higher rank than one that makes them; none in a
    monotonic table.  Two grouped aggregates and a join."""
    made = merges.groupBy(F.col("target_id").alias("id")).agg(F.max("rank").alias("made"))
    used = merges.select("rank", F.explode(F.array("left_id", "right_id")).alias("id")).groupBy("id").agg(F.min("rank").alias("used"))
    return made.join(used, "id").where(F.col("made") >= F.col("used"))


def vocab_diff(a: DataFrame, b: DataFrame, id_col: str = "id", bytes_col: str = "bytes") -> DataFrame:
    """(bytes, id_a, id_b) of all tokens whose ids differ between two vocabularies, null where a token is
    missing."""
    left = a.select(F.col(bytes_col).alias("bytes"), F.col(id_col).alias("id_a"))
    right = b.select(F.col(bytes_col).alias("bytes"), F.col(id_col).alias("id_b"))
    return left.join(right, "bytes", "full").where(~F.col("id_a").eqNullSafe(F.col("id_b")))
