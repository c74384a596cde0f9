"""Exact duplicates, distinct counts and keep-first.

Only hashes and keys are shuffled, never texts; counts are partially
aggregated before the shuffle, so a group of copies of any size is one row a
partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash


def keep_first(df: DataFrame, key: Column, order_col: str) -> DataFrame:
    """The first row of each key by ``order_col`` (unique); rows without a key
    all stay.  The winners are found by aggregation and joined back by id."""
    keyed = df.withColumn("__k", key)
    first = keyed.where(F.col("__k").isNotNull()).groupBy("__k").agg(F.min(order_col).alias("__o")).select("__o")
    kept = keyed.join(first, keyed[order_col] == first["__o"], "left_semi")
    return kept.unionByName(keyed.where(F.col("__k").isNull())).drop("__k")


def content_duplicates(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, first_id, is_duplicate): the first row with the same content; null
    contents are never duplicates."""
    h = df.select(F.col(id_col).alias("id"), content_hash(F.col(text_col)).alias("h"))
    first = h.where("h IS NOT NULL").groupBy("h").agg(F.min("id").alias("first_id"))
    out = h.join(first, "h", "left")
    first_id = F.coalesce(F.col("first_id"), F.col("id"))
    return out.select("id", first_id.alias("first_id"), (first_id != F.col("id")).alias("is_duplicate"))


def distinct_contents(df: DataFrame, text_col: str) -> DataFrame:
    return df.select(content_hash(F.col(text_col)).alias("h")).agg(F.count_distinct("h").alias("n"))


def duplicate_groups(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(hash, copies, first_id) of contents that occur more than once."""
    h = df.select(F.col(id_col).alias("id"), content_hash(F.col(text_col)).alias("hash")).where("hash IS NOT NULL")
    return h.groupBy("hash").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first_id")).where("copies > 1")
