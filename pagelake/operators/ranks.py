"""Row numbers and neighbours within groups of any size.

A window over a group sorts the whole group in one task.  Here the rows are
range-partitioned by group and order, so a large group spreads over many
chunks; each chunk is numbered on its own and shifted by the rows of the chunks
before it, which are a handful of rows a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow import save_point


def chunked(df: DataFrame, key_cols: list[str], order_cols: list[str]) -> DataFrame:
    """``df`` in range partitions by key and order, with the chunk's number;
    saved, so that every later read sees the same chunks."""
    return save_point(df.repartitionByRange(*key_cols, *order_cols).withColumn("__chunk", F.spark_partition_id()))


def numbered(df: DataFrame, key_cols: list[str], order_cols: list[str], name: str = "n") -> DataFrame:
    """``df`` with the row number (from 1) within its key."""
    c = chunked(df, key_cols, order_cols)
    inside = Window.partitionBy(*key_cols, "__chunk").orderBy(*order_cols)
    before = Window.partitionBy(*key_cols).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = c.groupBy(*key_cols, "__chunk").agg(F.count(F.lit(1)).alias("__size"))
    shift = sizes.select(*key_cols, "__chunk", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"))
    out = c.withColumn("__inside", F.row_number().over(inside)).join(shift, [*key_cols, "__chunk"])
    return out.withColumn(name, F.col("__inside") + F.col("__before")).drop("__inside", "__before", "__chunk")


def running_sums(df: DataFrame, key_cols: list[str], order_col: str, value_col: str) -> DataFrame:
    """``df`` with the sum of a value up to each row (``upto``) and in all (``all``)
    within its key; without keys, over the whole table."""
    c = chunked(df, key_cols, [order_col])
    inside = Window.partitionBy(*key_cols, "__chunk").orderBy(order_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = c.groupBy(*key_cols, "__chunk").agg(F.sum(value_col).alias("__sum"))
    every = Window.partitionBy(*key_cols)  # one row a chunk
    before = every.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.select(*key_cols, "__chunk", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"), F.sum("__sum").over(every).alias("all"))
    out = c.withColumn("__inside", F.sum(value_col).over(inside))
    if key_cols:  # null keys are keys too
        same = F.lit(True)
        for k in [*key_cols, "__chunk"]:
            same = same & out[k].eqNullSafe(shift[k])
        out = out.join(shift, same).drop(*[shift[k] for k in [*key_cols, "__chunk"]])
    else:
        out = out.join(shift, "__chunk")
    return out.withColumn("upto", F.col("__inside") + F.col("__before")).drop("__inside", "__before", "__chunk")


def with_previous(df: DataFrame, key_cols: list[str], order_cols: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with the value of the row before within its key; null for the first."""
    c = chunked(df.withColumn("__value", value), key_cols, order_cols)
    inside = Window.partitionBy(*key_cols, "__chunk").orderBy(*order_cols)
    lasts = c.groupBy(*key_cols, "__chunk").agg(F.max_by("__value", F.struct(*order_cols)).alias("__last"))
    before = Window.partitionBy(*key_cols).orderBy("__chunk")
    carry = lasts.select(*key_cols, "__chunk", F.lag("__last").over(before).alias("__carry"))
    out = c.withColumn("__lag", F.lag("__value").over(inside)).withColumn("__first", F.row_number().over(inside) == 1).join(carry, [*key_cols, "__chunk"])
    return out.withColumn(name, F.when(F.col("__first"), F.col("__carry")).otherwise(F.col("__lag"))).drop("__value", "__lag", "__first", "__carry", "__chunk")
