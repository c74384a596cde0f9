"""Spark helpers shared by the text operators."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.arrow import map_rows, pick, save_point, spread, table

__all__ = ["map_rows", "pick", "sample", "save_point", "spread", "table"]

SAMPLE_FILES = 200  # files that a sample is read from, about


def sample(df: DataFrame, size: int, id_col: str, **columns: str) -> DataFrame:
    """About ``size`` rows by hash of the id, with the named columns under new
    names.  Of a table of many more than SAMPLE_FILES files only about as many
    are opened, chosen by hash of their path (the scan prunes the others), so
    that a model never costs a pass over the whole text column."""
    rows = pick(df, __id=id_col, **columns)
    n = df.select(id_col).count()  # from the file footers
    rate = min(1.0, size / max(1, n))
    files = len(df.inputFiles())
    share = min(1.0, SAMPLE_FILES / files) if files else 1.0
    if share < 1.0 and rate < share:
        try:
            picked = F.pmod(F.xxhash64("_metadata.file_path"), F.lit(1 << 30)) < int((1 << 30) * share)
            rows = df.where(picked).select(F.col(id_col).alias("__id"), *[F.col(c).alias(k) for k, c in columns.items()])
            rate /= share
        except AnalysisException:  # no file scan
            pass
    if rate < 1.0:
        rows = rows.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < int((1 << 30) * rate))
    return rows.drop("__id")
