"""Spark helpers of the operators that need Python.

They read whole columns through Arrow batches (``mapInArrow``) and select only
the columns they name, so extra or clashing columns never matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """The named (possibly nested) columns under new names, nothing else."""
    return df.select(*[F.col(c).alias(n) for n, c in columns.items()])


def spread(df: DataFrame) -> DataFrame:
    """A fresh scan with fewer partitions than cores is dealt out over all of
    them; larger inputs (every real one) keep their splits and aren't shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "AdaptiveSparkPlan" in df._jdf.queryExecution().executedPlan().nodeName():
        return df  # not a fresh scan: it has an exchange of its own, and counting would run it
    if df._jdf.queryExecution().toRdd().getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def map_rows(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, Iterable]], schema: str) -> DataFrame:
    """Arrow batches in, Arrow batches out.  ``fn`` gets a batch as lists by
    column name and returns lists by column name."""
    target = to_arrow_schema(_struct(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):  # few rows as Python objects at a time
                b = batch.slice(start, ROWS)
                got = fn({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def _struct(schema: str) -> StructType:
    out = _parse_datatype_string(schema)
    assert isinstance(out, StructType)
    return out


def save_point(df: DataFrame) -> DataFrame:
    """Cuts the lineage with ``checkpoint()`` in the folder that the session
    names in spark.checkpoint.dir (shared on a cluster).  Only where that is
    unset, as in tests, a local folder is set."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not folder:
            import tempfile

            folder = tempfile.mkdtemp(prefix="pagelake-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()
