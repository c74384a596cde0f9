"""Readers: page snapshots, corpus files, a pluggable live source; writers."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.urls import file_name


_TRANSIENT = re.compile(r"time(?:d )?out|connection|request|reset|temporar", re.I)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A parquet snapshot of fetched pages, with the columns of the raw page
    schema; missing ones get the defaults of a rendered page."""
    df = spark.read.parquet(path)
    defaults = {
        "page_id": F.xxhash64("url"), "status_code": F.lit(200), "content_type": F.lit("text/html"), "fetched_at": F.lit(None).cast("timestamp"),
        "headers": F.array().cast("array<struct<k:string,v:string>>"),
    }
    return df.withColumns({k: v for k, v in defaults.items() if k not in df.columns})


def read_corpus(spark: SparkSession, path: str, categories: list[str] | None = None) -> DataFrame:
    """``category | url | description | min_words`` lines; blank and # lines are skipped."""
    rows = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> '' AND NOT startswith(v, '#')")
    p = F.transform(F.split("v", r"\|"), lambda x: F.trim(x))
    out = rows.select(F.get(p, 0).alias("category"), F.get(p, 1).alias("url"), F.get(p, 2).alias("description"), F.coalesce(F.get(p, 3).try_cast("int"), F.lit(50)).alias("min_words"))
    out = out.where("url IS NOT NULL")
    return out.where(F.col("category").isin(categories)) if categories else out


def read_gzipped_sitemaps(spark: SparkSession, path: str) -> DataFrame:
    """(path, body) of sitemap files, packed or not, told by their first bytes."""
    import gzip

    from ..operators.arrow import map_rows

    files = spark.read.format("binaryFile").load(path).select(F.col("path"), F.col("content"))

    def run(b: dict[str, list]) -> dict[str, list]:
        bodies = [gzip.decompress(c) if c[:2] == b"\x1f\x8b" else c for c in b["content"]]
        return {"path": b["path"], "body": [x.decode("utf-8", "replace") for x in bodies]}

    return map_rows(files, run, "path STRING, body STRING")


class PageSource(DataSource):
    """``spark.read.format("pages_live")``: fetches addresses with an injected
    transport ``module:function`` (url -> (status, content type, body)); one
    partition for each ``per_partition`` addresses, failures are rows.  A
    transient error is tried again up to ``attempts`` times in all, after
    ``first_ms``, then ``factor`` times as long, ``most_ms`` at most."""

    @classmethod
    def name(cls) -> str:
        return "pages_live"

    def schema(self) -> str:
        return "url STRING, status_code INT, content_type STRING, html STRING, error STRING"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(self.options)


class _PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = [u for u in options.get("urls", "").split("\n") if u]
        self.transport = options["transport"]
        self.size = int(options.get("per_partition", "50"))
        self.attempts = int(options.get("attempts", "3"))
        self.first_ms, self.factor, self.most_ms = float(options.get("first_ms", "200")), float(options.get("factor", "1.5")), float(options.get("most_ms", "10000"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.urls[i : i + self.size]) for i in range(0, len(self.urls), self.size)] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import importlib

        module, _, name = self.transport.partition(":")
        fetch: Callable = getattr(importlib.import_module(module), name)
        for url in partition.value:
            error, wait = None, self.first_ms / 1000
            for _ in range(self.attempts):
                if error is not None:
                    time.sleep(wait)
                    wait = min(wait * self.factor, self.most_ms / 1000)
                try:
                    status, kind, body = fetch(url)
                    yield (url, int(status), kind, body, None)
                    break
                except Exception as e:  # the next attempt, then an error row
                    error = f"{type(e).__name__}: {e}"
                    if not _TRANSIENT.search(error):
                        yield (url, None, None, None, error)
                        break
            else:
                yield (url, None, None, None, error)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageSource)


def write_metrics_csv(df: DataFrame, path: str) -> None:
    cols = [F.format_string("%.4f", c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_markdown_files(df: DataFrame, path: str, url_col: str = "url", text_col: str = "markdown") -> None:
    """One folder a page, named after its address, the text inside as one file."""
    named = df.where(F.col(text_col).isNotNull()).select(file_name(F.col(url_col)).alias("name"), F.col(text_col).alias("value"))
    named.write.mode("overwrite").partitionBy("name").text(path)


def append_run(df: DataFrame, path: str, run_col: str = "run_id") -> None:
    """Puts the rows of runs into an evaluation store.  A run that is written
    again takes the place of its rows, so that a job may be repeated."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run_col).parquet(path)


def save_baselines(df: DataFrame, path: str, columns: list[str]) -> None:
    """One JSON object by address with the metrics to compare with later."""
    last = df.where("url IS NOT NULL").groupBy("url").agg(F.max_by(F.struct(*columns), F.col("metric_id")).alias("m"))
    last.select("url", "m.*").write.mode("overwrite").json(path)


def load_baselines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
