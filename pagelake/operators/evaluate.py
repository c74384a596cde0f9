"""Summaries, drift, parity and trends over scrape metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .ranks import numbered, running_sums, with_previous


def nearest_rank(values: Column, p: float) -> Column:
    """Percentile by the nearest rank of n-1, halves up, of a sorted array."""
    return F.try_element_at(values, F.floor(F.lit(p) * (F.size(values) - 1) + 0.5).cast("int") + 1)


def percentiles(df: DataFrame, value_col: str, points: dict[str, float], by: list[str]) -> DataFrame:
    """Nearest-rank percentiles by group from counts of distinct values: values
    are pre-aggregated, so a group of any size is no more than its distinct values."""
    counts = df.where(F.col(value_col).isNotNull()).groupBy(*by, F.col(value_col).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    c = running_sums(counts, by, "v", "n")
    aggs = []
    for name, p in points.items():
        rank = F.floor(F.lit(p) * (F.col("all") - 1) + 0.5) + 1
        aggs.append(F.min(F.when(F.col("upto") >= rank, F.col("v"))).alias(name))
    return c.groupBy(*by).agg(*aggs)


def summary(df: DataFrame, by: list[str]) -> DataFrame:
    """Counts, success rate, latency, lengths and sums by group."""
    ok = F.coalesce(F.col("success"), F.lit(False))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(ok).alias("n_success"),
        F.round(F.count_if(ok) * 100.0 / F.count(F.lit(1)), 6).alias("success_rate"),
        F.round(F.avg("response_time_ms"), 6).alias("avg_ms"),
        F.min("response_time_ms").alias("min_ms"),
        F.max("response_time_ms").alias("max_ms"),
        F.round(F.avg("markdown_length"), 6).alias("avg_markdown_length"),
        F.sum("link_count").alias("links"),
        F.sum("image_count").alias("images"),
        F.sum("word_count").alias("words"),
    )


def latency_spread(df: DataFrame, by: list[str]) -> DataFrame:
    """Population variance, deviation and coefficient of variation."""
    t = F.col("response_time_ms").cast("double")
    return df.groupBy(*by).agg(
        F.round(F.var_pop(t), 4).alias("variance"), F.round(F.stddev_pop(t), 6).alias("deviation"), F.round(F.try_divide(F.stddev_pop(t), F.avg(t)), 6).alias("variation")
    )


def latest_run_rates(df: DataFrame, run_col: str, by: str, won: Column) -> DataFrame:
    """Share of won rows by group, of the latest run alone."""
    last = df.agg(F.max(run_col).alias("__last"))  # one row
    rows = df.join(F.broadcast(last), F.col(run_col) == F.col("__last"))
    return rows.groupBy(by).agg(F.round(F.avg(won.cast("double")), 6).alias("win_rate"), F.count(F.lit(1)).alias("n"))


def improvement_targets(winners: DataFrame, dimensions: list[str], adv: Column) -> DataFrame:
    """The losers of ``winners`` (url, category and a winner a dimension): their
    weak dimensions and a priority by the advantage of the other side."""
    weak = F.filter(F.array(*[F.when(F.col(x) == "b", F.lit(x)) for x in dimensions]), lambda x: x.isNotNull())
    d = winners.withColumn("advantage", adv).where(S.overall_winner(F.col("advantage")) == "b")
    rank = F.when(F.col("advantage") < -0.3, "high").when(F.col("advantage") < -0.1, "medium").otherwise("low")
    return d.select("url", "category", F.round("advantage", 6).alias("advantage"), weak.alias("weak_dimensions"), rank.alias("priority"))


def metric_rows(documents: DataFrame, id_col: str = "page_id") -> DataFrame:
    """The row of scrape metrics of each document (url, markdown, html, links,
    images, title, description, metadata): lengths in bytes, null texts as empty."""
    from ..functions.text import word_count

    status = F.col("metadata.status_code")
    size, raw = F.octet_length(F.coalesce("markdown", F.lit(""))), F.octet_length(F.coalesce("html", F.lit("")))
    return documents.select(
        F.col(id_col).alias("metric_id"), "url", F.coalesce(status < 400, F.lit(False)).alias("success"), status.alias("status_code"), size.cast("long").alias("markdown_length"),
        raw.cast("long").alias("html_length"), F.try_divide(size.cast("double"), raw.cast("double")).alias("extraction_ratio"), word_count(F.col("markdown")).alias("word_count"),
        F.sha2("markdown", 256).alias("content_hash"), F.coalesce(F.trim("title") != "", F.lit(False)).alias("has_title"), F.coalesce(F.trim("description") != "", F.lit(False)).alias("has_description"),
        F.coalesce(F.size("links"), F.lit(0)).cast("long").alias("link_count"), F.coalesce(F.size("images"), F.lit(0)).cast("long").alias("image_count"),
    )


def content_drift(df: DataFrame) -> DataFrame:
    """Addresses with more than one run and more than one content."""
    return df.where("url IS NOT NULL").groupBy("url").agg(F.count(F.lit(1)).alias("runs"), F.count_distinct("content_hash").alias("contents")).where("runs > 1 AND contents > 1")


def engine_parity(df: DataFrame, a: str, b: str) -> DataFrame:
    """Latest run of two engines by address: same content, both successful, and
    the difference in time and length."""
    last = F.max_by(F.struct("metric_id", "success", "response_time_ms", "content_hash", "markdown_length"), F.col("metric_id"))

    def side(tag: str, name: str) -> DataFrame:
        got = df.where((F.col("engine_tag") == tag) & F.col("url").isNotNull()).groupBy("url").agg(last.alias(name))
        return got

    j = side(a, "x").join(side(b, "y"), "url")
    return j.select(
        "url",
        F.coalesce(F.col("x.content_hash") == F.col("y.content_hash"), F.lit(False)).alias("same_content"),
        (F.coalesce(F.col("x.success"), F.lit(False)) & F.coalesce(F.col("y.success"), F.lit(False))).alias("both_ok"),
        (F.col("x.response_time_ms") - F.col("y.response_time_ms")).alias("ms_delta"),
        (F.col("x.markdown_length") - F.col("y.markdown_length")).alias("length_delta"),
        S.winner_speed(F.col("x.response_time_ms"), F.col("y.response_time_ms")).alias("speed_winner"),
    )


def parity_summary(parity: DataFrame) -> DataFrame:
    return parity.agg(
        F.count(F.lit(1)).alias("pairs"),
        F.round(100.0 * F.count_if("same_content") / F.count(F.lit(1)), 6).alias("match_rate"),
        F.round(100.0 * F.count_if("both_ok") / F.count(F.lit(1)), 6).alias("both_ok_rate"),
        F.round(F.avg("ms_delta"), 6).alias("avg_ms_delta"),
    )


def unpivot_rates(df: DataFrame, by: list[str], flags: list[str]) -> DataFrame:
    """Share of true by group and flag, the flags turned into rows."""
    long_ = df.select(*by, F.explode(F.array(*[F.struct(F.lit(f).alias("dimension"), F.col(f).cast("int").alias("v")) for f in flags])).alias("x")).select(*by, "x.*")
    return long_.groupBy(*by, "dimension").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("rate"), F.count("v").alias("n"))


def daily_trend(df: DataFrame, ts_col: str, value_col: str) -> DataFrame:
    """Daily mean and its change from the day before."""
    day = df.groupBy(F.to_date(ts_col).alias("day")).agg(F.round(F.avg(value_col), 6).alias("mean"), F.count(F.lit(1)).alias("n")).where("day IS NOT NULL")
    w = Window.orderBy("day")  # one row a day
    return day.withColumn("change", F.round(F.col("mean") - F.lag("mean").over(w), 6))


def trailing_failures(df: DataFrame, key_col: str, ok: Column, order_cols: list[str]) -> DataFrame:
    """(key, n): failures of a key since its last success, by aggregation alone."""
    pos = F.struct(*order_cols)
    base = df.select(F.col(key_col).alias("key"), pos.alias("pos"), ok.alias("ok"))
    good = base.groupBy("key").agg(F.max(F.when(F.col("ok"), F.col("pos"))).alias("good"))
    return base.join(good, "key").groupBy("key").agg(F.count_if(~F.col("ok") & (F.col("good").isNull() | (F.col("pos") > F.col("good")))).alias("n"))


def cache_hits(df: DataFrame, key_cols: list[str], ts_col: str, order_col: str, ttl_seconds: int) -> DataFrame:
    """Looks at a key within ``ttl_seconds`` of the look before are hits.  Keys
    of any size spread over chunks; null keys are keys of their own."""
    us = F.unix_micros(F.col(ts_col).cast("timestamp"))
    filled = df.withColumns({f"__k{i}": F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for i, c in enumerate(key_cols)})
    keys = [f"__k{i}" for i in range(len(key_cols))]
    out = with_previous(filled, keys, [ts_col, order_col], us, "__before")
    return out.withColumn("hit", F.coalesce(us - F.col("__before") < ttl_seconds * 1_000_000, F.lit(False))).drop(*keys, "__before")


def politeness_schedule(df: DataFrame, host: Column, order_cols: list[str], per_second: int) -> DataFrame:
    """Second at which each address of a host may be fetched; hosts of any size
    spread over chunks."""
    rows = df.withColumn("host", host).where("host IS NOT NULL")
    return numbered(rows, ["host"], order_cols, "__n").withColumn("at_second", F.floor((F.col("__n") - 1) / per_second).cast("long")).drop("__n")
