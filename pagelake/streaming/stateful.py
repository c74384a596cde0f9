"""Structured Streaming: event stream, duplicates, breaker, limits, caches.

Everything takes and gives streaming DataFrames; tests and queries run them with
``availableNow`` over files.  Stateful operators sort a key's rows by time inside
each micro-batch, so they equal their batch twins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import content_hash


def page_events(pages: DataFrame, url: str = "url", title: str = "title", error: str = "error") -> DataFrame:
    """A status row before and a document or error row after each page."""
    status = F.struct(F.lit("status").alias("type"), F.col(url).alias("url"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("error"))
    kind = F.when(F.col(error).isNull(), "document").otherwise("error")
    after = F.struct(kind.alias("type"), F.col(url).alias("url"), F.col(title).alias("title"), F.col(error).alias("error"))
    return pages.select(F.explode(F.array(status, after)).alias("e")).select("e.*")


def distinct_contents(pages: DataFrame, text: str, ts: str, watermark: str = "1 hour", normal: bool = True) -> DataFrame:
    """First page of each content (of its normal form, or byte by byte); a content
    may come again once it has left the watermark, which bounds the state."""
    return pages.withColumn("content_key", content_hash(F.col(text)) if normal else F.sha2(F.col(text), 256)).withWatermark(ts, watermark).dropDuplicatesWithinWatermark(["content_key"])


def per_minute(events: DataFrame, key: str, ts: str, limit: int, watermark: str = "10 minutes") -> DataFrame:
    """(minute, key, n, limited): keys over ``limit`` in a tumbling minute."""
    w = events.withWatermark(ts, watermark).groupBy(F.window(ts, "1 minute"), F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("minute"), "key", "n", (F.col("n") > limit).alias("limited"))


def sliding_counts(events: DataFrame, ts: str, size: str = "10 minutes", step: str = "5 minutes", watermark: str = "10 minutes") -> DataFrame:
    w = events.withWatermark(ts, watermark).groupBy(F.window(ts, size, step)).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """(key, start, end, n) of visits divided by a gap."""
    w = events.withWatermark(ts, watermark).groupBy(F.session_window(ts, gap), F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return w.select("key", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def circuit_breaker(events: DataFrame, key: Column, ok: Column, ts: str, seq: str, threshold: int = 3, half_open_seconds: float | None = None) -> DataFrame:
    """(key, failures, is_open, half_open) after each micro-batch of a key:
    failures in a row, reset by a success.  With ``half_open_seconds`` an open
    breaker lets one try through when that long has passed between its last
    failure and the latest event of the batch.  State is two numbers a key; of a
    batch only the positions of failures behind the last success are held."""
    e = events.select(key.cast("string").alias("key"), ok.alias("ok"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(seq).cast("long").alias("seq"))

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, -1)
        good: tuple[int, int] | None = None
        bad: list[np.ndarray] = []
        latest = -1
        for p in parts:
            at = p[["us", "seq"]].to_numpy()
            latest = max(latest, int(at[:, 0].max()))
            fine = p["ok"].to_numpy().astype(bool)
            if fine.any():
                top = max(map(tuple, at[fine].tolist()))
                good = top if good is None or top > good else good
            bad.append(at[~fine])
            if good is not None:
                bad = [x[(x[:, 0] > good[0]) | (x[:, 0] == good[0]) & (x[:, 1] > good[1])] for x in bad]
        held = np.concatenate(bad)
        n = (0 if good is not None else n) + len(held)
        last = int(held[:, 0].max()) if len(held) else last
        state.update((int(n), int(last)))
        open_ = n >= threshold
        half = bool(open_ and half_open_seconds is not None and latest - last >= half_open_seconds * 1_000_000)
        yield pd.DataFrame({"key": [k[0]], "failures": [n], "is_open": [open_ and not half], "half_open": [half]})

    return e.groupBy("key").applyInPandasWithState(
        step, "key STRING, failures LONG, is_open BOOLEAN, half_open BOOLEAN", "n LONG, last LONG", "update", GroupStateTimeout.NoTimeout
    )


def ttl_lookups(events: DataFrame, key: Column, ts: str, seq: str, ttl_seconds: int) -> DataFrame:
    """(key, seq, hit) of every look: within ``ttl_seconds`` of the look before."""
    e = events.select(key.cast("string").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(seq).cast("long").alias("seq"))

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values(["us", "seq"])
        us = rows["us"].to_numpy()
        gaps = np.diff(us, prepend=us[0] if last is None else last)
        hits = gaps < ttl_seconds * 1_000_000
        hits[0] &= last is not None
        state.update((int(us[-1]),))
        yield pd.DataFrame({"key": k[0], "seq": rows["seq"].to_numpy(), "hit": hits})

    return e.groupBy("key").applyInPandasWithState(step, "key STRING, seq LONG, hit BOOLEAN", "us LONG", "append", GroupStateTimeout.NoTimeout)


def token_bucket(events: DataFrame, key: Column, ts: str, seq: str, rate: float = 2.0, burst: int = 2) -> DataFrame:
    """(key, seq, allowed, wait_ms): a bucket a key that refills by ``rate`` a second."""
    e = events.select(key.cast("string").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(seq).cast("long").alias("seq"))

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, last = state.get if state.exists else (float(burst), None)
        rows = pd.concat(list(parts)).sort_values(["us", "seq"])
        ok, wait = [], []
        for us in rows["us"]:
            if last is not None:
                level = min(float(burst), level + max(0, us - last) / 1e6 * rate)
            last = us
            ok.append(level >= 1.0)
            wait.append(0 if level >= 1.0 else int((1.0 - level) / rate * 1000))
            if level >= 1.0:
                level -= 1.0
        state.update((float(level), int(last)))
        yield pd.DataFrame({"key": k[0], "seq": rows["seq"].to_numpy(), "allowed": ok, "wait_ms": wait})

    return e.groupBy("key").applyInPandasWithState(step, "key STRING, seq LONG, allowed BOOLEAN, wait_ms LONG", "level DOUBLE, us LONG", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now and gives its result as a table.
    ``folder``: where results and checkpoint go (shared, on a cluster)."""
    spark = stream.sparkSession
    out, mark = f"{folder}/out", f"{folder}/checkpoint"

    def write(batch: DataFrame, n: int) -> None:
        batch.withColumn("__batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/batch={n}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", mark).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.parquet(out)
