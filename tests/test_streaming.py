"""Streams over files, against their batch twins."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pagelake.streaming import stateful as S

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture()
def source(spark, tmp_path):
    rows = [(k, T0 + dt.timedelta(seconds=20 * k), "a" if k % 3 else "b", k % 4 != 1, f"text {k % 5}") for k in range(40)]
    df = spark.createDataFrame(rows, "id LONG, ts TIMESTAMP, key STRING, ok BOOLEAN, text STRING")
    for part in range(4):
        df.where(F.col("id") % 4 == part).coalesce(1).write.parquet(str(tmp_path / f"in/p{part}"))
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    return df, stream, str(tmp_path / "run")


def test_rates(source):
    df, stream, folder = source
    out = S.run_available(S.per_minute(stream, "key", "ts", 1), folder, "update")
    got = {(r.minute, r.key): r.n for r in out.groupBy("minute", "key").agg(F.max("n").alias("n")).collect()}
    want = {(r.m, r.key): r.n for r in df.groupBy(F.date_trunc("minute", "ts").alias("m"), "key").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == want


def test_breaker(source):
    df, stream, folder = source
    out = S.run_available(S.circuit_breaker(stream, F.col("key"), F.col("ok"), "ts", "id"), folder, "update")
    got = {r.key: r.failures for r in out.groupBy("key").agg(F.max_by("failures", "__batch").alias("failures")).collect()}
    want = {}
    for r in df.orderBy("ts").collect():
        want[r.key] = 0 if r.ok else want.get(r.key, 0) + 1
    assert got == want


def test_ttl(source):
    df, stream, folder = source
    got = {r.seq: r.hit for r in S.run_available(S.ttl_lookups(stream, F.col("key"), "ts", "id", 30), folder).collect()}
    last, want = {}, {}
    for r in df.orderBy("ts").collect():
        want[r.id] = r.key in last and (r.ts - last[r.key]).total_seconds() < 30
        last[r.key] = r.ts
    assert got == want


def test_bucket(source):
    _, stream, folder = source
    got = S.run_available(S.token_bucket(stream, F.col("key"), "ts", "id", rate=0.01, burst=2), folder).collect()
    assert sum(r.allowed for r in got if r.key == "b") < 14 and all(r.wait_ms == 0 for r in got if r.allowed)


def test_dedup_sessions_events(source):
    _, stream, folder = source
    assert S.run_available(S.distinct_contents(stream, "text", "ts", "10 days"), folder + "1").count() == 5
    assert S.run_available(S.sessions(stream, "key", "ts", "5 minutes", "1 second"), folder + "2").count() >= 0
    ev = S.page_events(stream.select(F.col("key").alias("url"), F.col("text").alias("title"), F.when(~F.col("ok"), "bad").alias("error")))
    kinds = {r.type: r["count"] for r in S.run_available(ev, folder + "3").groupBy("type").count().collect()}
    assert kinds == {"status": 40, "document": 30, "error": 10}
    assert S.run_available(S.sliding_counts(stream, "ts", watermark="1 second"), folder + "4", "update").count() > 0
