"""Link graph: reachability, page chains, degrees, shares of rank.

Rounds of joins on the driver's loop; every round ends in a checkpoint, the
frontier is distinct before it is joined, and visited nodes are taken off by an
anti-join, so popular targets don't multiply.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import save_point


def _by_source(edges: DataFrame) -> DataFrame:
    """Distinct edges, saved in the partitions that joins on the source want, so
    that no round shuffles them again."""
    conf = edges.sparkSession.conf
    n, adaptive = int(conf.get("spark.sql.shuffle.partitions")), conf.get("spark.sql.adaptive.enabled")
    distinct = save_point(edges.distinct())
    conf.set("spark.sql.adaptive.enabled", "false")  # an adaptive plan would forget the layout
    try:
        return save_point(distinct.repartition(n, "s"))
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


def reachable(edges: DataFrame, seeds: DataFrame, max_depth: int, src: str = "src", dst: str = "dst") -> DataFrame:
    """(url, depth): least number of links from any seed, up to ``max_depth``."""
    e = _by_source(edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).where("s IS NOT NULL AND d IS NOT NULL"))
    level = save_point(seeds.toDF("url").where("url IS NOT NULL").distinct().withColumn("depth", F.lit(0)))
    out = level
    for depth in range(1, max_depth + 1):
        nxt = e.join(level, e["s"] == level["url"], "left_semi").select(F.col("d").alias("url")).distinct()
        level = save_point(nxt.join(out, "url", "left_anti").withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def degrees(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(url, n_in, n_out) over distinct edges, pre-aggregated on either side."""
    e = edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).where("s IS NOT NULL AND d IS NOT NULL").distinct()
    ins = e.groupBy(F.col("d").alias("url")).agg(F.count(F.lit(1)).alias("n"), F.lit(1).alias("k"))
    outs = e.groupBy(F.col("s").alias("url")).agg(F.count(F.lit(1)).alias("n"), F.lit(0).alias("k"))
    both = ins.unionByName(outs).groupBy("url")
    return both.agg(F.sum(F.when(F.col("k") == 1, F.col("n")).otherwise(0)).alias("n_in"), F.sum(F.when(F.col("k") == 0, F.col("n")).otherwise(0)).alias("n_out"))


def follow_chain(edges: DataFrame, seeds: DataFrame, max_pages: int | None = 50, max_depth: int = 10) -> DataFrame:
    """(seed, url, pos): pages reached along next edges, all of a page's, with the
    least number of steps.  A page that comes again is not followed again; a seed
    that has ``max_pages`` pages (None: no bound) is followed no further, and no
    chain beyond ``max_depth`` steps."""
    nxt = _by_source(edges.select(F.col("src").alias("s"), F.col("dst").alias("d")).where("s IS NOT NULL AND d IS NOT NULL"))
    level = save_point(seeds.select(F.col("url").alias("seed"), F.col("url")).where("url IS NOT NULL").distinct().withColumn("pos", F.lit(0)))
    out = level
    for pos in range(1, max_depth + 1):
        open_ = level
        if max_pages is not None:
            full = out.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max_pages)
            open_ = level.join(full, "seed", "left_anti")
        step = open_.join(nxt, open_["url"] == nxt["s"]).select("seed", F.col("d").alias("url")).distinct()
        level = save_point(step.join(out.select("seed", "url"), ["seed", "url"], "left_anti").withColumn("pos", F.lit(pos)))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out
