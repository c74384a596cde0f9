"""A crawl over a snapshot of pages, in rounds.

Each round takes the best ``batch`` addresses off the frontier (priority, then
depth, then address), joins them with the snapshot, drops duplicate contents,
follows their links by the admission rules and puts new addresses on the
frontier.  With ``batch=1`` the order is that of a priority queue.  All state
lives in tables that end each round in a checkpoint; only counts reach the
driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.text import content_hash
from ..operators.arrow import save_point
from ..options import CrawlOptions


COMPACT = 16  # rounds whose rows are put together into one table


def crawl(pages: DataFrame, edges: DataFrame, seeds: list[str], options: CrawlOptions | None = None, robots: DataFrame | None = None) -> DataFrame:
    """(url, depth, priority, crawl_order, status_code, is_duplicate, error) of
    the visited pages.  ``pages``: url, markdown, status_code; ``edges``: src,
    dst, kind.  A page that isn't in the snapshot is an error row.  Documents
    count toward ``limit``; errors and duplicates don't.  robots_mode: strict asks
    for every address, base for the seeds alone, off for none.  The snapshot
    answers at once, so that a transient error has nothing to be tried again
    against; ``sources.tables.PageSource`` is where ``retries`` apply."""
    from ..operators.robots import robots_gate

    o = options or CrawlOptions()
    spark = pages.sparkSession
    status = F.col("status_code") if "status_code" in pages.columns else F.lit(200)
    snap = pages.select(U.canonical(F.col("url")).alias("url"), F.col("markdown"), status.cast("int").alias("status_code")).where("url IS NOT NULL")
    snap = snap.select("url", content_hash(F.col("markdown")).alias("h"), "status_code").groupBy("url").agg(F.min_by(F.struct("h", "status_code"), F.struct("h", "status_code")).alias("p"))
    snap = save_point(snap.select("url", "p.h", "p.status_code"))
    links = edges.select(U.canonical(F.col("src")).alias("src"), U.canonical(F.col("dst")).alias("dst"), F.coalesce(F.col("kind"), F.lit("link")).alias("kind"))
    links = links.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct()
    if not o.detect_pagination:
        links = links.where("kind <> 'pagination'")
    ok = U.is_http(F.col("dst")) & U.admitted(F.col("dst"), list(o.include_paths), list(o.exclude_paths))
    same = U.site(F.col("src")) == U.site(F.col("dst"))
    ok = ok & F.when(F.col("kind") == "pagination", same).otherwise(U.admit_link(F.col("dst"), F.col("src"), o.allow_external_links, o.allow_backward_links))
    links = links.where(ok)
    start = spark.createDataFrame([(s,) for s in seeds], "u STRING").select(U.canonical(F.col("u")).alias("url")).distinct()
    frontier = save_point(start.withColumn("depth", F.lit(0)).withColumn("priority", U.priority(F.col("url"), F.col("depth"))))
    if robots is not None and o.robots_mode == "base":  # a seed that may be fetched opens its site, one that may not closes it
        judged = robots_gate(frontier, robots)
        frontier = save_point(judged.where("robots_allowed").drop("robots_allowed").select(*frontier.columns))
    done: DataFrame | None = None
    queued = frontier.select("url")
    emitted = order = waiting = rounds = 0
    while o.limit is None or emitted < o.limit:
        best = Window.orderBy(F.desc("priority"), "depth", "url")
        take = frontier.orderBy(F.desc("priority"), "depth", "url").limit(o.batch if o.limit is None else min(o.batch, o.limit - emitted))  # at most batch rows
        take = save_point(take.withColumn("crawl_order", (F.row_number().over(best) + order).cast("long")))
        n = take.count()
        if not n:
            break
        order += n
        got = take.join(snap, "url", "left")
        if robots is not None and o.robots_mode == "strict":
            got = robots_gate(got, robots)
        else:
            got = got.withColumn("robots_allowed", F.lit(True))
        first = Window.partitionBy("h").orderBy("crawl_order")
        dup_here = F.col("h").isNotNull() & (F.row_number().over(first) > 1)
        got = got.withColumn("is_duplicate", dup_here)
        if done is not None:
            old = done.where("h IS NOT NULL").select(F.col("h").alias("old_h")).distinct()
            got = got.join(old, got["h"] == old["old_h"], "left").withColumn("is_duplicate", F.col("is_duplicate") | F.col("old_h").isNotNull()).drop("old_h")
        error = (
            F.when(~F.col("robots_allowed"), "robots_disallowed")
            .when(F.col("status_code").isNull(), "not_found")
            .when(F.col("status_code") >= 400, "error_page")
        )
        got = save_point(got.withColumn("error", error).select("url", "depth", "priority", "crawl_order", "status_code", "is_duplicate", "error", "h"))
        rounds += 1
        done = got if done is None else done.unionByName(got)  # rounds are added, each is saved once
        if rounds % COMPACT == 0:
            done, queued = save_point(done), save_point(queued)
        emitted += got.where("error IS NULL AND NOT is_duplicate").count()
        parents = got.where(F.col("error").isNull() & (F.col("depth") < o.max_depth)).select(F.col("url").alias("src"), "depth")
        found = links.join(parents, "src")
        depth = F.min(F.when(F.col("kind") == "pagination", F.col("depth")).otherwise(F.col("depth") + 1))
        if o.queue_size is not None and waiting >= o.backpressure * o.queue_size:  # a queue that is nearly full takes no leaves
            found = found.where((F.col("kind") == "pagination") | (F.col("depth") + 1 < o.max_depth))
        fresh = found.groupBy(F.col("dst").alias("url")).agg(depth.alias("depth")).join(queued, "url", "left_anti")
        fresh = save_point(fresh).withColumn("priority", U.priority(F.col("url"), F.col("depth")))
        rest = frontier.join(take.select("url"), "url", "left_anti").unionByName(fresh)
        rest = _without_broken(rest, done, o.breaker_threshold)
        kept = rest.orderBy(F.desc("priority"), "depth", "url").limit(o.queue_size) if o.queue_size is not None else rest
        frontier = save_point(kept)
        waiting = frontier.count()
        # an address that the full queue refused may come again by another link
        queued = queued.unionByName(save_point(frontier.join(fresh.select("url"), "url", "left_semi").select("url")))
    if done is None:
        return spark.createDataFrame([], "url STRING, depth INT, priority INT, crawl_order LONG, status_code INT, is_duplicate BOOLEAN, error STRING")
    return done.drop("h")


def _without_broken(frontier: DataFrame, done: DataFrame, threshold: int) -> DataFrame:
    """Leaves out hosts whose last ``threshold`` visits all failed."""
    seen = done.withColumn("host", U.site(F.col("url")))
    good = seen.where("error IS NULL").groupBy("host").agg(F.max("crawl_order").alias("good"))
    run = seen.where("error IS NOT NULL").join(good, "host", "left").where(F.col("crawl_order") > F.coalesce("good", F.lit(0)))
    broken = run.groupBy("host").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= threshold).select("host")
    return frontier.withColumn("host", U.site(F.col("url"))).join(broken, "host", "left_anti").drop("host")
