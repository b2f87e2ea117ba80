"""Crawling fetched pages: one join per level of depth."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelake.functions import urls as U
from sitelake.operators import dedup, extract, fetches, robots
from sitelake.runtime import materialize


@dataclass(frozen=True)
class CrawlOptions:
    depth: int | None = None
    max_pages: int = 150
    use_robots: bool = True
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    dedup_locales: bool = True
    seed_from_sitemap: int = 50
    low_content: int = 20
    default_depth: int = 2


def plan(seeds: list[str], specific: list[bool], options: CrawlOptions) -> CrawlOptions:
    """Single-page mode: if every seed is a specific page and no depth is asked for, only these."""
    if options.depth is None and seeds and all(specific):
        return CrawlOptions(**(options.__dict__ | {"depth": 0, "max_pages": len(seeds), "seed_from_sitemap": 0}))
    return CrawlOptions(**(options.__dict__ | {"depth": options.default_depth if options.depth is None else options.depth}))


def crawlable(found: DataFrame, hosts: DataFrame, robots_txt: DataFrame | None, options: CrawlOptions) -> DataFrame:
    """Of found (url, seq, depth): those that may be queued, cheap predicates first; dedup sees only survivors."""
    kept = found.filter(F.col("depth") <= options.depth).filter(~U.should_skip_url(F.col("url")))
    kept = kept.withColumn("__host", U.base_domain(F.col("url"))).join(hosts, F.col("__host") == F.col("base_host"), "left_semi").drop("__host")
    if options.use_robots and robots_txt is not None:
        kept = robots.allowed(kept, robots_txt).filter("allowed").drop("allowed")
    for pattern in options.include:
        kept = kept.filter(F.col("url").rlike(pattern))
    for pattern in options.exclude:
        kept = kept.filter(~F.col("url").rlike(pattern))
    return kept


def bfs(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """node, depth: the least number of steps from a seed along edges (src, dst), up to depth."""
    seen = materialize(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "bfs")
    for d in range(1, depth + 1):
        front = seen.filter(F.col("depth") == d - 1).select(F.col("node").alias("src"))
        step = edges.join(front, "src", "left_semi").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        seen = materialize(seen.unionByName(step.withColumn("depth", F.lit(d))), "bfs")
    return seen


def crawl(pages: DataFrame, seeds: DataFrame, options: CrawlOptions = CrawlOptions(), robots_txt: DataFrame | None = None, sitemap_urls: DataFrame | None = None) -> DataFrame:
    """url, final_url, depth, engine, seq and what extract_pages gives, in canonical order (depth, parent, position).

    pages: url, engine, priority, status_code, html, final_url, the fetch results there are. seeds: url, seq (in order).
    sitemap_urls: url, seq. A level is one join of the frontier with the pages; the visited set is written between levels.
    """
    wanted = seeds.select(U.normalize_url(F.col("url")).alias("norm"), F.col("url"), "seq")
    hosts = seeds.select(U.base_domain(F.col("url")).alias("base_host")).distinct()
    keyed = pages.withColumn("norm", U.normalize_url(F.col("url")))
    start = wanted.select("norm", "url", F.struct(F.lit(0).cast("long").alias("parent"), F.col("seq").cast("long").alias("pos")).alias("order"), F.lit(0).alias("depth"))
    queue = start
    if sitemap_urls is not None and options.seed_from_sitemap:
        some = sitemap_urls.orderBy("seq").limit(min(options.max_pages, options.seed_from_sitemap))
        some = crawlable(some.select("url", "seq", F.lit(1).alias("depth")), hosts, robots_txt, options)
        queue = queue.unionByName(some.select(U.normalize_url(F.col("url")).alias("norm"), "url", F.struct(F.lit(-1).cast("long").alias("parent"), F.col("seq").cast("long").alias("pos")).alias("order"), "depth"))
    visited = None
    results = None
    max_depth = options.default_depth if options.depth is None else options.depth
    options = CrawlOptions(**(options.__dict__ | {"depth": max_depth}))
    used = 0
    pending = materialize(queue, "crawl_queue")
    locale_state = None
    for d in range(max_depth + 1):
        level = pending.filter(F.col("depth") == d)
        level = dedup.first_seen(level, F.col("norm"), "order")
        if visited is not None:
            level = level.join(visited, "norm", "left_anti")
        level = level.orderBy("order").limit(max(0, options.max_pages - used))
        level = materialize(level.withColumn("seq", F.row_number().over(Window.orderBy("order")).cast("long") + used), "crawl_level")  # at most max_pages rows
        n = level.count()
        used += n
        visited = level.select("norm") if visited is None else visited.unionByName(level.select("norm"))
        if n == 0:
            continue
        # only the fetches of this level are picked from; it has at most max_pages rows
        fetched = fetches.pick(keyed.join(F.broadcast(level.select("norm")), "norm", "left_semi")).drop("url")
        got = fetched.join(level, "norm").filter((F.col("status_code") < 400)).select("url", F.coalesce("final_url", "norm").alias("final_url"), "depth", "engine", "seq", "html")
        # links are resolved against where the fetch ended
        made = extract.extract_pages(got, url_col="final_url").filter(F.col("word_count") >= options.low_content)
        made = materialize(made, "crawl_pages")
        results = made if results is None else results.unionByName(made)
        if d < max_depth:
            linked = made.select("seq", F.posexplode("links").alias("pos", "url"))
            found = linked.select("url", F.struct(F.col("seq").alias("parent"), F.col("pos").cast("long").alias("pos")).alias("order"), F.lit(d + 1).alias("depth"))
            found = found.withColumn("seq", F.col("order.parent") * F.lit(1 << 20) + F.col("order.pos"))
            found = crawlable(found, hosts, robots_txt, options)
            if options.dedup_locales:
                both = found.select("url", "order", "depth", "seq")
                if locale_state is not None:
                    both = both.unionByName(locale_state)
                locale_state = materialize(both, "crawl_locale")
                found = dedup.locale_dedup(locale_state, seq="seq").filter("keep").filter(F.col("depth") == d + 1)
            fresh = found.select(U.normalize_url(F.col("url")).alias("norm"), "url", "order", "depth")
            pending = materialize(pending.filter(F.col("depth") > d).unionByName(fresh), "crawl_queue")
    spark = pages.sparkSession
    if results is None:
        empty = extract.extract_pages(keyed.drop("url").join(start, "norm").select("url", "final_url", "depth", "engine", F.lit(0).cast("long").alias("seq"), "html"), url_col="final_url")
        return spark.createDataFrame([], empty.schema)
    return results


def rate_slots(starts: DataFrame, per_second: int = 10, ts: str = "ts", seq: str = "event_id") -> DataFrame:
    """starts with second, rank_in_second, admitted: the first per_second starts of each second."""
    second = F.date_trunc("second", F.col(ts))
    rank = F.row_number().over(Window.partitionBy("second").orderBy(seq)).cast("long")
    return starts.withColumn("second", second).withColumn("rank_in_second", rank).withColumn("admitted", F.col("rank_in_second") <= per_second)
