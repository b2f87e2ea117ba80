"""Entry points over fetched pages and source trees: routing, crawl to files, preview, tree to files."""

from __future__ import annotations

import argparse
import json
import os
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelake.functions import urls as U
from sitelake.operators import frontier, sink, sitemaps
from sitelake.runtime import materialize
from sitelake.sources import files


def route(spark: SparkSession, inputs: list[str]) -> tuple[list[str], list[str]]:
    """(web inputs, repositories): git URLs, and folders that hold a repository."""
    if not inputs:
        return [], []
    marked = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string").withColumn("git", U.is_git_url(F.col("x"))).orderBy("i").collect()
    git = [r.x for r in marked if r.git or os.path.isdir(os.path.join(r.x, ".git"))]
    return [x for x in inputs if x not in git], git


def crawl_to_files(spark: SparkSession, pages: DataFrame, inputs: list[str], folder: str, options: frontier.CrawlOptions = frontier.CrawlOptions(), robots_txt: DataFrame | None = None, sitemap_urls: DataFrame | None = None, max_size_mb: float | None = None, crawled: str | None = None) -> dict:
    """Crawl fetched pages from the inputs and write markdown files; returns pages and bytes written."""
    seeds = spark.createDataFrame(list(enumerate(inputs)), "seq long, url string")
    specific = [r[0] for r in seeds.orderBy("seq").select(U.is_specific_page(F.col("url"))).collect()]
    options = frontier.plan(inputs, specific, options)
    results = frontier.crawl(pages, seeds.select("url", "seq"), options, robots_txt, sitemap_urls)
    cap = int(max_size_mb * 1024 * 1024) if max_size_mb else None
    name = os.path.basename(folder.rstrip("/")) or None
    there = [(f,) for f in os.listdir(folder)] if os.path.isdir(folder) else []
    existing = spark.createDataFrame(there, "filename string") if there else None
    made = materialize(sink.page_files(results, name, cap, F.lit(crawled) if crawled else None, existing), "page_files")
    sink.write_files(made, folder)
    stats = sink.ingest_stats(made).first()
    return {"pages": stats.pages, "bytes": stats.bytes}


def tree_to_files(spark: SparkSession, tree: str, folder: str, max_size_mb: float | None = None, crawled: str | None = None) -> dict:
    made = materialize(sink.source_files(files.read_tree(spark, tree), int(max_size_mb * 1024 * 1024) if max_size_mb else None, F.lit(crawled) if crawled else None), "source_files")
    sink.write_files(made, folder)
    stats = sink.ingest_stats(made).first()
    return {"files": stats.pages, "bytes": stats.bytes}


def preview(sitemap_tables: DataFrame, host: str, limit: int = sitemaps.PREVIEW_ROWS) -> dict:
    """What a site holds, from its sitemaps (host, priority, sitemap_url, xml)."""
    of_host = sitemap_tables.filter(F.col("host") == host)
    found = sitemaps.news_first(of_host)
    if found.isEmpty():  # sitemaps at other places, by the priority that they are given with
        best = sitemaps.first_filled(of_host)
        found = sitemaps.entries(best.select("host", "xml")).orderBy("pos").limit(sitemaps.PREVIEW_URLS)
    summary = sitemaps.preview_summary(found.select(F.col("host").alias("domain"), "loc")).first()
    if summary is None:
        return {"domain": host, "total_pages": 0, "has_sitemap": False, "recent_pages": []}
    recent = [{"url": r["loc"], "lastmod": r["lastmod"]} for r in sitemaps.preview_pages(found, limit).collect()]
    return summary.asDict() | {"recent_pages": recent}


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="sitelake")
    commands = parser.add_subparsers(dest="command", required=True)
    crawl = commands.add_parser("crawl", help="fetched pages (a Parquet table) to markdown files")
    crawl.add_argument("pages")
    crawl.add_argument("inputs", nargs="+")
    crawl.add_argument("--output", default="output")
    crawl.add_argument("--depth", type=int)
    crawl.add_argument("--max-pages", type=int, default=150)
    crawl.add_argument("--include", action="append", default=[])
    crawl.add_argument("--exclude", action="append", default=[])
    crawl.add_argument("--max-size-mb", type=float)
    tree = commands.add_parser("tree", help="a source tree to markdown files")
    tree.add_argument("tree")
    tree.add_argument("--output", default="output")
    look = commands.add_parser("preview", help="a site's sitemaps (a Parquet table)")
    look.add_argument("sitemaps")
    look.add_argument("host")
    look.add_argument("--limit", type=int, default=sitemaps.PREVIEW_ROWS)
    a = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "crawl":
        options = replace(frontier.CrawlOptions(), depth=a.depth, max_pages=a.max_pages, include=tuple(a.include), exclude=tuple(a.exclude))
        print(json.dumps(crawl_to_files(spark, spark.read.parquet(a.pages), a.inputs, a.output, options, max_size_mb=a.max_size_mb)))
    elif a.command == "tree":
        print(json.dumps(tree_to_files(spark, a.tree, a.output)))
    else:
        print(json.dumps(preview(spark.read.parquet(a.sitemaps), a.host, a.limit), indent=2))


if __name__ == "__main__":
    main()
