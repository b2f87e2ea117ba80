"""Sitemaps: parsing, routing of indexes, and the preview of a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelake.functions import fixed
from sitelake.functions import text as T
from sitelake.functions.urls import js_trim

MAX_URLS, MAX_CHILDREN, PREVIEW_URLS, PREVIEW_ROWS = 200, 2, 1000, 20


def _unescape(x: Column) -> Column:
    bare = F.regexp_replace(x, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return js_trim(bare)


def _blocks(xml: Column, tag: str) -> Column:
    return F.regexp_extract_all(xml, F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))


def _field(block: Column, tag: str) -> Column:
    return F.nullif(_unescape(F.regexp_extract(block, rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)), F.lit(""))


def locations(xml: Column, tag: str = "url") -> Column:
    """array<string>: the loc of each <url> (or <sitemap>) in order."""
    return F.filter(F.transform(_blocks(xml, tag), lambda b: _field(b, "loc")), lambda x: x.isNotNull())


def entries(sitemaps: DataFrame, xml_col: str = "xml") -> DataFrame:
    """The other columns, and pos, loc, lastmod, changefreq, priority of each <url>."""
    others = [c for c in sitemaps.columns if c != xml_col]
    rows = sitemaps.select(*others, F.posexplode(_blocks(F.col(xml_col), "url")).alias("pos", "__block"))
    b = F.col("__block")
    given = _field(b, "priority")
    number = F.regexp_extract(given, r"^[+-]?[0-9]*\.?[0-9]+", 0)
    priority = F.when(given.isNotNull(), F.coalesce(F.nullif(number, F.lit("")).cast("double"), F.lit(float("nan"))))
    return rows.select(*others, F.col("pos").cast("long").alias("pos"), _field(b, "loc").alias("loc"), _field(b, "lastmod").alias("lastmod"), _field(b, "changefreq").alias("changefreq"), priority.alias("priority")).filter("loc is not null")


def first_filled(sitemaps: DataFrame) -> DataFrame:
    """Of each host the sitemap of least priority number that has a <loc>. sitemaps: host, priority, sitemap_url, xml."""
    filled = sitemaps.filter(F.size(F.concat(locations(F.col("xml")), locations(F.col("xml"), "sitemap"))) > 0)
    best = filled.groupBy("host").agg(F.min_by(F.struct("priority", "sitemap_url", "xml"), F.struct("priority", "sitemap_url")).alias("s"))
    return best.select("host", "s.priority", "s.sitemap_url", "s.xml")


def routed_urls(sitemaps: DataFrame, library: DataFrame | None = None, most: int = MAX_URLS, children: int = MAX_CHILDREN) -> DataFrame:
    """host, pos, loc: an index's first children (looked up in library by sitemap_url) or the sitemap's own URLs; at most `most` a host."""
    library = sitemaps if library is None else library
    index = F.contains(F.col("xml"), F.lit("<sitemapindex"))
    own = sitemaps.filter(~index).select("host", F.lit(0).cast("long").alias("child"), F.posexplode(locations(F.col("xml"))).alias("pos", "loc"))
    named = sitemaps.filter(index).select("host", F.posexplode(F.slice(locations(F.col("xml"), "sitemap"), 1, children)).alias("child", "child_url"))
    texts = library.select(F.col("sitemap_url").alias("child_url"), F.col("xml").alias("child_xml"))
    below = named.join(texts, "child_url").select("host", F.col("child").cast("long").alias("child"), F.posexplode(locations(F.col("child_xml"))).alias("pos", "loc"))
    order = Window.partitionBy("host").orderBy("child", "pos")
    ranked = own.unionByName(below).withColumn("pos", F.row_number().over(order).cast("long"))
    return ranked.filter(F.col("pos") <= most).select("host", "pos", "loc")


def news_first(sitemaps: DataFrame, most: int = PREVIEW_URLS) -> DataFrame:
    """host, pos, loc, lastmod, changefreq, priority: at most `most` entries of each host's first filled sitemap.

    sitemaps: host, sitemap_url, xml. News sitemaps come first and keep what they say of an entry; regular ones and the
    children of indexes give only locations. Sitemaps at other paths count only as such children.
    """
    paths = fixed.NEWS_SITEMAPS + fixed.REGULAR_SITEMAPS
    path = F.regexp_extract("sitemap_url", r"^[^:]+://[^/]*(/.*)$", 1)
    placed = sitemaps.withColumn("rank", F.array_position(F.array(*map(F.lit, paths)), path)).filter("rank > 0")
    news = placed.filter(F.col("rank") <= len(fixed.NEWS_SITEMAPS))
    told = entries(news.select("host", "rank", "xml"))
    regular = placed.filter(F.col("rank") > len(fixed.NEWS_SITEMAPS)).select(F.struct("host", "rank").alias("host"), "sitemap_url", "xml")
    plain = routed_urls(regular, sitemaps, most, children=1 << 30).select("host.*", "pos", "loc")
    every = told.unionByName(plain, allowMissingColumns=True)
    first = every.groupBy("host").agg(F.min("rank").alias("rank"))
    ranked = every.join(first, ["host", "rank"]).withColumn("pos", F.row_number().over(Window.partitionBy("host").orderBy("pos")).cast("long"))
    return ranked.filter(F.col("pos") <= most).select("host", "pos", "loc", "lastmod", "changefreq", "priority")


def preview_pages(found: DataFrame, most: int = PREVIEW_ROWS) -> DataFrame:
    """loc, lastmod of the `most` latest entries (0: the default); entries without a date last, then in order."""
    when = T.parse_date(F.col("lastmod"))
    return found.orderBy(when.desc_nulls_last(), "pos").limit(most or PREVIEW_ROWS).select("loc", "lastmod")


def preview_summary(found: DataFrame) -> DataFrame:
    """domain, total_pages, has_sitemap, estimated_size. found: domain, loc."""
    counted = found.groupBy("domain").agg(F.count("loc").alias("total_pages"))
    return counted.select("domain", "total_pages", (F.col("total_pages") > 0).alias("has_sitemap"), T.size_estimate(F.col("domain"), F.col("total_pages")).alias("estimated_size"))
