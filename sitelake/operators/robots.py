"""robots.txt: parsing into rules, and which URLs they allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelake.functions.urls import js_trim, url_parts


def directives(robots: DataFrame) -> DataFrame:
    """host, pos, name, value of each line that has a directive. robots: host, text."""
    lines = robots.select("host", F.posexplode(F.split(F.col("text"), "\n")).alias("pos", "line"))
    line = js_trim(F.col("line"))
    kept = lines.filter(~line.startswith("#") & F.contains(line, F.lit(":")))
    name = F.lower(js_trim(F.substring_index(line, ":", 1)))
    value = js_trim(F.regexp_replace(line, r"^[^:]*:", ""))
    return kept.select("host", F.col("pos").cast("long").alias("pos"), name.alias("name"), value.alias("value"))


def _grouped(robots: DataFrame) -> DataFrame:
    """Directives with the group that they are in; a group is one file's, so its window is bounded by the file."""
    so_far = Window.partitionBy("host").orderBy("pos")
    agent = F.col("name") == "user-agent"
    return (
        directives(robots)
        .withColumn("group_ix", F.sum(agent.cast("long")).over(so_far))
        .withColumn("user_agent", F.last(F.when(agent, F.col("value")), ignorenulls=True).over(so_far))
        .filter("group_ix > 0")
    )


def parse_rules(robots: DataFrame) -> DataFrame:
    """host, group_ix, user_agent, pattern, is_allow, pos: one row per rule; every user-agent line begins a group."""
    rules = _grouped(robots).filter(F.col("name").isin("allow", "disallow") & (F.col("value") != ""))
    return rules.select("host", "group_ix", "user_agent", F.col("value").alias("pattern"), (F.col("name") == "allow").alias("is_allow"), "pos")


def declared_sitemaps(robots: DataFrame) -> DataFrame:
    """host, n (from 1), sitemap_url, in order of declaration."""
    found = directives(robots).filter((F.col("name") == "sitemap") & (F.col("value") != ""))
    return found.select("host", F.row_number().over(Window.partitionBy("host").orderBy("pos")).cast("long").alias("n"), F.col("value").alias("sitemap_url"))


def crawl_delay(robots: DataFrame, agent: str = "*") -> DataFrame:
    """host, crawl_delay of the first group for the agent (null if it has none)."""
    grouped = _grouped(robots).filter((F.lower("user_agent") == agent.lower()) | (F.col("user_agent") == "*"))
    value = F.expr("try_cast(regexp_extract(value, '^[+-]?[0-9]*\\\\.?[0-9]+', 0) AS double)")
    of_group = grouped.groupBy("host", "group_ix").agg(F.max_by(F.when(F.col("name") == "crawl-delay", value), F.when(F.col("name") == "crawl-delay", F.col("pos"))).alias("crawl_delay"))
    return of_group.groupBy("host").agg(F.min_by("crawl_delay", "group_ix").alias("crawl_delay"))


def pattern_regex(pattern: Column) -> Column:
    """A rule's pattern as a regular expression from the start of a path."""
    anchored = pattern.endswith("$")
    body = F.when(anchored, F.left(pattern, F.length(pattern) - 1)).otherwise(pattern)
    escaped = F.regexp_replace(body, r"([.+?^{}()|\[\]\\$])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(escaped, F.lit("*"), F.lit(".*")), F.when(anchored, F.lit("$")).otherwise(F.lit("")))


def allowed(urls: DataFrame, robots: DataFrame, agent: str = "*", url_col: str = "url") -> DataFrame:
    """urls with a column allowed. The longest pattern decides, allow wins a tie; no rule allows.

    Rules are few per host: they are gathered into one array per host and matched there, so
    a host with very many URLs costs one join row each and nothing is paired off.
    """
    rules = parse_rules(robots).filter((F.lower("user_agent") == agent.lower()) | (F.col("user_agent") == "*"))
    rule = F.struct(F.length("pattern").alias("n"), F.col("is_allow").alias("is_allow"), pattern_regex(F.col("pattern")).alias("regex"))
    by_host = rules.groupBy("host").agg(F.collect_list(rule).alias("__rules")).withColumnRenamed("host", "__host")
    p = url_parts(F.col(url_col))
    tested = urls.withColumn("__of", p["host"]).withColumn("__path", F.concat(p["path"], p["query"]))
    joined = tested.join(by_host, F.col("__of") == F.col("__host"), "left")
    best = F.array_max(F.filter("__rules", lambda r: F.regexp(F.col("__path"), r["regex"])))
    return joined.withColumn("allowed", F.coalesce(best["is_allow"], F.lit(True))).select(*[urls[c] for c in urls.columns], "allowed")
