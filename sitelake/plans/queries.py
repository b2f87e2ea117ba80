"""Queries over the provided tables, one or more for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelake.functions import blocks, fixed
from sitelake.functions import text as T
from sitelake.functions import urls as U
from sitelake.operators import dedup, extract, fetches, frontier, robots, sink, sitemaps
from sitelake.runtime import shared_path
from sitelake.sources import files
from sitelake.streaming import pages as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def listed(xs: list[str]) -> str:
    return "[" + ", ".join(map(quoted, xs)) + "]"


# ---- SQL pieces -------------------------------------------------------------------------------------------------
WS = "[\\t\\n\\x0B\\f\\r \\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"
NOT_WORD = "[^A-Za-z0-9_" + WS[1:]


def s_scheme(u: str) -> str:
    return f"lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1))"


def s_host(u: str) -> str:
    return f"lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"


def s_path(u: str) -> str:
    return f"coalesce(nullif(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), '/')"


def s_query(u: str) -> str:
    return f"regexp_extract({u}, '^[^?#]*(\\?[^#]*)', 1)"


def s_without(query: str, names: list[str]) -> str:
    kept = f"list_filter(string_split(substr({query}, 2), '&'), lambda p: p <> '' AND NOT list_contains({listed(names)}, split_part(p, '=', 1)))"
    return f"CASE WHEN len({kept}) = 0 THEN '' ELSE '?' || array_to_string({kept}, '&') END"


def s_norm(u: str) -> str:
    path = s_path(u)
    return f"{s_scheme(u)} || '://' || {s_host(u)} || CASE WHEN {path} = '/' THEN '/' ELSE regexp_replace({path}, '/$', '') END || {s_without(s_query(u), fixed.TRACKING_PARAMS)}"


def s_base(u: str) -> str:
    return f"regexp_replace({s_host(u)}, '^www\\.', '')"


def s_trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def s_locale(rows: str, u: str, columns: str) -> str:
    """A query: columns of rows, and host, locale, language, country, canonical of the URL u."""
    lang, country, wrong = listed(fixed.LANGUAGES), listed(fixed.COUNTRIES), listed(fixed.NOT_LOCALES)
    param = ", ".join(f"nullif(regexp_extract(q, '[?&]{n}=([^&]*)', 1), '')" for n in fixed.LOCALE_PARAMS)
    return f"""
SELECT {columns}, host,
  CASE WHEN s THEN CASE WHEN s2 THEN a || '-' || b ELSE a END WHEN m THEN CASE WHEN m2 THEN c || '-' || d ELSE c END
       WHEN k THEN CASE WHEN k2 THEN e || '-' || f ELSE e END END AS locale,
  CASE WHEN s AND list_contains({lang}, a) THEN a WHEN m AND list_contains({lang}, c) THEN c WHEN NOT s AND NOT m AND k THEN e END AS language,
  CASE WHEN s THEN CASE WHEN s2 THEN b WHEN NOT list_contains({lang}, a) THEN a END
       WHEN m THEN CASE WHEN m2 THEN d WHEN NOT list_contains({lang}, c) THEN c END WHEN k AND k2 THEN f END AS country,
  CASE WHEN s THEN coalesce(nullif(regexp_replace(p, '(?i)^/[a-z]{{2}}([-_][a-z]{{2}})?(/|$)', '\\2'), ''), '/')
       WHEN m THEN regexp_replace(p, '(?i)/[a-z]{{2}}([-_][a-z]{{2}})?/', '/') ELSE p END || {s_without('q', fixed.LOCALE_PARAMS)} AS canonical
FROM (
  SELECT *, (list_contains({lang}, a) OR list_contains({country}, a)) AS s, (list_contains({country}, b) OR list_contains({lang}, b)) AS s2,
    NOT (list_contains({lang}, a) OR list_contains({country}, a)) AND (list_contains({lang}, c) OR list_contains({country}, c)) AND NOT list_contains({wrong}, c) AS m,
    list_contains({country}, d) AS m2, coalesce(list_contains({lang}, e), false) AS k, coalesce(list_contains({country}, f), false) AS k2
  FROM (
    SELECT *, split_part(lower(lp), '-', 1) AS e, split_part(lower(lp), '-', 2) AS f FROM (
      SELECT *, replace(coalesce({param}), '_', '-') AS lp,
        lower(regexp_extract(p, '(?i)^/([a-z]{{2}})([-_]([a-z]{{2}}))?(/|$)', 1)) AS a, lower(regexp_extract(p, '(?i)^/([a-z]{{2}})([-_]([a-z]{{2}}))?(/|$)', 3)) AS b,
        lower(regexp_extract(p, '(?i)/([a-z]{{2}})([-_]([a-z]{{2}}))?/', 1)) AS c, lower(regexp_extract(p, '(?i)/([a-z]{{2}})([-_]([a-z]{{2}}))?/', 3)) AS d
      FROM (SELECT *, {s_host(u)} AS host, {s_path(u)} AS p, {s_query(u)} AS q FROM {rows}))))
"""


def s_hits(x: str, patterns: list[str]) -> str:
    return "(" + " + ".join(f"regexp_matches({x}, {quoted(p)})::int" for p in patterns) + ")"


def s_block(h: str, status: str) -> list[tuple[str, str, str]]:
    n = f"length({h})"
    return [
        (f"{status} = 403", "forbidden", "0.9"),
        (f"{status} = 429", "rate_limit", "0.95"),
        (f"{status} = 503 AND {s_hits(h, fixed.CLOUDFLARE)} >= 1", "cloudflare", "0.95"),
        (f"{n} < 500 AND (contains({h}, 'challenge') OR contains({h}, 'captcha'))", "empty_body", "0.7"),
        (f"{s_hits(h, fixed.CLOUDFLARE)} >= 2", "cloudflare", "0.9"),
        (f"{n} < 50000 AND {s_hits(h, fixed.DATADOME)} >= 2", "datadome", "0.9"),
        (f"{n} < 50000 AND {s_hits(h, fixed.PERIMETERX)} >= 1", "access_denied", "0.85"),
        (f"{n} < 50000 AND {s_hits(h, fixed.AKAMAI)} >= 2", "access_denied", "0.8"),
        (f"{n} < 10000 AND {s_hits(h, fixed.CAPTCHA)} >= 2", "captcha", "0.85"),
        (f"{n} < 3000 AND {s_hits(h, fixed.GENERIC_BLOCK)} >= 1", "access_denied", "0.7"),
        (f"{n} < 5000 AND contains({h}, 'noscript') AND (contains({h}, 'enable javascript') OR contains({h}, 'JavaScript is required')) AND NOT contains({h}, '<article') AND NOT contains({h}, '<main')", "javascript_required", "0.6"),
    ]


def s_reason(h: str, status: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in s_block(h, status)) + " END"


def s_confidence(h: str, status: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {x}" for c, _, x in s_block(h, status)) + " ELSE 0.0 END"


# ---- URLs -------------------------------------------------------------------------------------------------------
@query(f"SELECT page_id, {s_norm('url')} AS norm_url FROM pages")
def normalize_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", U.normalize_url(F.col("url")).alias("norm_url"))


@query(f"SELECT {s_base('url')} AS base_domain, count(*) AS n_pages, count(DISTINCT {s_norm('url')}) AS n_norm FROM pages GROUP BY 1")
def base_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "pages").select(U.base_domain(F.col("url")).alias("base_domain"), U.normalize_url(F.col("url")).alias("norm"))
    return keyed.groupBy("base_domain").agg(F.count(F.lit(1)).alias("n_pages"), F.count_distinct("norm").alias("n_norm"))


#: A page's URL without query and fragment, with an ending that its id chooses.
ENDINGS = [".pdf", ".PDF?x=1", ".html", "/data.json#top", "", "/a.ts?b=c.html"]
S_ENDED = f"regexp_replace(url, '[?#].*$', '') || {listed(ENDINGS)}[page_id % {len(ENDINGS)} + 1]"


def _ended() -> Column:
    return F.concat(F.regexp_replace("url", "[?#].*$", ""), F.get(F.array(*map(F.lit, ENDINGS)), (F.col("page_id") % len(ENDINGS)).cast("int")))


S_ENDINGS = "\\.(" + "|".join(e[1:] for e in fixed.SKIP_EXTENSIONS) + ")$"


@query(f"SELECT page_id, u AS url, regexp_matches(lower({s_path('u')}), '{S_ENDINGS}') AS skip FROM (SELECT page_id, {S_ENDED} AS u FROM pages)")
def skip_ext_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", _ended().alias("url")).withColumn("skip", U.should_skip_url(F.col("url")))


HREFS = ["foo", "/q?r=1", "//cdn.example.org/p", "?p=2", "#t", "mailto:a@b", "tel:1", "javascript:x", "https://y.com/z#h"]


@query(f"""
SELECT page_id, href, CASE WHEN href[1] = '#' OR regexp_matches(href, '^(mailto|javascript|tel):') THEN NULL
  WHEN regexp_matches(href, '^https?://') THEN href WHEN starts_with(href, '//') THEN s || ':' || href
  WHEN href[1] = '/' THEN s || '://' || h || href WHEN href[1] = '?' THEN s || '://' || h || '/' || href ELSE s || '://' || h || '/' || href END AS resolved
FROM (SELECT page_id, {s_scheme('url')} AS s, {s_host('url')} AS h, unnest({listed(HREFS)}) AS href FROM pages)
""")
def resolve_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    hrefs = table(spark, sf_dir, "pages").select("page_id", "url", F.explode(F.array(*map(F.lit, HREFS))).alias("href"))
    return hrefs.select("page_id", "href", U.resolve_url(F.col("href"), F.col("url")).alias("resolved"))


PATHS = ["", "/", "/index.html", "/Default.ASPX", "/index.php", "/docs", "/index.htmlx"]


@query(f"SELECT page_id, path, NOT (path IN ('', '/') OR regexp_matches(path, '(?i)^/(index\\.(html?|php|aspx?)|default\\.(html?|aspx?))$')) AS specific FROM (SELECT page_id, unnest({listed(PATHS)}) AS path FROM pages)")
def specific_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.explode(F.array(*map(F.lit, PATHS))).alias("path"))
    url = F.concat(F.lit("https://"), U.url_parts(F.col("url"))["host"], F.col("path"))
    return rows.select("page_id", "path", U.is_specific_page(url).alias("specific"))


HOSTS = ["www.linkedin.com", "m.facebook.com", "x.com", "notx.com", "yelp.com.example.org", "docs.example.com", "a.www.zillow.com"]
S_PROTECTED = "(^|\\.)(" + "|".join(h.replace(".", "\\.") for h in fixed.PROTECTED_HOSTS) + ")$"


@query(f"SELECT page_id, host, regexp_matches(regexp_replace(host, '^(.*?)www\\.', '\\1'), '{S_PROTECTED}') AS needs_browser FROM (SELECT page_id, {listed(HOSTS)}[page_id % {len(HOSTS)} + 1] AS host FROM pages)")
def protected_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.get(F.array(*map(F.lit, HOSTS)), (F.col("page_id") % len(HOSTS)).cast("int"))
    url = F.concat(F.lit("https://"), host, U.url_parts(F.col("url"))["path"])
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host"), U.needs_browser(url).alias("needs_browser"))


REPOS = ["https://github.com/a/b.git", "https://gitlab.com/g/p", "git@github.com:x/y.git", "https://bitbucket.org/t/r/", "https://example.com/z.git", "https://example.com/z"]


@query(f"""
SELECT n_nationkey, url, (regexp_matches(url, '^(https://(github\\.com|gitlab\\.com|bitbucket\\.org)/|git@(github|gitlab)\\.com:)') OR ends_with(url, '.git')) AS is_git,
  coalesce(nullif(regexp_extract(url, '/([^/]+?)(\\.git)?$', 1), ''), nullif(string_split(url, '/')[-1], ''), 'repo') AS repo,
  coalesce(nullif(string_split(url, '/')[-1], ''), 'output') AS dir_name
FROM (SELECT n_nationkey, unnest({listed(REPOS)}) AS url FROM nation)
""")
def git_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.array(*map(F.lit, REPOS))).alias("url"))
    return rows.select("n_nationkey", "url", U.is_git_url(F.col("url")).alias("is_git"), U.repo_name(F.col("url")).alias("repo"), U.output_dir_name(F.col("url")).alias("dir_name"))


@query(f"""
SELECT page_id, CASE WHEN length(url) <= 30 THEN url WHEN 30 - length(h) - 5 > 10 THEN h || '/...' || right(p, 30 - length(h) - 5) ELSE left(url, 27) || '...' END AS shown,
  lower(regexp_replace(h, '[^A-Za-z0-9.-]', '_', 'g')) || '.json' AS session_file, h AS domain
FROM (SELECT page_id, url, {s_host('url')} AS h, {s_path('url')} AS p FROM pages)
""")
def truncated_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = U.extract_domain(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", U.truncate_url(F.col("url"), 30).alias("shown"), U.session_filename(host).alias("session_file"), host.alias("domain"))


# ---- locales ----------------------------------------------------------------------------------------------------
#: Pages under other locales; seq is the order of arrival.
LOCALE_PATHS = ["", "/en", "/fr-ca", "/de_DE", "/jp", "/docs/es", "/docs/it"]
S_VARIANTS = f"""(SELECT page_id, v, page_id * {len(LOCALE_PATHS)} + v AS seq,
  {s_scheme('url')} || '://' || {s_host('url')} || {listed(LOCALE_PATHS)}[v + 1] || '/p' || (page_id % 7) || CASE WHEN page_id % 5 = 0 THEN '?lang=pt-BR&x=1' ELSE '' END AS u
  FROM pages, range({len(LOCALE_PATHS)}) r(v))"""


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(F.array(*map(F.lit, LOCALE_PATHS))).alias("v", "at"))
    tail = F.when(F.col("page_id") % 5 == 0, F.lit("?lang=pt-BR&x=1")).otherwise(F.lit(""))
    p = U.url_parts(F.col("url"))
    url = F.concat(p["scheme"], F.lit("://"), p["host"], F.col("at"), F.lit("/p"), (F.col("page_id") % 7).cast("string"), tail)
    return rows.select("page_id", F.col("v").cast("long").alias("v"), (F.col("page_id") * len(LOCALE_PATHS) + F.col("v")).alias("seq"), url.alias("url"))


@query(f"SELECT page_id, v, locale IS NOT NULL AS has_locale, locale, language, country, canonical AS canonical_path FROM ({s_locale(S_VARIANTS, 'u', 'page_id, v')})")
def locale_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _variants(spark, sf_dir).withColumn("i", U.locale_info(F.col("url"))).select("page_id", "v", "i.*")


S_DEDUP = f"""
SELECT seq, key AS dedup_key, class AS locale_class, keep, CASE WHEN NOT keep THEN 'locale:' || locale END AS reason, (class = 'N' OR first) AS new_total FROM (
  SELECT *, class = 'N' OR (class = 'P' AND NOT np) OR (class = 'O' AND first) AS keep FROM (
    SELECT *, coalesce(max((class IN ('N', 'P'))::int) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS np,
      row_number() OVER (PARTITION BY key ORDER BY seq) = 1 AS first
    FROM (SELECT seq, locale, host || canonical AS key, CASE WHEN locale IS NULL THEN 'N' WHEN language = 'en' THEN 'P' ELSE 'O' END AS class FROM ({s_locale(S_VARIANTS, 'u', 'seq')}))))
"""


@query(S_DEDUP)
def locale_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.locale_dedup(_variants(spark, sf_dir)).select("seq", "dedup_key", "locale_class", "keep", "reason", "new_total")


@query(f"SELECT count(*) FILTER (new_total) AS total, count(*) FILTER (NOT keep) AS locale_skipped, count(DISTINCT dedup_key) AS unique_paths FROM ({S_DEDUP})")
def locale_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.locale_stats(dedup.locale_dedup(_variants(spark, sf_dir)))


TAILS = ["", "#top", "?utm_source=feed", "/"]
S_TAILED = f"(SELECT page_id * {len(TAILS)} + v AS seq, regexp_replace(url, '[?#].*$', '') || {listed(TAILS)}[v + 1] AS url FROM pages, range({len(TAILS)}) r(v))"


@query(f"SELECT seq, url, {s_norm('url')} AS norm_url FROM {S_TAILED} QUALIFY row_number() OVER (PARTITION BY {s_norm('url')} ORDER BY seq) = 1")
def visited_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("u"), F.posexplode(F.array(*map(F.lit, TAILS))).alias("v", "tail"))
    seen = rows.select((F.col("page_id") * len(TAILS) + F.col("v")).alias("seq"), F.concat("u", "tail").alias("url"))
    return dedup.first_seen(seen, U.normalize_url(F.col("url")), "seq").withColumn("norm_url", U.normalize_url(F.col("url")))


# ---- fetches ----------------------------------------------------------------------------------------------------
PHRASES = ["", "cloudflare", "Just a moment... cloudflare", "datadome geo.captcha-delivery.com", "_pxhd", "akamai ak_bmsc", "recaptcha", "Access Denied", "noscript enable javascript", "challenge", "ordinary"]
STATUSES = ["200", "403", "429", "503", "200", "404", "200"]
S_FETCHES = f"""(SELECT page_id, url, e AS priority, ['fetch', 'browser', 'stealth'][e + 1] AS engine,
  {listed(STATUSES)}[(page_id + e) % {len(STATUSES)} + 1]::int AS status_code,
  html || {listed(PHRASES)}[(page_id * 3 + e) % {len(PHRASES)} + 1] AS html
  FROM pages, range(3) r(e))"""


def _fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", "url", "html", F.posexplode(F.array(*map(F.lit, ["fetch", "browser", "stealth"]))).alias("priority", "engine"))
    pick = lambda xs, at: F.get(F.array(*map(F.lit, xs)), (at % len(xs)).cast("int"))
    page, e = F.col("page_id"), F.col("priority")
    return rows.select("page_id", "url", "engine", "priority", pick(STATUSES, page + e).cast("int").alias("status_code"), F.concat("html", pick(PHRASES, page * 3 + e)).alias("html"), F.col("url").alias("final_url"))


S_JUDGED = f"(SELECT *, {s_reason('html', 'status_code')} AS reason, {s_confidence('html', 'status_code')}::double AS confidence FROM {S_FETCHES})"


@query(f"SELECT page_id, engine, reason IS NOT NULL AS blocked, reason, confidence FROM {S_JUDGED}")
def block_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetches.judged(_fetches(spark, sf_dir)).select("page_id", "engine", "blocked", "reason", "confidence")


@query(f"SELECT coalesce(reason, 'none') AS reason, count(*) AS n FROM {S_JUDGED} GROUP BY 1")
def block_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetches.judged(_fetches(spark, sf_dir)).groupBy(F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


S_PICKED = f"(SELECT * FROM {S_JUDGED} WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY priority, engine) = 1)"


@query(f"SELECT url, engine, status_code FROM {S_PICKED}")
def waterfall_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetches.pick(_fetches(spark, sf_dir)).select("url", "engine", "status_code")


@query(f"SELECT engine, count(*) AS n FROM {S_PICKED} GROUP BY 1 UNION ALL SELECT 'blocked', count(*) FROM (SELECT DISTINCT url FROM pages) p WHERE p.url NOT IN (SELECT url FROM {S_PICKED})")
def engine_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetches.engine_stats(_fetches(spark, sf_dir))


# ---- robots -----------------------------------------------------------------------------------------------------
ROBOTS = ["# rules", "User-agent: *", "Disallow: /fr/", "Allow: /fr/8", "Disallow: /*.html$", "Crawl-delay: 2.5", "no colon here", "Sitemap: https://{host}/sm.xml", "User-agent: otherbot", "Disallow: /", "User-agent: *", "Disallow: /es/1 # note", "Disallow: /de/?page", "Allow:", "Sitemap: https://{host}/two.xml"]
S_TEXT = " || chr(10) || ".join(quoted(x).replace("{host}", "' || host || '") for x in ROBOTS)
S_ROBOTS = f"(SELECT host, {S_TEXT} AS text FROM (SELECT DISTINCT {s_host('url')} AS host FROM pages) WHERE NOT starts_with(host, 'www.'))"


def _robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = table(spark, sf_dir, "pages").select(U.url_parts(F.col("url"))["host"].alias("host")).distinct().filter(~F.col("host").startswith("www."))
    return hosts.withColumn("text", F.replace(F.lit("\n".join(ROBOTS)), F.lit("{host}"), F.col("host")))


S_LINES = f"""
WITH lines AS (SELECT host, pos, lower(trim(split_part(line, ':', 1))) AS name, trim(regexp_replace(line, '^[^:]*:', '')) AS value
  FROM (SELECT host, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM {S_ROBOTS})
  WHERE NOT starts_with(line, '#') AND contains(line, ':')),
grouped AS (SELECT *, sum((name = 'user-agent')::int) OVER w AS group_ix, last_value(CASE WHEN name = 'user-agent' THEN value END IGNORE NULLS) OVER w AS user_agent
  FROM lines WINDOW w AS (PARTITION BY host ORDER BY pos)),
rules AS (SELECT host, group_ix, user_agent, value AS pattern, name = 'allow' AS is_allow, pos FROM grouped WHERE group_ix > 0 AND name IN ('allow', 'disallow') AND value <> '')
"""


@query(S_LINES + "SELECT host, group_ix::bigint AS group_ix, user_agent, pattern, is_allow, pos FROM rules")
def robots_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robots.parse_rules(_robots(spark, sf_dir))


@query(S_LINES + f"""
SELECT p.page_id, coalesce(max_by(r.is_allow, length(r.pattern) * 2 + r.is_allow::int), true) AS allowed
FROM pages p LEFT JOIN rules r ON {s_host('p.url')} = r.host AND r.user_agent = '*' AND regexp_matches({s_path('p.url')} || {s_query('p.url')},
  '^' || replace(regexp_replace(rtrim(r.pattern, '$'), '([.+?^{{}}()|\\[\\]\\\\])', '\\\\\\1', 'g'), '*', '.*') || CASE WHEN ends_with(r.pattern, '$') THEN '$' ELSE '' END)
GROUP BY p.page_id
""")
def robots_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robots.allowed(table(spark, sf_dir, "pages").select("page_id", "url"), _robots(spark, sf_dir)).select("page_id", "allowed")


@query(S_LINES + "SELECT host, min_by(d, group_ix) AS crawl_delay FROM (SELECT host, group_ix, max(CASE WHEN name = 'crawl-delay' THEN value::double END) AS d FROM grouped WHERE group_ix > 0 AND user_agent = '*' GROUP BY 1, 2) GROUP BY 1")
def crawl_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robots.crawl_delay(_robots(spark, sf_dir))


@query(S_LINES + "SELECT host, row_number() OVER (PARTITION BY host ORDER BY pos) AS n, value AS sitemap_url FROM lines WHERE name = 'sitemap'")
def declared_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robots.declared_sitemaps(_robots(spark, sf_dir))


# ---- sitemaps ---------------------------------------------------------------------------------------------------
S_SITEMAPS = f"""(SELECT host, 0 AS priority, 'https://' || host || '/sitemap.xml' AS sitemap_url, '<urlset>' || string_agg('<url><loc> ' || replace(url, '&', '&amp;') || ' </loc>' ||
  CASE WHEN page_id % 4 = 0 THEN '' ELSE '<lastmod>2024-' || lpad((page_id % 12 + 1)::varchar, 2, '0') || '-' || lpad((page_id % 28 + 1)::varchar, 2, '0') || '</lastmod>' END ||
  CASE WHEN page_id % 3 = 0 THEN '<changefreq>daily</changefreq><priority>0.' || (page_id % 10) || '</priority>' ELSE '' END || '</url>', chr(10) ORDER BY page_id) || '</urlset>' AS xml
  FROM (SELECT *, {s_host('url')} AS host FROM pages) GROUP BY host)"""


def _sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    page, two = F.col("page_id"), lambda x: F.lpad(x.cast("string"), 2, "0")
    lastmod = F.when(page % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("<lastmod>2024-"), two(page % 12 + 1), F.lit("-"), two(page % 28 + 1), F.lit("</lastmod>")))
    rest = F.when(page % 3 == 0, F.concat(F.lit("<changefreq>daily</changefreq><priority>0."), (page % 10).cast("string"), F.lit("</priority>"))).otherwise(F.lit(""))
    entry = F.concat(F.lit("<url><loc> "), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit(" </loc>"), lastmod, rest, F.lit("</url>"))
    of = table(spark, sf_dir, "pages").select(U.url_parts(F.col("url"))["host"].alias("host"), F.struct("page_id", entry.alias("entry")).alias("e"))
    xml = F.concat(F.lit("<urlset>"), F.array_join(F.transform(F.sort_array(F.collect_list("e")), lambda e: e["entry"]), "\n"), F.lit("</urlset>"))
    return of.groupBy("host").agg(xml.alias("xml")).select("host", F.lit(0).alias("priority"), F.concat(F.lit("https://"), "host", F.lit("/sitemap.xml")).alias("sitemap_url"), "xml")


S_ENTRIES = f"""(SELECT host, pos, replace(trim(regexp_extract(b, '<loc>(.*?)</loc>', 1)), '&amp;', '&') AS loc, nullif(regexp_extract(b, '<lastmod>(.*?)</lastmod>', 1), '') AS lastmod,
  nullif(regexp_extract(b, '<changefreq>(.*?)</changefreq>', 1), '') AS changefreq, nullif(regexp_extract(b, '<priority>(.*?)</priority>', 1), '')::double AS priority
  FROM (SELECT host, unnest(bs) AS b, unnest(range(len(bs))) AS pos FROM (SELECT host, regexp_extract_all(xml, '(?s)<url>(.*?)</url>', 1) AS bs FROM {S_SITEMAPS})))"""


@query(f"SELECT host, pos + 1 AS pos, loc FROM {S_ENTRIES} WHERE pos < {sitemaps.MAX_URLS}")
def sitemap_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitemaps.routed_urls(sitemaps.first_filled(_sitemaps(spark, sf_dir)))


@query(f"SELECT host, pos, loc, lastmod, changefreq, priority FROM {S_ENTRIES}")
def sitemap_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitemaps.entries(_sitemaps(spark, sf_dir).select("host", "xml"))


S_INDEX = f"""(SELECT host, pos, url FROM (SELECT {s_host('url')} AS host, url, row_number() OVER (PARTITION BY {s_host('url')} ORDER BY page_id) AS pos FROM pages))"""


@query(f"SELECT '0' AS host, row_number() OVER (ORDER BY i, pos) AS pos, loc FROM (SELECT i, e.pos, e.loc FROM {S_ENTRIES} e JOIN (SELECT host, row_number() OVER (ORDER BY host) AS i FROM {S_SITEMAPS} QUALIFY i <= 2) h USING (host)) QUALIFY row_number() OVER (ORDER BY i, pos) <= {sitemaps.MAX_URLS}")
def sitemap_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    library = _sitemaps(spark, sf_dir)
    names = F.sort_array(F.collect_list("sitemap_url"))
    index = library.agg(F.concat(F.lit("<sitemapindex>"), F.array_join(F.transform(names, lambda u: F.concat(F.lit("<sitemap><loc>"), u, F.lit("</loc></sitemap>"))), ""), F.lit("</sitemapindex>")).alias("xml"))
    return sitemaps.routed_urls(index.select(F.lit("0").alias("host"), F.lit("https://0/sitemap_index.xml").alias("sitemap_url"), "xml"), library)


@query(f"""
SELECT host, pos + 1 AS pos, loc, CASE WHEN length(host) % 2 = 0 THEN lastmod END AS lastmod, CASE WHEN length(host) % 2 = 0 THEN changefreq END AS changefreq, CASE WHEN length(host) % 2 = 0 THEN priority END AS priority
FROM {S_ENTRIES} WHERE pos < {sitemaps.PREVIEW_URLS}
""")
def sitemap_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the hosts have a news sitemap too."""
    regular = _sitemaps(spark, sf_dir).select("host", "sitemap_url", "xml")
    news = regular.filter(F.length("host") % 2 == 0).withColumn("sitemap_url", F.concat(F.lit("https://"), "host", F.lit("/news-sitemap.xml")))
    return sitemaps.news_first(regular.unionByName(news))


@query(f"SELECT loc, lastmod FROM (SELECT *, row_number() OVER (ORDER BY lastmod DESC NULLS LAST, page_id) AS k FROM (SELECT page_id, url AS loc, CASE WHEN page_id % 4 = 0 THEN NULL ELSE '2024-' || lpad((page_id % 12 + 1)::varchar, 2, '0') || '-' || lpad((page_id % 28 + 1)::varchar, 2, '0') END AS lastmod FROM pages)) WHERE k <= 20")
def preview_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    page, two = F.col("page_id"), lambda x: F.lpad(x.cast("string"), 2, "0")
    lastmod = F.when(page % 4 != 0, F.concat(F.lit("2024-"), two(page % 12 + 1), F.lit("-"), two(page % 28 + 1)))
    return sitemaps.preview_pages(table(spark, sf_dir, "pages").select(page.alias("pos"), F.col("url").alias("loc"), lastmod.alias("lastmod")))


@query(f"""
SELECT domain, total_pages, total_pages > 0 AS has_sitemap, floor(mb + 0.5)::bigint::varchar || 'MB ' || CASE WHEN mb < 50 THEN '(fits in free tier)' ELSE '(needs API key for full crawl)' END AS estimated_size
FROM (SELECT {s_base('url')} AS domain, count(*) AS total_pages, count(*) * CASE WHEN contains({s_base('url')}, 'cnn') OR contains({s_base('url')}, 'news') THEN 300 ELSE 100 END / 1024.0 AS mb FROM pages GROUP BY 1)
""")
def preview_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitemaps.preview_summary(table(spark, sf_dir, "pages").select(U.base_domain(F.col("url")).alias("domain"), F.col("url").alias("loc")))


# ---- pages ------------------------------------------------------------------------------------------------------
S_LINKS = f"""(SELECT page_id, page, href, min(i) AS i FROM (
  SELECT page_id, page, i, s || '://' || h || array_to_string(list_transform(string_split(p, ''), lambda c: CASE WHEN regexp_matches(c, '^[^\\x21-\\x7e]$|^["<>`{{}}]$') THEN url_encode(c) ELSE c END), '') AS href
  FROM (SELECT page_id, url AS page, {s_scheme('url')} AS s, {s_host('url')} AS h, unnest(range(len(hs))) AS i, unnest(hs) AS p
        FROM (SELECT *, regexp_extract_all(html, '<a\\s(?:[^>]*?\\s)?href=["'']([^"'']+)["'']', 1) AS hs FROM pages))) GROUP BY 1, 2, 3)"""
S_KEPT_LINKS = f"(SELECT page_id, page, href, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos FROM {S_LINKS} WHERE NOT regexp_matches(lower({s_path('href')}), '{S_ENDINGS}'))"


@query(f"SELECT page_id, pos, href FROM {S_KEPT_LINKS}")
def links_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select("page_id", F.posexplode(extract.links_by_pattern(F.col("html"), F.col("url"))).alias("pos", "href"))
    return found.select("page_id", F.col("pos").cast("long").alias("pos"), "href")


@query(f"SELECT page_id, pos, href, {s_host('href')} = {s_host('page')} AS is_internal FROM {S_KEPT_LINKS}")
def links_dom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.links_with_meta(table(spark, sf_dir, "pages")).select("page_id", "pos", "href", "is_internal")


@query(f"""
SELECT page_id, coalesce(nullif({s_trim(f"regexp_split_to_array(t, '{WS}*[|–—-]{WS}*')[1]")}, ''), url) AS title
FROM (SELECT page_id, url, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS t FROM pages)
""")
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", T.title_of([title], F.col("url"), F.lit("/")).alias("title"))


@query(f"SELECT page_id, {s_trim(f"regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '{WS}+', ' ', 'g')")} AS plain FROM pages")
def tag_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.strip_tags(F.col("html")).alias("plain"))


@query()
def extract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = extract.extract_pages(table(spark, sf_dir, "pages"))
    return made.withColumn("links", F.array_join("links", " "))


@query()
def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_pages(table(spark, sf_dir, "pages"), include_links=False).select("page_id", "markdown", "word_count", "byte_size")


# ---- documents --------------------------------------------------------------------------------------------------
def s_plain(x: str) -> str:
    for pattern, into in T.PLAIN_STEPS:
        x = f"regexp_replace({x}, {quoted(pattern)}, {quoted(into.replace('$1', chr(92) + '1'))}, 'g')"
    return s_trim(x)


MARKED = "# Head **b**\n\n- item `c`\n1. one\n> said\n---\n![alt](s) [link](u) _e_\n"


@query(f"SELECT doc_id, {s_plain('replace(' + quoted(MARKED) + ", chr(92) || 'n', chr(10)) || text")} AS plain FROM documents")
def plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.plain_text(F.concat(F.lit(MARKED), "text")).alias("plain"))


CODES = ["import React from 'react'", "const x: number = 1", "type A = B: string", "let y = (x) => 1", "{\"a\": 1}", "[1, 2]", "npm install x", "SELECT 1", "#!/bin/sh", "import <a/> >"]


@query(f"""
SELECT n_nationkey, code, CASE WHEN contains(code, 'import') AND (contains(code, 'React') OR (contains(code, '<') AND contains(code, '/>'))) THEN 'jsx'
  WHEN contains(code, ': ') AND (contains(code, 'interface') OR contains(code, 'type ') OR contains(code, 'as ') OR contains(code, ': string') OR contains(code, ': number')) THEN 'typescript'
  WHEN contains(code, 'import ') OR contains(code, 'export ') OR contains(code, '=>') OR contains(code, 'const ') OR contains(code, 'let ') THEN 'javascript'
  WHEN regexp_matches(code, '^[{{\\[]') AND json_valid(code) AND (contains(code, ':') OR contains(code, ',')) THEN 'json'
  WHEN contains(code, '#!/bin/') OR contains(code, 'npm ') OR contains(code, 'yarn ') OR contains(code, 'bun ') OR contains(code, '$ ') THEN 'bash' ELSE 'javascript' END AS language
FROM (SELECT n_nationkey, unnest({listed(CODES)}) AS code FROM nation)
""")
def infer_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.array(*map(F.lit, CODES))).alias("code"))
    return rows.select("n_nationkey", "code", T.infer_language(F.col("code")).alias("language"))


S_PLAIN_PRINT = f"(SELECT doc_id, {s_trim(f"regexp_replace(regexp_replace(lower(coalesce(text, '')), '{WS}+', ' ', 'g'), '{NOT_WORD}', '', 'g')")} AS t FROM documents)"
S_PRINTS = f"(SELECT doc_id, CASE WHEN length(t) < 500 THEN t ELSE left(t, 300) || '|' || substr(t, length(t) // 2 - 149, 300) || '|' || right(t, 300) END AS fp FROM {S_PLAIN_PRINT})"


@query(f"SELECT doc_id, fp AS fingerprint FROM {S_PRINTS}")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.fingerprint(F.coalesce("text", F.lit(""))).alias("fingerprint"))


S_PAIRS = f"""
prints AS {S_PRINTS}, sets AS (SELECT doc_id, fp, list_distinct(list_filter(regexp_split_to_array(fp, '{WS}+'), lambda w: length(w) > 3)) AS ws FROM prints),
pairs AS (SELECT a, b, s FROM (SELECT x.doc_id AS a, y.doc_id AS b, CASE WHEN x.fp = y.fp THEN 1.0 WHEN len(x.ws) = 0 OR len(y.ws) = 0 THEN 0.0
  ELSE len(list_intersect(x.ws, y.ws))::double / (len(x.ws) + len(y.ws) - len(list_intersect(x.ws, y.ws))) END AS s
  FROM sets x JOIN sets y ON x.doc_id < y.doc_id AND (x.fp = y.fp OR least(len(x.ws), len(y.ws)) >= 0.85 * greatest(len(x.ws), len(y.ws)))) WHERE s >= 0.85)
"""


@query(f"""
WITH {S_PAIRS}, firsts AS (SELECT fp, min(doc_id) AS rep FROM prints GROUP BY 1)
SELECT a, b, round(s, 6)::double AS similarity FROM pairs WHERE a IN (SELECT rep FROM firsts) AND b IN (SELECT rep FROM firsts)
UNION ALL SELECT rep, doc_id, 1.0::double FROM prints JOIN firsts USING (fp) WHERE doc_id <> rep
""")
def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.similar_pairs(table(spark, sf_dir, "documents")).withColumn("similarity", F.round("similarity", 6))


@query(f"""
WITH RECURSIVE {S_PAIRS},
before AS (SELECT d.doc_id AS id, row_number() OVER (ORDER BY d.doc_id) AS i, coalesce(list(p.a) FILTER (p.a IS NOT NULL), []) AS near FROM documents d LEFT JOIN pairs p ON p.b = d.doc_id GROUP BY d.doc_id),
walk AS (SELECT 0::bigint AS i, []::bigint[] AS kept UNION ALL SELECT w.i + 1, CASE WHEN list_has_any(w.kept, n.near) THEN w.kept ELSE list_append(w.kept, n.id) END FROM walk w JOIN before n ON n.i = w.i + 1),
done AS (SELECT kept FROM walk ORDER BY i DESC LIMIT 1),
led AS (SELECT id, list_contains(kept, id) AS keep, list_min(list_intersect(near, kept)) AS first FROM before, done)
SELECT id, keep, CASE WHEN keep THEN id ELSE first END AS leader, CASE WHEN NOT keep THEN 'similar:' || floor(p.s * 100 + 0.5)::int || '%' END AS reason
FROM led LEFT JOIN pairs p ON p.a = led.first AND p.b = led.id AND NOT led.keep
""")
def similar_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.similar_leaders(table(spark, sf_dir, "documents"))


@query(f"SELECT fp AS fingerprint, count(*) AS n, min(doc_id) AS first_id FROM {S_PRINTS} GROUP BY 1 HAVING count(*) > 1")
def exact_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = table(spark, sf_dir, "documents").select("doc_id", T.fingerprint(F.coalesce("text", F.lit(""))).alias("fingerprint"))
    return prints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query(f"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '{WS}+'), lambda w: w <> '')) AS words, strlen(text) AS bytes, length(text) AS units FROM documents")
def word_byte_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.word_count(text).alias("words"), T.byte_size(text).alias("bytes"), T.utf16_length(text).cast("long").alias("units"))


@query(f"SELECT doc_id, CASE WHEN length(text) > 500 THEN left(text, 500) || chr(10) || chr(10) || '[Content truncated...]' ELSE text END AS content, CASE WHEN length(text) > 50 THEN left(text, 47) || '...' ELSE text END AS label FROM documents")
def truncate_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.truncate_marked(F.col("text"), 500).alias("content"), T.short_label(F.col("text")).alias("label"))


# ---- files ------------------------------------------------------------------------------------------------------
def s_safe(x: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({x}, '[^a-zA-Z0-9._-]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g')"


def s_stem(u: str) -> str:
    path = f"lower(replace(regexp_replace(regexp_replace({s_path(u)}, '^/', ''), '/$', ''), '/', '_'))"
    return f"left({s_safe(s_base(u))} || '__' || {s_safe(f"coalesce(nullif({path}, ''), 'index')")}, 200)"


S_NAMES = f"(SELECT page_id, url, html, stem, stem || CASE WHEN n > 1 THEN '-' || (n - 1)::varchar ELSE '' END || '.md' AS filename FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY page_id) AS n FROM (SELECT page_id, url, html, {s_stem("regexp_replace(url, '/[0-9]+', '')")} AS stem FROM pages)))"


@query(f"SELECT page_id, filename FROM {S_NAMES}")
def filenames_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page numbers are taken out of the URLs, so that names clash."""
    stems = table(spark, sf_dir, "pages").select("page_id", sink.file_stem(F.regexp_replace("url", "/[0-9]+", "")).alias("stem"))
    return sink.unique_names(stems, seq="page_id").select("page_id", "filename")


CRAWLED = "2024-01-01T00:00:00.000Z"
S_FRONT = f"""'---' || chr(10) || 'title: "' || t || '"' || chr(10) || 'url: "' || url || '"' || chr(10) || CASE WHEN page_id % 2 = 0 THEN 'author: "A \\"B\\""' || chr(10) ELSE '' END || 'crawled: "{CRAWLED}"' || chr(10) || '---' || chr(10)"""


@query(f"""SELECT page_id, {S_FRONT} AS front FROM (SELECT page_id, url, replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '"', '\\"') AS t FROM pages)""")
def frontmatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    author = F.when(F.col("page_id") % 2 == 0, F.lit('A "B"'))
    return table(spark, sf_dir, "pages").select("page_id", sink.front_matter(title, F.col("url"), author, F.lit(None).cast("string"), F.lit(CRAWLED)).alias("front"))


@query("SELECT doc_id, bytes, before < 1000000 AS written FROM (SELECT doc_id, strlen(text) AS bytes, coalesce(sum(strlen(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents)")
def size_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", T.byte_size(F.col("text")).alias("bytes"))
    return sink.within_cap(rows, 1_000_000, seq="doc_id")


@query(f"SELECT count(*) AS pages, sum(strlen({S_FRONT} || plain)) :: bigint AS bytes FROM (SELECT page_id, url, 'x' AS t, html AS plain FROM pages)")
def ingest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    author = F.when(F.col("page_id") % 2 == 0, F.lit('A "B"'))
    results = pages.select(F.col("page_id").alias("seq"), "url", F.lit("x").alias("title"), F.col("html").alias("markdown"), author.alias("author"), F.lit(None).cast("string").alias("published_date"))
    return sink.ingest_stats(sink.page_files(results, crawled=F.lit(CRAWLED)))


FILES = ["src/a.py", "pkg/__init__.py", "README.MD", "node_modules/x.js", ".hid/a.py", "package-lock.json", "Makefile", ".env.example", "src/deep/b.H", "lib/empty.rs", "docs/big.md", "web/page.svelte"]
S_FILES = f"(SELECT n_nationkey * {len(FILES)} + i AS seq, {listed(FILES)}[i + 1] AS path, CASE i WHEN 9 THEN 0 WHEN 10 THEN 512001 ELSE 100 + n_nationkey END AS size FROM nation, range({len(FILES)}) r(i))"
S_EXT = "lower(regexp_extract(string_split(path, '/')[-1], '^.+(\\.[^.]*)$', 1))"


@query(f"""
SELECT seq, path, size::bigint AS size, CASE ext {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.LANGUAGE_OF_EXTENSION.items())} ELSE coalesce(nullif(substr(ext, 2), ''), 'text') END AS language
FROM (SELECT *, {S_EXT} AS ext FROM {S_FILES}) WHERE size BETWEEN 1 AND {fixed.MAX_FILE_BYTES} AND list_contains({listed(fixed.CODE_EXTENSIONS)}, ext) AND NOT list_contains({listed(fixed.SKIP_FILES)}, string_split(path, '/')[-1])
  AND len(list_filter(string_split(path, '/')[:-2], lambda d: starts_with(d, '.') OR list_contains({listed(fixed.SKIP_DIRS)}, d))) = 0
""")
def file_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(F.array(*map(F.lit, FILES))).alias("i", "path"))
    size = F.when(F.col("i") == 9, 0).when(F.col("i") == 10, 512001).otherwise(100 + F.col("n_nationkey")).cast("long")
    listing = rows.select((F.col("n_nationkey") * len(FILES) + F.col("i")).cast("long").alias("seq"), "path", size.alias("size"))
    kept = listing.filter(files.wanted(F.col("path"), F.col("size")))
    return kept.withColumn("language", U.language_of_extension(files.extension(F.col("path"))))


# ---- display, rates, graphs ---------------------------------------------------------------------------------------
@query("""
SELECT o_orderkey, CASE WHEN b < 1024 THEN b::varchar || ' B' WHEN b < 1048576 THEN printf('%.1f', floor(b / 1024.0 * 10 + 0.5) / 10) || ' KB' WHEN b < 1073741824 THEN printf('%.1f', floor(b / 1048576.0 * 10 + 0.5) / 10) || ' MB' ELSE printf('%.2f', floor(b / 1073741824.0 * 100 + 0.5) / 100) || ' GB' END AS bytes_text,
  CASE WHEN b < 1000 THEN b::varchar || 'ms' WHEN b < 60000 THEN printf('%.1f', floor(b / 1000.0 * 10 + 0.5) / 10) || 's' ELSE (b // 60000)::varchar || 'm ' || (b % 60000 // 1000)::varchar || 's' END AS duration_text,
  repeat('━', floor(least(b / 2e8, 1.0) * 24 + 0.5)::int) || repeat('─', 24 - floor(least(b / 2e8, 1.0) * 24 + 0.5)::int) AS bar,
  (SELECT max(m) FROM unnest([10, 25, 50, 75, 100, 150, 200, 300, 500]) t(m) WHERE m <= o_orderkey)::bigint AS milestone
FROM (SELECT o_orderkey, (o_orderkey * o_orderkey * 37)::bigint AS b FROM orders)
""")
def format_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = (F.col("o_orderkey") * F.col("o_orderkey") * 37).cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.format_bytes(b).alias("bytes_text"), T.format_duration(b).alias("duration_text"), T.progress_bar(b, F.lit(2e8)).alias("bar"), T.milestone(F.col("o_orderkey")).alias("milestone"))


ERRORS = [*[f"error: {m}" for marks, _ in fixed.ERROR_MESSAGES for m in marks], "ENOENT: open 'a b.txt', 'c'", "ENOENT '' x", "else", "ETIMEDOUT at 429", None]
_TOLD = " ".join(f"WHEN {' OR '.join(f'contains(e, {listed([m])}[1])' for m in marks)} THEN {listed([told])}[1]" + (f" || coalesce(nullif(string_split(e, chr(39))[2], ''), '{fixed.UNKNOWN_FILE}')" if marks == ["ENOENT"] else "") for marks, told in fixed.ERROR_MESSAGES)


@query(f"""
SELECT o_orderkey, CASE {_TOLD} ELSE coalesce(e, '{fixed.UNKNOWN_ERROR}') END AS told,
  CASE WHEN s > 0 THEN printf('%.1f', floor(o_orderkey / s * 10 + 0.5) / 10) ELSE '0.0' END AS speed
FROM (SELECT o_orderkey, o_orderkey % 16 * 0.5 AS s, [{', '.join('NULL' if e is None else listed([e]) + '[1]' for e in ERRORS)}][o_orderkey % {len(ERRORS)} + 1] AS e FROM orders)
""")
def error_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.get(F.array(*map(F.lit, ERRORS)), (F.col("o_orderkey") % len(ERRORS)).cast("int"))
    speed = T.pages_per_second(F.col("o_orderkey"), F.col("o_orderkey") % 16 * 0.5)
    return table(spark, sf_dir, "orders").select("o_orderkey", T.explained_error(error).alias("told"), speed.alias("speed"))


@query("SELECT o_orderkey, CASE d WHEN 0 THEN 'today' WHEN 1 THEN 'yesterday' ELSE d::varchar || ' days ago' END AS last_used FROM (SELECT o_orderkey, floor((epoch(TIMESTAMP '1998-08-03 12:00:00') - epoch(o_orderdate)) / 86400)::bigint AS d FROM orders)")
def days_ago(spark: SparkSession, sf_dir: str) -> DataFrame:
    when = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.days_ago(when, F.lit("1998-08-03 12:00:00").cast("timestamp")).alias("last_used"))


@query("SELECT event_id, row_number() OVER (PARTITION BY date_trunc('second', ts) ORDER BY event_id) AS rank_in_second, row_number() OVER (PARTITION BY date_trunc('second', ts) ORDER BY event_id) <= 2 AS admitted FROM events")
def rate_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.rate_slots(table(spark, sf_dir, "events"), per_second=2).select("event_id", "rank_in_second", "admitted")


BFS_DEPTH = 3


@query(f"""
WITH RECURSIVE edges AS (SELECT DISTINCT l_partkey * 2 AS src, l_suppkey * 2 + 1 AS dst FROM lineitem UNION SELECT DISTINCT l_suppkey * 2 + 1, l_partkey * 2 FROM lineitem),
walk AS (SELECT 2::bigint AS node, 0 AS depth UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.node WHERE w.depth < {BFS_DEPTH})
SELECT node, min(depth) AS depth FROM walk GROUP BY 1
""")
def bfs_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers as pages that link to each other."""
    lines = table(spark, sf_dir, "lineitem")
    there = lines.select((F.col("l_partkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst")).distinct()
    edges = there.union(there.select("dst", "src"))
    return frontier.bfs(edges, spark.range(2, 3).select(F.col("id").alias("node")), BFS_DEPTH)


LINKS = 8  # 585 pages within three steps, more than max_pages


@query()
def crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A site whose pages link in a ring and across: pages of the table, rewritten to one host."""
    pages = table(spark, sf_dir, "pages")
    page = F.col("page_id")
    # one row to every task; a window over all rows would put the whole table into one
    numbered = pages.select("page_id", "html").crossJoin(F.broadcast(pages.agg(F.count(F.lit(1)).alias("n"))))
    link = lambda k: F.concat(F.lit('<a href="/p'), ((page * LINKS + k) % F.col("n")).cast("string"), F.lit('">next</a>'))
    html = F.concat(F.col("html"), *[link(k) for k in range(1, LINKS + 1)])
    site = numbered.select(F.concat(F.lit("https://site.example/p"), page.cast("string")).alias("url"), F.lit("fetch").alias("engine"), F.lit(0).alias("priority"), F.lit(200).alias("status_code"), html.alias("html"), F.lit(None).cast("string").alias("final_url"))
    seeds = spark.range(1).select(F.lit("https://site.example/p0").alias("url"), F.col("id").alias("seq"))
    return frontier.crawl(site, seeds, frontier.CrawlOptions(depth=3, max_pages=300)).select("seq", "url", "depth", "engine", "title", "word_count")


# ---- metadata: the pages have none, so each gets some by its number ----------------------------------------------
META = [
    (2, 0, '<meta name="description" content="about {n} &amp; more">'),
    (3, 0, '<meta property="og:description" content="graph {n}">'),
    (2, 1, '<meta name="author" content=" writer {n} ">'),
    (4, 0, '<meta property="article:published_time" content="2024-02-03T10:00:00+02:00">'),
    (5, 0, '<time datetime="2023-12-31">then</time>'),
]


@query("""
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'graph ' || page_id WHEN page_id % 2 = 0 THEN 'about ' || page_id || ' & more' ELSE '' END AS description,
       CASE WHEN page_id % 2 = 1 THEN 'writer ' || page_id END AS author,
       CASE WHEN page_id % 4 = 0 THEN '2024-02-03T08:00:00.000Z' WHEN page_id % 5 = 0 THEN '2023-12-31T00:00:00.000Z' END AS published_date
FROM pages
""")
def page_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    tags = [F.when(n % m == r, F.replace(F.lit(x), F.lit("{n}"), n.cast("string"))).otherwise(F.lit("")) for m, r, x in META]
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.concat(*tags, F.coalesce("html", F.lit(""))).alias("html"))
    return extract.extract_pages(pages, include_links=False).select("page_id", "description", "author", "published_date")


# ---- streams, run over what is there ----------------------------------------------------------------------------
def _arriving(spark: SparkSession, sf_dir: str, name: str, columns: list[str]) -> DataFrame:
    """A table as a stream of files. The path is a pattern, as a plain one would have to be a folder."""
    kind = table(spark, sf_dir, name).select(*columns).schema
    return spark.readStream.schema(kind).parquet(f"{sf_dir}/{name}.parque[t]")


def _finished(stream: DataFrame, name: str) -> DataFrame:
    """What a stream appends until all that is there is read."""
    spark, out = stream.sparkSession, shared_path(stream.sparkSession, name)
    running = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_path(spark, f"{name}_log")).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query(f"SELECT DISTINCT {s_norm('url')} AS norm_url FROM pages")
def stream_visited(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _arriving(spark, sf_dir, "pages", ["page_id", "url"])
    return _finished(streams.visited_once(pages).select("norm_url"), "stream_visited")


@query("""
SELECT strftime(h, '%Y-%m-%d %H:%M:%S') AS from_time, count(*) AS starts FROM (SELECT date_trunc('hour', ts) AS h FROM events)
WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 SECOND FROM events) GROUP BY 1
""")
def stream_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that the watermark has closed."""
    made = streams.rate_windows(_arriving(spark, sf_dir, "events", ["ts"]), "1 hour")
    return _finished(made.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("from_time"), "starts"), "stream_rates")
