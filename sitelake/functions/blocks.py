"""Block pages: one CASE over pattern counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelake.functions import fixed


def _hits(html: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, p: a + p, [html.rlike(p).cast("int") for p in patterns])


def block_check(html: Column, status: Column) -> Column:
    """struct<blocked, reason, confidence>; the first rule that holds decides. Null html is empty."""
    h = F.coalesce(html, F.lit(""))
    n = F.length(h)
    has = lambda x: F.contains(h, F.lit(x))
    needs_script = has("noscript") & (has("enable javascript") | has("JavaScript is required")) & ~has("<article") & ~has("<main")
    rules = [
        (status == 403, "forbidden", 0.9),
        (status == 429, "rate_limit", 0.95),
        ((status == 503) & (_hits(h, fixed.CLOUDFLARE) >= 1), "cloudflare", 0.95),
        ((n < 500) & (has("challenge") | has("captcha")), "empty_body", 0.7),
        (_hits(h, fixed.CLOUDFLARE) >= 2, "cloudflare", 0.9),
        ((n < 50000) & (_hits(h, fixed.DATADOME) >= 2), "datadome", 0.9),
        ((n < 50000) & (_hits(h, fixed.PERIMETERX) >= 1), "access_denied", 0.85),
        ((n < 50000) & (_hits(h, fixed.AKAMAI) >= 2), "access_denied", 0.8),
        ((n < 10000) & (_hits(h, fixed.CAPTCHA) >= 2), "captcha", 0.85),
        ((n < 3000) & (_hits(h, fixed.GENERIC_BLOCK) >= 1), "access_denied", 0.7),
        ((n < 5000) & needs_script, "javascript_required", 0.6),
    ]
    made = lambda r, c: F.struct(F.lit(r is not None).alias("blocked"), F.lit(r).cast("string").alias("reason"), F.lit(c).alias("confidence"))
    (first, reason, confidence), *rest = rules
    case = F.when(first, made(reason, confidence))
    for condition, reason, confidence in rest:
        case = case.when(condition, made(reason, confidence))
    return case.otherwise(made(None, 0.0))
