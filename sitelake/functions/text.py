"""Text and display functions as Column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelake.functions import fixed
from sitelake.functions.urls import js_trim

WS = f"[{fixed.WHITE_SPACE}]"
OTHER_SPACE = fixed.WHITE_SPACE.replace(" ", "")  # but for the space


def word_count(x: Column) -> Column:
    return F.size(F.filter(F.split(x, f"{WS}+"), lambda w: w != "")).cast("long")


def byte_size(x: Column) -> Column:
    return F.octet_length(x).cast("long")


def utf16_length(x: Column) -> Column:
    """Length in UTF-16 code units."""
    return F.length(x) + F.length(F.regexp_replace(x, r"[^\x{10000}-\x{10FFFF}]", ""))


def truncate_marked(x: Column, most: int = 500_000) -> Column:
    return F.when(F.length(x) > most, F.concat(F.left(x, F.lit(most)), F.lit(fixed.TRUNCATED))).otherwise(x)


def fingerprint(x: Column) -> Column:
    # a run that is one space stays as it is, so few places are replaced; after that, spaces are the only white space
    spaced = F.regexp_replace(F.lower(x), f"(?: {WS}|[{OTHER_SPACE}]){WS}*", " ")
    plain = F.trim(F.regexp_replace(spaced, r"[^\w ]+", ""))
    n = F.length(plain)
    half = F.floor(n / 2).cast("int")
    parts = F.concat_ws("|", F.left(plain, F.lit(300)), F.substr(plain, half - 149, F.lit(300)), F.right(plain, F.lit(300)))
    return F.when(n < 500, plain).otherwise(parts)


def long_words(x: Column) -> Column:
    """Distinct words of more than three characters."""
    return F.array_distinct(F.filter(F.split(x, f"{WS}+"), lambda w: F.length(w) > 3))


def similarity(a: Column, b: Column) -> Column:
    x, y = long_words(a), long_words(b)
    both = F.size(F.array_intersect(x, y))
    jaccard = both / (F.size(x) + F.size(y) - both)
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == "") | (F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(jaccard)


# What plain text drops from markdown, in order.
PLAIN_STEPS = [
    (r"(?s)```.*?```", ""),
    (r"`[^`]+`", ""),
    (r"!\[([^\]]*)\]\([^)]+\)", "$1"),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (rf"(?m)^#{{1,6}}{WS}+", ""),
    (r"\*\*([^*]+)\*\*", "$1"),
    (r"\*([^*]+)\*", "$1"),
    (r"__([^_]+)__", "$1"),
    (r"_([^_]+)_", "$1"),
    (rf"(?m)^>{WS}*", ""),
    (r"(?m)^---$", ""),
    (rf"(?m)^[-*+]{WS}+", ""),
    (rf"(?m)^[0-9]+\.{WS}+", ""),
    (rf"{WS}+", " "),
]


def plain_text(markdown: Column) -> Column:
    return js_trim(reduce(lambda x, s: F.regexp_replace(x, s[0], s[1]), PLAIN_STEPS, markdown))


def strip_tags(html: Column) -> Column:
    """The fallback of the conversion: no tags, code blocks as fences."""
    pre = r"(?is)<pre[^>]*>.*?</pre>"
    blocks = F.regexp_extract_all(html, F.lit(f"({pre})"), F.lit(1))
    outside = js_trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(html, pre, "\x02"), "<[^>]+>", " "), f"{WS}+", " "))
    code = lambda b: reduce(
        lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])),
        [("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"')],
        F.regexp_extract(b, r"(?is)<pre[^>]*>(?:<code[^>]*>)?(.*?)(?:</code>)?</pre>", 1),
    )
    fenced = F.transform(blocks, lambda b: F.concat(F.lit("\n\n```\n"), js_trim(code(b)), F.lit("\n```\n\n")))
    pieces = F.split(outside, "\x02")
    return F.array_join(F.zip_with(pieces, fenced, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")


def infer_language(code: Column) -> Column:
    """Of a code block that names none; never unknown."""
    has = lambda xs: reduce(lambda a, x: a | F.contains(code, F.lit(x)), xs[1:], F.contains(code, F.lit(xs[0])))
    trimmed = js_trim(code)
    json = (trimmed.startswith("{") | trimmed.startswith("[")) & trimmed.rlike(r"(?s)[}\]]$") & F.try_parse_json(trimmed).isNotNull()
    tests = [(language, reduce(lambda a, x: a & x, map(has, [*all_of, any_of]))) for language, all_of, any_of in fixed.CODE_MARKS]
    return F.coalesce(*[F.when(test & json if language == "json" else test, language) for language, test in tests], F.lit(fixed.CODE_DEFAULT))


def title_of(sources: list[Column], url: Column, path: Column) -> Column:
    """The first source with something before its site name; else the last part of the path; else the URL."""
    cut = lambda s: F.nullif(js_trim(F.get(F.split(s, rf"{WS}*[|\-–—]{WS}*", 2), F.lit(0))), F.lit(""))
    last = F.element_at(F.split(F.regexp_replace(path, "/$", ""), "/"), -1)
    named = F.nullif(F.regexp_replace(F.translate(last, "-_", "  "), r"\.[A-Za-z0-9_]+$", ""), F.lit(""))
    return F.coalesce(*[cut(s) for s in sources], F.when(path != "/", named), url)


def first_filled(sources: list[Column], most: int, trimmed: bool, default: str | None = None) -> Column:
    kept = [F.when(js_trim(s) != "", F.left(js_trim(s) if trimmed else s, F.lit(most))) for s in sources]
    return F.coalesce(*kept, F.lit(default).cast("string"))


DATE_FORMATS = ["yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd", "yyyy/MM/dd", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy HH:mm:ss z"]


def parse_date(x: Column) -> Column:
    trimmed = F.regexp_replace(js_trim(x), r"^[A-Z][a-z]{2}, ", "")
    return F.coalesce(F.try_to_timestamp(trimmed), *[F.try_to_timestamp(trimmed, F.lit(f)) for f in DATE_FORMATS])


def iso_date(sources: list[Column]) -> Column:
    """The first source that is a date, as ISO in UTC with milliseconds (the session is in UTC)."""
    return F.coalesce(*[F.date_format(parse_date(s), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") for s in sources])


def format_bytes(n: Column) -> Column:
    k = 1024.0
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024**2, F.concat(F.format_string("%.1f", n / k), F.lit(" KB")))
        .when(n < 1024**3, F.concat(F.format_string("%.1f", n / k**2), F.lit(" MB")))
        .otherwise(F.concat(F.format_string("%.2f", n / k**3), F.lit(" GB")))
    )


def format_duration(ms: Column) -> Column:
    minutes = F.concat(F.floor(ms / 60000).cast("string"), F.lit("m "), F.floor(ms % 60000 / 1000).cast("string"), F.lit("s"))
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).when(ms < 60000, F.concat(F.format_string("%.1f", ms / 1000.0), F.lit("s"))).otherwise(minutes)


def progress_bar(current: Column, total: Column, width: int = 24) -> Column:
    filled = F.floor(F.least(current / total, F.lit(1.0)) * width + 0.5).cast("int")
    return F.concat(F.repeat(F.lit("━"), filled), F.repeat(F.lit("─"), F.lit(width) - filled))


def size_estimate(domain: Column, pages: Column) -> Column:
    each = F.when(F.contains(domain, F.lit("cnn")) | F.contains(domain, F.lit("news")), 300).otherwise(100)
    mb = pages * each / 1024.0
    return F.concat(F.format_string("%.0f", F.floor(mb + 0.5).cast("double")), F.lit("MB "), F.when(mb < 50, F.lit("(fits in free tier)")).otherwise(F.lit("(needs API key for full crawl)")))


def days_ago(then: Column, now: Column) -> Column:
    days = F.floor((F.unix_timestamp(now) - F.unix_timestamp(then)) / 86400).cast("long")
    return F.when(days == 0, "today").when(days == 1, "yesterday").otherwise(F.concat(days.cast("string"), F.lit(" days ago")))


def short_label(x: Column) -> Column:
    return F.when(F.length(x) > 50, F.concat(F.left(x, F.lit(47)), F.lit("..."))).otherwise(x)


def explained_error(message: Column) -> Column:
    """What a user is told for an error message; a file that is missing is named if the message quotes one."""
    named = F.nullif(F.get(F.split(message, "'"), F.lit(1)), F.lit(""))
    out = F.coalesce(message, F.lit(fixed.UNKNOWN_ERROR))
    for marks, told in reversed(fixed.ERROR_MESSAGES):
        held = reduce(or_, [F.contains(message, F.lit(m)) for m in marks])
        out = F.when(held, F.concat(F.lit(told), F.coalesce(named, F.lit(fixed.UNKNOWN_FILE))) if marks == ["ENOENT"] else F.lit(told)).otherwise(out)
    return out


def pages_per_second(pages: Column, seconds: Column) -> Column:
    """With one decimal; 0.0 where no time has passed."""
    return F.when(seconds > 0, F.format_string("%.1f", pages / seconds)).otherwise("0.0")


def milestone(count: Column) -> Column:
    """The last milestone that is reached, or null."""
    return F.array_max(F.filter(F.array(*map(F.lit, fixed.MILESTONES)), lambda m: m <= count)).cast("long")
