"""URL functions as Column expressions: nothing leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelake.functions import fixed

_SPLIT = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#\\]*)([^?#]*)(\?[^#]*)?(#.*)?$"
_SPECIAL = {"http": "80", "https": "443", "ftp": "21", "ws": "80", "wss": "443"}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once and written once: nested URL functions would otherwise grow a plan exponentially."""
    return F.element_at(F.transform(F.array(value), body), 1)


def js_trim(x: Column) -> Column:
    return F.regexp_replace(x, f"^[{fixed.WHITE_SPACE}]+|[{fixed.WHITE_SPACE}]+$", "")


def _without_dots(path: Column) -> Column:
    """Dot segments resolved; a trailing one leaves a slash."""
    parts = F.split(path, "/")
    stack = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda a, p: F.when(p.isin(".", "%2e", "%2E"), a)
        .when(p.isin("..", ".%2e", "%2e.", "%2e%2e", ".%2E", "%2E.", "%2E%2E"), F.when(F.size(a) > 1, F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a))
        .otherwise(F.concat(a, F.array(p))),
    )
    ends = F.element_at(parts, -1).isin(".", "..")
    joined = F.concat(F.array_join(stack, "/"), F.when(ends, F.lit("/")).otherwise(F.lit("")))
    return F.when(path.rlike(r"(?i)(^|/)(\.|%2e){1,2}(/|$)"), joined).otherwise(path)


def _encode(text: Column, unsafe: str) -> Column:
    """Percent-encode what is outside ASCII, and unsafe."""
    encoded = F.array_join(F.transform(F.split(text, ""), lambda c: F.when(c.rlike(f"^[^\\x21-\\x7e]$|^[{unsafe}]$"), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c)), "")
    return F.when(text.rlike(f"[^\\x21-\\x7e]|[{unsafe}]"), encoded).otherwise(text)


def url_parts(url: Column) -> Column:
    """struct<scheme, host, port, path, query, fragment, origin>, or null where the URL can't be parsed.

    query and fragment keep their ? and #, and are empty without them or if there is nothing behind.
    """
    return let(F.regexp_replace(js_trim(url), r"[\t\n\r]", ""), _parts)


def _parts(u: Column) -> Column:
    g = lambda i: F.regexp_extract(u, _SPLIT, i)
    raw = F.struct(F.lower(g(1)).alias("scheme"), F.regexp_replace(g(2), r"^.*@", "").alias("authority"), g(3).alias("path"), g(4).alias("query"), g(5).alias("fragment"))

    def ports(r: Column) -> Column:
        default = reduce(lambda w, s: w.when(r["scheme"] == s, F.lit(_SPECIAL[s])), list(_SPECIAL)[1:], F.when(r["scheme"] == "http", F.lit("80")))
        port = F.regexp_extract(r["authority"], r":0*(\d*)$", 1)
        return F.struct(r.alias("r"), F.lower(F.regexp_replace(r["authority"], r":\d*$", "")).alias("host"), F.when(port == F.coalesce(default, F.lit("")), F.lit("")).otherwise(port).alias("port"))

    def whole(x: Column) -> Column:
        r, host, port = x["r"], x["host"], x["port"]
        path = F.when(r["path"] == "", F.lit("/")).otherwise(let(F.translate(r["path"], "\\", "/"), lambda p: let(_without_dots(p), lambda q: _encode(q, '"<>`{}'))))
        query = F.when(r["query"] == "?", F.lit("")).otherwise(_encode(r["query"], "\"<>'"))
        fragment = F.when(r["fragment"] == "#", F.lit("")).otherwise(_encode(r["fragment"], '"<>`'))
        origin = F.concat(r["scheme"], F.lit("://"), host, F.when(port == "", F.lit("")).otherwise(F.concat(F.lit(":"), port)))
        fine = r["scheme"].isin(*_SPECIAL) & (host != "") & ~host.rlike(r"[\s<>\\^|%`{}@]")
        return F.when(fine, F.struct(r["scheme"].alias("scheme"), host.alias("host"), port.alias("port"), path.alias("path"), query.alias("query"), fragment.alias("fragment"), origin.alias("origin")))

    return F.when(u.rlike(_SPLIT), let(let(raw, ports), whole))


def _with_scheme(url: Column) -> Column:
    return F.when(url.startswith("http"), url).otherwise(F.concat(F.lit("https://"), url))


def _form_pairs(query: Column) -> Column:
    """name=value strings of a query, serialised anew as a form."""
    decode = lambda x: F.coalesce(F.try_url_decode(x), x)
    pair = lambda p: F.concat(F.url_encode(decode(F.substring_index(p, "=", 1))), F.lit("="), F.url_encode(decode(F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, r"^[^=]*=", "")).otherwise(F.lit("")))))
    return F.transform(F.filter(F.split(F.substr(query, F.lit(2)), "&"), lambda p: p != ""), pair)


def without_params(query: Column, names: list[str]) -> Column:
    """The query without parameters of these names; as form-serialising leaves it if there is a query."""
    kept = F.filter(_form_pairs(query), lambda p: ~F.substring_index(p, "=", 1).isin(*names))
    return F.when(query == "", F.lit("")).otherwise(let(kept, lambda k: F.when(F.size(k) == 0, F.lit("")).otherwise(F.concat(F.lit("?"), F.array_join(k, "&")))))


def normalize_url(url: Column) -> Column:
    def rebuilt(p: Column) -> Column:
        path = F.when(p["path"] == "/", F.lit("/")).otherwise(F.regexp_replace(p["path"], "/$", ""))
        return F.concat(p["origin"], path, without_params(p["query"], fixed.TRACKING_PARAMS))

    return F.coalesce(let(url_parts(_with_scheme(url)), rebuilt), url)


def base_domain(url: Column) -> Column:
    return F.coalesce(F.regexp_replace(url_parts(_with_scheme(url))["host"], r"^www\.", ""), url)


def same_domain(a: Column, b: Column) -> Column:
    return base_domain(a) == base_domain(b)


def extract_domain(url: Column) -> Column:
    return F.coalesce(url_parts(url)["host"], url)


def should_skip_url(url: Column) -> Column:
    endings = "|".join(e[1:] for e in fixed.SKIP_EXTENSIONS)
    return F.coalesce(F.lower(url_parts(url)["path"]).rlike(rf"\.({endings})$"), F.lit(True))


def resolve_url(href: Column, base: Column) -> Column:
    """Against the origin of the base, whatever its path."""
    dead = href.startswith("#") | href.startswith("mailto:") | href.startswith("javascript:") | href.startswith("tel:")
    return F.when(~dead, let(url_parts(base), lambda p: resolve_against(href, p["origin"], p["scheme"])))


def resolve_against(href: Column, origin: Column, scheme: Column) -> Column:
    def absolute(h: Column) -> Column:
        return (
            F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), h)
            .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
            .when(h.startswith("/") | h.startswith("?"), F.concat(origin, h))
            .when(h == "", origin)
            .otherwise(F.concat(origin, F.lit("/"), h))
        )

    return F.when(origin.isNotNull(), let(url_parts(let(js_trim(href), absolute)), lambda p: F.concat(p["origin"], p["path"], p["query"], p["fragment"])))


def is_specific_page(url: Column) -> Column:
    return F.coalesce(let(url_parts(_with_scheme(url))["path"], lambda path: ~path.isin("", "/") & ~path.rlike(fixed.INDEX_PAGE)), F.lit(False))


def is_git_url(url: Column) -> Column:
    starts = ["https://github.com/", "https://gitlab.com/", "https://bitbucket.org/", "git@github.com:", "git@gitlab.com:"]
    return reduce(lambda a, s: a | url.startswith(s), starts[1:], url.startswith(starts[0])) | url.endswith(".git")


def repo_name(url: Column) -> Column:
    named = F.regexp_extract(url, r"/([^/]+?)(\.git)?$", 1)
    last = F.element_at(F.split(url, "/"), -1)
    return F.when(named != "", named).when(last != "", last).otherwise(F.lit("repo"))


def output_dir_name(path: Column) -> Column:
    last = F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)
    return F.when(last == "", F.lit("output")).otherwise(last)


def needs_browser(url: Column) -> Column:
    host = F.regexp_replace(url_parts(url)["host"], r"^(.*?)www\.", "$1")
    hosts = "|".join(h.replace(".", r"\.") for h in fixed.PROTECTED_HOSTS)
    return F.coalesce(host.rlike(rf"(^|\.)({hosts})$"), F.lit(False))


def truncate_url(url: Column, most: int = 60) -> Column:
    def short(p: Column) -> Column:
        room = F.lit(most) - F.length(p["host"]) - 5
        tail = F.concat(p["host"], F.lit("/..."), F.right(p["path"], F.greatest(room, F.lit(0))))
        return F.when(room > 10, tail).otherwise(F.concat(F.left(url, F.lit(most - 3)), F.lit("...")))

    return F.when(F.length(url) <= most, url).otherwise(let(url_parts(url), short))


def language_of_extension(ext: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in fixed.LANGUAGE_OF_EXTENSION.items() for x in kv])
    return F.coalesce(table[ext], F.nullif(F.substr(ext, F.lit(2)), F.lit("")), F.lit("text"))


def session_filename(domain: Column) -> Column:
    return F.concat(F.regexp_replace(domain, r"(?i)[^a-z0-9.\-]", "_"), F.lit(".json"))


def locale_info(url: Column) -> Column:
    """struct<has_locale, locale, language, country, canonical_path>."""
    nothing = F.struct(F.lit(False).alias("has_locale"), *[F.lit(None).cast("string").alias(n) for n in ("locale", "language", "country")], url.alias("canonical_path"))
    return F.coalesce(let(let(url_parts(url), _locale_candidates), _locale), nothing)


def _locale_candidates(p: Column) -> Column:
    path, query = p["path"], p["query"]
    at_start, inside = r"(?i)^/([a-z]{2})([-_]([a-z]{2}))?(?=/|$)", r"(?i)/([a-z]{2})([-_]([a-z]{2}))?(?=/)"
    value = lambda n: let(F.regexp_extract(query, rf"[?&]{n}=([^&]*)", 1), lambda v: F.nullif(F.coalesce(F.try_url_decode(v), v), F.lit("")))
    halves = F.split(F.lower(F.coalesce(*[value(n) for n in fixed.LOCALE_PARAMS])), "[-_]")
    found = {"a": F.regexp_extract(path, at_start, 1), "b": F.regexp_extract(path, at_start, 3), "c": F.regexp_extract(path, inside, 1), "d": F.regexp_extract(path, inside, 3)}
    return F.when(p.isNotNull(), F.struct(path.alias("path"), query.alias("query"), *[F.lower(x).alias(n) for n, x in found.items()], halves.alias("halves")))


def _locale(x: Column) -> Column:
    is_lang, is_country = lambda c: c.isin(*fixed.LANGUAGES), lambda c: c.isin(*fixed.COUNTRIES)
    a, b, c, d, e, f = x["a"], x["b"], x["c"], x["d"], F.get(x["halves"], F.lit(0)), F.get(x["halves"], F.lit(1))
    start = is_lang(a) | is_country(a)
    start_two = is_country(b) | is_lang(b)
    mid = ~start & (is_lang(c) | is_country(c)) & ~c.isin(*fixed.NOT_LOCALES)  # inside the path only the first candidate counts
    asked = ~start & ~mid & F.coalesce(is_lang(e), F.lit(False))
    asked_two = F.coalesce(is_country(f), F.lit(False))
    pair = lambda u, v: F.concat(u, F.lit("-"), v)
    locale = F.when(start, F.when(start_two, pair(a, b)).otherwise(a)).when(mid, F.when(is_country(d), pair(c, d)).otherwise(c)).when(asked, F.when(asked_two, pair(e, f)).otherwise(e))
    language = F.when(start & is_lang(a), a).when(mid & is_lang(c), c).when(asked, e)
    country = F.when(start, F.when(start_two, b).when(~is_lang(a), a)).when(mid, F.when(is_country(d), d).when(~is_lang(c), c)).when(asked & asked_two, f)
    stripped = F.regexp_replace(x["path"], r"(?i)^/[a-z]{2}([-_][a-z]{2})?(?=/|$)", "")
    without = F.regexp_replace(x["path"], r"(?is)^(.*?)/[a-z]{2}([-_][a-z]{2})?(?=/)(.*)$", "$1$3")
    path = F.when(start, F.coalesce(F.nullif(stripped, F.lit("")), F.lit("/"))).when(mid, without).otherwise(x["path"])
    canonical = F.concat(path, without_params(x["query"], fixed.LOCALE_PARAMS))
    return F.when(x.isNotNull(), F.struct(locale.isNotNull().alias("has_locale"), locale.alias("locale"), language.alias("language"), country.alias("country"), canonical.alias("canonical_path")))
