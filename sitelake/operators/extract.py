"""Pages to documents: one pass over the DOM in an Arrow batch, everything else as Column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelake.functions import dom, markdown
from sitelake.functions import text as T
from sitelake.functions import urls as U
from sitelake.runtime import ship

MOST = 500_000
_META = pa.list_(pa.string())
_RAW = pa.struct([("titles", _META), ("descriptions", _META), ("authors", _META), ("dates", _META), ("hrefs", pa.list_(pa.struct([("href", pa.string()), ("text", pa.string())]))), ("markdown", pa.string())])
_RAW_SQL = "struct<titles:array<string>,descriptions:array<string>,authors:array<string>,dates:array<string>,hrefs:array<struct<href:string,text:string>>,markdown:string>"


def _content(root: dom.Node) -> str:
    """The ladder: densest container and its references, main content, body, whole tree."""
    best = dom.densest(root)
    if best is not None:
        made, refs = markdown.node_to_markdown(best), dom.references(root)
        extra = markdown.node_to_markdown(refs) if refs is not None else ""
        return f"{made}\n\n{extra}" if extra.strip() else made
    found = dom.main_content(root) or dom.first(root, "tag", "body")
    return markdown.node_to_markdown(found if found is not None else root)


def raw_fields(html: str | None, with_links: bool = True) -> dict:
    """What a page holds, before any rule is applied to it."""
    root = dom.parse(html)
    meta: dict[tuple[str, str], str] = {}
    for n in root.elements():
        if n.tag == "meta" and "content" in n.attrs:
            for k in ("property", "name"):
                if k in n.attrs:
                    meta.setdefault((k, n.attrs[k]), n.attrs["content"])
    all_ = list(root.elements())
    attr = lambda name, test: next((n.attrs.get(name) for n in all_ if test(n)), None)
    text = lambda kind, value: (lambda n: n.text() if n is not None else None)(dom.first(root, kind, value))
    published = lambda n: n.attrs.get("itemprop") == "datePublished"
    out = {
        "titles": [meta.get(("property", "og:title")), meta.get(("name", "twitter:title")), "".join(n.text() for n in all_ if n.tag == "title"), text("tag", "h1")],
        "descriptions": [meta.get(("property", "og:description")), meta.get(("name", "description")), meta.get(("name", "twitter:description"))],
        "authors": [meta.get(("name", "author")), meta.get(("property", "article:author")), text("rel", "author"), text("itemprop", "author"), text("class", "author"), text("class*", "author-name")],
        "dates": [meta.get(("property", "article:published_time")), meta.get(("name", "date")), meta.get(("name", "publish-date")), attr("datetime", lambda n: n.tag == "time" and "datetime" in n.attrs), attr("content", published), attr("datetime", published)],
        "hrefs": [{"href": n.attrs["href"], "text": n.text().strip()[:100]} for n in all_ if n.tag == "a" and n.attrs.get("href")] if with_links else [],
    }
    dom.preserve_code(root)
    dom.clean(root)
    out["markdown"] = _content(root)
    return out


_NOTHING = {"titles": [None] * 4, "descriptions": [None] * 3, "authors": [None] * 6, "dates": [None] * 6, "hrefs": [], "markdown": None}


def _parsed(pages: DataFrame, html_col: str, with_links: bool) -> DataFrame:
    """pages but html_col, with the struct __raw. A page that can't be parsed has markdown by taking its tags out, and nothing else."""
    ship(pages.sparkSession)
    others = [c for c in pages.columns if c != html_col]
    given = pages.select(pages[html_col].alias("html"), F.struct(F.lit(0).alias("none"), *[pages[c].alias(f"c{i}") for i, c in enumerate(others)]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part, made, failed = batch.slice(k, 64), [], []
                for x in part.column(0):
                    html, lost = x.as_py(), None
                    try:
                        made.append(raw_fields(html, with_links))
                    except Exception:  # noqa: BLE001  one page must not end the job; its text is kept below
                        made.append(_NOTHING)
                        lost = html
                    failed.append(lost)
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(made, _RAW), pa.array(failed, pa.string())], ["row", "raw", "failed"])

    made = given.mapInArrow(run, f"row {given.schema['row'].dataType.simpleString()}, raw {_RAW_SQL}, failed string")
    raw = F.col("raw").withField("markdown", F.coalesce("raw.markdown", T.strip_tags(F.col("failed")), F.lit("")))
    return made.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(others)], raw.alias("__raw"))


def page_links(hrefs: Column, url: Column) -> Column:
    """Resolved links of pages, each once, in order. hrefs: array<string>."""
    resolved = F.transform(hrefs, lambda h: U.resolve_url(h, url))
    return F.array_distinct(F.filter(resolved, lambda r: r.isNotNull() & ~U.should_skip_url(r)))


def first_of_each(links: Column) -> Column:
    """The first struct of each href. links: array<struct<href, text>>."""
    return U.let(links, lambda xs: F.transform(F.array_distinct(F.transform(xs, lambda x: x["href"])), lambda h: F.element_at(F.filter(xs, lambda x: x["href"] == h), 1)))


def links_with_meta(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The page columns but html, and pos, href, text, is_internal: a row per different link."""
    parsed = _parsed(pages, html_col, True)
    links = F.transform(F.col("__raw.hrefs"), lambda h: F.struct(U.resolve_url(h["href"], F.col(url_col)).alias("href"), h["text"].alias("text")))
    kept = F.filter(links, lambda x: x["href"].isNotNull() & ~U.should_skip_url(x["href"]))
    others = [c for c in pages.columns if c != html_col]
    rows = parsed.select(*others, F.posexplode(first_of_each(kept)).alias("pos", "link"))
    internal = U.url_parts(F.col("link.href"))["host"].eqNullSafe(U.url_parts(F.col(url_col))["host"])
    return rows.select(*others, F.col("pos").cast("long").alias("pos"), F.col("link.href").alias("href"), F.col("link.text").alias("text"), internal.alias("is_internal"))


def extract_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html", include_links: bool = True, max_content_length: int = MOST) -> DataFrame:
    """The page columns but html, and title, markdown, description, author, published_date, links, word_count, byte_size."""
    parsed = _parsed(pages, html_col, include_links)
    raw, url = F.col("__raw"), F.col(url_col)
    each = lambda name, n: [F.get(raw[name], F.lit(i)) for i in range(n)]
    made = parsed.select(
        *[c for c in pages.columns if c != html_col],
        T.title_of(each("titles", 4), url, U.url_parts(url)["path"]).alias("title"),
        (T.truncate_marked(raw["markdown"], max_content_length) if max_content_length else raw["markdown"]).alias("markdown"),
        T.first_filled(each("descriptions", 3), 300, False, "").alias("description"),
        T.first_filled(each("authors", 6), 100, True).alias("author"),
        T.iso_date(each("dates", 6)).alias("published_date"),
        page_links(F.transform(raw["hrefs"], lambda h: h["href"]), url).alias("links"),
    )
    return made.withColumns({"word_count": T.word_count(F.col("markdown")), "byte_size": T.byte_size(F.col("markdown"))})


def links_by_pattern(html: Column, url: Column) -> Column:
    """links as page_links gives them, found by a pattern in the JVM (no DOM): a[href] with quoted values."""
    hrefs = F.regexp_extract_all(html, F.lit(r"<a\s(?:[^>]*?\s)?href=[\"']([^\"']+)[\"']"), F.lit(1))
    return page_links(hrefs, url)
