"""Cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from sitelake.functions import blocks as B
from sitelake.functions import text as T
from sitelake.functions import urls as U


def apply(spark, f, values):
    rows = [v if isinstance(v, tuple) else (v,) for v in values]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"c{k} string" for k in range(len(rows[0]))))
    return [r[0] for r in df.orderBy("i").select(f(*[F.col(c) for c in df.columns[1:]])).collect()]


CASES = {
    "normalize_url": (
        U.normalize_url,
        {
            "http://ththre.example.com/fr/825?page=2&ref=x": "http://ththre.example.com/fr/825?page=2",
            "https://m.ththth.example.net/en/25#top": "https://m.ththth.example.net/en/25",
            "https://ththin.example.com/en/671?utm_source=feed": "https://ththin.example.com/en/671",
            "https://blog.tionsh.example.net/es/533/": "https://blog.tionsh.example.net/es/533",
            "example.com": "https://example.com/",
            "https://user:p@x.com:443/a/": "https://x.com/a",
            "https://x.com/a//": "https://x.com/a/",
            "httpbin.org/get": "httpbin.org/get",
            "https://x.com/?a": "https://x.com/?a=",
            None: None,
        },
    ),
    "resolve_url": (
        lambda h: U.resolve_url(h, F.lit("https://x.com/a/b/c")),
        {"foo": "https://x.com/foo", "../z": "https://x.com/z", "/q?r=1#h": "https://x.com/q?r=1#h", "//y.com/p": "https://y.com/p", "?p=2": "https://x.com/?p=2", "/für": "https://x.com/f%C3%BCr", "#t": None, "mailto:a@b": None, "tel:1": None, "javascript:x": None},
    ),
    "should_skip_url": (U.should_skip_url, {"https://x.com/a.PDF?x=1": True, "https://x.com/a.html": False, "https://x.com/d.json": True, "not a url": True}),
    "locale": (
        lambda u: F.struct(*[F.coalesce(U.locale_info(u)[n], F.lit("-")) for n in ("locale", "language", "country", "canonical_path")]),
        {
            "https://x.com/en-us/docs": ("en-us", "en", "us", "/docs"),
            "https://x.com/zh_CN/a": ("zh-cn", "zh", "cn", "/a"),
            "https://x.com/de-de/": ("de-de", "de", "de", "/"),
            "https://x.com/en-zz/a": ("en", "en", "-", "/a"),
            "https://x.com/jp/pricing": ("jp", "-", "jp", "/pricing"),
            "https://x.com/it/guide": ("it", "it", "-", "/guide"),
            "https://x.com/docs/es/guide": ("es", "es", "-", "/docs/guide"),
            "https://x.com/docs/it/guide": ("-", "-", "-", "/docs/it/guide"),
            "https://x.com/docs/es": ("-", "-", "-", "/docs/es"),
            "https://x.com/a?lang=pt-BR&x=1": ("pt-br", "pt", "br", "/a?x=1"),
            "https://en.x.com/a": ("-", "-", "-", "/a"),
            "nonsense": ("-", "-", "-", "nonsense"),
        },
    ),
    "fingerprint": (T.fingerprint, {"Hello,  World!": "hello world", "a - b": "a  b", "\u00a0a \n\tb\u3000c\n": "a b c", " - a_1  -": "a_1", "x" * 4 + "\n": "xxxx", "Été chaud": "t chaud", "": ""}),
    "similarity": (T.similarity, {("alpha beta gamma", "alpha beta delta"): 0.5, ("a", "a"): 1.0, ("the cat", "the dog"): 0.0, ("", "x"): 0.0}),
    "language": (T.infer_language, {"import React from 'react'": "jsx", "const x: number = 1": "typescript", "x => 1": "javascript", '{"a": 1}': "json", "npm install x": "bash", "SELECT 1": "javascript"}),
    "title": (lambda t: T.title_of([t], F.lit("https://x.com/docs/my-page.html"), F.lit("/docs/my-page.html")), {"My Page | Site": "My Page", "e-commerce guide": "e", "- foo": "my page", None: "my page"}),
    "date": (lambda d: T.iso_date([d]), {"2024-03-07": "2024-03-07T00:00:00.000Z", "March 7, 2024": "2024-03-07T00:00:00.000Z", "2024-03-07T10:00:00+02:00": "2024-03-07T08:00:00.000Z", "nope": None, "Thu, 07 Mar 2024 10:00:00 GMT": "2024-03-07T10:00:00.000Z"}),
    "plain": (T.plain_text, {"# T\n\n- a **b** `c` [l](u) ![i](s)\n1. x\n> q\n---\n```\ncode\n```\nend": "T a b l i x q end"}),
    "strip": (T.strip_tags, {"<p>a <b>b</b></p><pre><code>x &lt; y</code></pre> t": "a b \n\n```\nx < y\n```\n\n t", "no <br> code": "no code"}),
    "repo": (U.repo_name, {"https://github.com/a/b.git": "b", "https://gitlab.com/g/p": "p", "https://x.org/r/": "repo"}),
    "browser": (U.needs_browser, {"https://www.linkedin.com/in": True, "https://m.x.com/": True, "https://notx.com/": False, "x": False}),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_cases(spark, name):
    f, cases = CASES[name]
    got = [tuple(g) if isinstance(w, tuple) else g for g, w in zip(apply(spark, f, list(cases)), cases.values())]
    assert dict(zip(cases, got)) == cases


def test_blocks(spark):
    rows = [(403, "any", "forbidden", 0.9), (200, "", None, 0.0), (200, None, None, 0.0), (200, "captcha here", "empty_body", 0.7), (503, "cloudflare", "cloudflare", 0.95), (200, "Just a moment... cloudflare", "cloudflare", 0.9), (200, "y" * 600 + "recaptcha", "captcha", 0.85), (200, "Access Denied", "access_denied", 0.7), (200, "x" * 3000 + "forbidden", None, 0.0), (429, "", "rate_limit", 0.95)]
    df = spark.createDataFrame([(i, s, h) for i, (s, h, *_) in enumerate(rows)], "i int, s int, h string")
    got = [r[0] for r in df.orderBy("i").select(B.block_check(F.col("h"), F.col("s"))).collect()]
    assert [(g.blocked, g.reason, g.confidence) for g in got] == [(r is not None, r, c) for _, _, r, c in rows]


def test_display(spark):
    df = spark.createDataFrame([(1023,), (1536,), (999,), (1500,), (61500,)], "n long")
    got = [(r[0], r[1]) for r in df.select(T.format_bytes(F.col("n")), T.format_duration(F.col("n"))).collect()]
    assert got[0][0] == "1023 B" and got[1][0] == "1.5 KB" and [g[1] for g in got[2:]] == ["999ms", "1.5s", "1m 1s"]
    pages = spark.createDataFrame([(100,), (600,)], "n long")
    assert [r[0] for r in pages.select(T.size_estimate(F.lit("docs"), F.col("n"))).collect()] == ["10MB (fits in free tier)", "59MB (needs API key for full crawl)"]


def test_errors_and_speed(spark):
    told = {"x dimension mismatch 429": "Vector dimension mismatch. The file was created with a different embedding model.", "ENOENT: no 'a/b'": "File not found: a/b", "ENOENT ''": "File not found: unknown", "ENOENT": "File not found: unknown", "it got 429": "Rate limited. Wait a moment and try again.", "other": "other", "": "", None: "Unknown error"}
    df = spark.createDataFrame([(m,) for m in told], "m string")
    assert [r[0] for r in df.select(T.explained_error(F.col("m"))).collect()] == list(told.values())
    df = spark.createDataFrame([(10, 4.0), (7, 0.0), (7, -1.0), (0, 2.0)], "n long, s double")
    assert [r[0] for r in df.select(T.pages_per_second(F.col("n"), F.col("s"))).collect()] == ["2.5", "0.0", "0.0", "0.0"]


def test_plans_stay_small(spark):
    """Nested URL functions bind their parts once."""
    df = spark.createDataFrame([("a", "https://x.com/b")], "h string, u string")
    df = df.select(U.normalize_url(U.resolve_url(F.col("h"), F.col("u"))).alias("n"))
    assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 200_000
