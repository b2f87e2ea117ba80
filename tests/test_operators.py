import random
import time

import pytest
from pyspark.sql import functions as F

from sitelake.functions import dom, markdown
from sitelake.operators import dedup, extract, fetches, frontier, robots, sink, sitemaps
from sitelake.plans import queries
from sitelake.sources import files


def state_machine(kinds):
    now, keep, total = "", [], 0
    for k in kinds:
        ok = k == "N" or not now or (k == "P" and now == "O")
        total += k == "N" or not now
        if ok:
            now = k
        keep.append(ok)
    return keep, total


def test_locale_dedup_follows_the_state_machine(spark):
    rng = random.Random(1)
    paths = {"N": "/p{}", "P": "/en/p{}", "O": "/fr/p{}"}
    rows, want, total = [], {}, 0
    for key in range(60):
        kinds = [rng.choice("NPO") for _ in range(rng.randint(1, 6))]
        keep, n = state_machine(kinds)
        total += n
        for k, ok in zip(kinds, keep):
            want[len(rows)] = ok
            rows.append((len(rows), "https://x.com" + paths[k].format(key)))
    out = dedup.locale_dedup(spark.createDataFrame(rows, "seq long, url string").repartition(4))
    assert {r.seq: r.keep for r in out.collect()} == want
    stats = dedup.locale_stats(out).first()
    assert (stats.total, stats.locale_skipped, stats.unique_paths) == (total, sum(not k for k in want.values()), 60)


def test_leaders_are_the_greedy_ones(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pairs = {(r.a, r.b): r.similarity for r in dedup.similar_pairs(docs).collect()}
    kept, leader = [], {}
    for (d,) in sorted(docs.select("doc_id").collect()):
        near = [k for k in kept if (k, d) in pairs]
        leader[d] = near[0] if near else d
        if not near:
            kept.append(d)
    got = {r.id: (r.keep, r.leader) for r in dedup.similar_leaders(docs).collect()}
    assert got == {d: (leader[d] == d, leader[d]) for d in leader}


@pytest.mark.parametrize("local", [0, 1 << 16])
def test_leaders_of_drifting_groups(spark, local):
    """Many near copies, a word that all share, and rows whose least leader is decided after another one dropped them."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(40)]
    bases = [rng.sample(words, 12) for _ in range(4)]
    texts = [" ".join(["common", *rng.sample(base, rng.randint(10, 12)), *rng.sample(words, rng.randint(0, 2))]) for base in rng.choices(bases, k=160)]
    rows = list(enumerate(texts))
    sets = {i: set(t.split()) for i, t in rows}
    want, kept = {}, []
    for i, t in rows:
        same = next((j for j in range(i) if sets[j] == sets[i]), None)
        near = [k for k in kept if len(sets[k] & sets[i]) >= 0.85 * len(sets[k] | sets[i])]
        want[i] = (not near, min(near, default=i))
        if same is not None:
            want[i] = (False, want[same][1])
        elif not near:
            kept.append(i)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.id: (r.keep, r.leader) for r in dedup.similar_leaders(df, local=local).collect()} == want
    assert 10 < len(kept) < 150


def test_leaders_of_a_long_chain(spark):
    # each version is similar to the one before and after it only, so every other one is dropped
    chain = lambda n: spark.createDataFrame([(i, " ".join(f"w{k:04d}" for k in range(2 * i, 2 * i + 40))) for i in range(n)], "doc_id long, text string")
    want = lambda n: {i: (i % 2 == 0, i - i % 2) for i in range(n)}
    assert {r.id: (r.keep, r.leader) for r in dedup.similar_leaders(chain(120)).collect()} == want(120)
    assert {r.id: (r.keep, r.leader) for r in dedup.similar_leaders(chain(8), local=0).collect()} == want(8)


def test_a_shared_rare_word_alone_makes_no_candidate(spark):
    rng = random.Random(5)
    pool = [f"word{i:03d}" for i in range(60)]
    sets = [rng.sample(pool, 12) for _ in range(300)]
    sets += [[*x[:-1], "other"] for x in sets[:40]] + [x + ["another"] for x in sets[40:80]]
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(sets)], "doc_id long, text string")
    _, prefix, _ = dedup.similar_prefixes(df, 0.85, "doc_id", "text")
    found = {(r.ra, r.rb) for r in dedup._candidates(prefix, 0.85).collect()}
    near = {(a, b) for b in range(len(sets)) for a in range(b) if len(set(sets[a]) & set(sets[b])) >= 0.85 * len(set(sets[a]) | set(sets[b]))}
    assert len(near) >= 40 and near <= found and len(found) < len(near) + 100


def test_similar_pairs_need_few_counts(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {(r.a, r.b, r.similarity) for r in dedup.similar_pairs(docs).collect()}
    monkeypatch.setattr(dedup, "FREQUENT", 5)
    assert want and {(r.a, r.b, r.similarity) for r in dedup.similar_pairs(docs).collect()} == want


def test_robots(spark):
    text = "User-agent: *\nDisallow: /private\nAllow: /private/public\nDisallow: /*.pdf$\nDisallow: /same\nAllow: /same\nUser-agent: foo\nDisallow: /"
    table = spark.createDataFrame([("x.com", text), ("y.com", "User-agent: *\nUser-agent: foo\nDisallow: /"), ("z.com", "User-agent: *\nDisallow: /x # note\nCrawl-delay: 1.5s")], "host string, text string")
    want = {"https://x.com/private/x": False, "https://x.com/private/public/x": True, "https://x.com/a.pdf": False, "https://x.com/a.pdf?x=1": True, "https://x.com/": True, "https://x.com/same": True, "https://y.com/a": True, "https://z.com/x": True, "https://unknown.com/private": True}
    urls = spark.createDataFrame([(u,) for u in want], "url string")
    assert {r.url: r.allowed for r in robots.allowed(urls, table).collect()} == want
    assert {r.host: r.crawl_delay for r in robots.crawl_delay(table).collect()} == {"x.com": None, "y.com": None, "z.com": 1.5}


def test_sitemaps(spark):
    xml = "<urlset><url><loc> https://x.com/a?b=1&amp;c=2 </loc><lastmod>2024-02-01</lastmod><priority>abc</priority><image:image><image:loc>https://x.com/i.png</image:loc></image:image></url><url><loc><![CDATA[https://x.com/b]]></loc><priority>0.5</priority></url><url></url></urlset>"
    index = "<sitemapindex><sitemap><loc>s1</loc></sitemap><sitemap><loc>gone</loc></sitemap><sitemap><loc>s1</loc></sitemap></sitemapindex>"
    df = spark.createDataFrame([("x.com", 0, "s0", ""), ("x.com", 1, "s1", xml), ("y.com", 0, "s2", index)], "host string, priority int, sitemap_url string, xml string")
    got = sitemaps.entries(df.filter("sitemap_url = 's1'").select("host", "xml")).orderBy("pos").collect()
    assert [(r.loc, r.lastmod) for r in got] == [("https://x.com/a?b=1&c=2", "2024-02-01"), ("https://x.com/b", None)]
    assert got[0].priority != got[0].priority and got[1].priority == 0.5
    best = sitemaps.first_filled(df)
    assert {r.host: r.sitemap_url for r in best.collect()} == {"x.com": "s1", "y.com": "s2"}
    assert [(r.host, r.pos, r["loc"]) for r in sitemaps.routed_urls(best, df).orderBy("host", "pos").collect()] == [("x.com", 1, "https://x.com/a?b=1&c=2"), ("x.com", 2, "https://x.com/b"), ("y.com", 1, "https://x.com/a?b=1&c=2"), ("y.com", 2, "https://x.com/b")]


def test_waterfall(spark):
    rows = [("https://a.com/", "fetch", 0, 403, "x"), ("https://a.com/", "browser", 1, 200, "fine"), ("https://linkedin.com/", "fetch", 0, 200, "fine"), ("https://b.com/", "fetch", 0, 200, "fine"), ("https://b.com/", "browser", 1, 200, "fine")]
    df = spark.createDataFrame([(*r, None) for r in rows], "url string, engine string, priority int, status_code int, html string, final_url string")
    assert {(r.url, r.engine) for r in fetches.pick(df).collect()} == {("https://a.com/", "browser"), ("https://b.com/", "fetch")}
    assert {r.engine: r.n for r in fetches.engine_stats(df).collect()} == {"browser": 1, "fetch": 1, "blocked": 1}
    assert fetches.pick(df, force_engine="browser").count() == 2


def test_waterfall_takes_the_first_fetch_of_a_repeated_url(spark):
    rows = [(i, f"https://a.com/{i % 40}", "fetch", 0, 200 + i, "fine", None) for i in range(120)]
    for seed in range(3):
        mixed = random.Random(seed).sample(rows, len(rows))
        df = spark.createDataFrame(mixed, "page_id long, url string, engine string, priority int, status_code int, html string, final_url string").repartition(5)
        assert sorted(r.page_id for r in fetches.pick(df).collect()) == list(range(40))


HTML = """<html><head><title>My Page | Site</title><meta name="author" content=" Ann "><meta property="article:published_time" content="2024-03-07"></head>
<body><nav><a href="/nav">n</a></nav><article><h1>My Page</h1><p>%s <a href="/x.pdf">pdf</a> <a href="y">why</a> <a href="y">again</a></p>
<pre data-lang="sql"><span class="line">SELECT 1</span><span class="line">FROM t</span></pre><p>see <code>a</code> and <code>b</code></p><script>var t = "</p>";</script></article><footer>foot</footer></body></html>""" % ("many words of an article that goes on and on " * 6)


def test_extract(spark):
    df = spark.createDataFrame([(1, "https://x.com/docs/p", HTML), (2, "https://x.com/e-mpty", None)], "page_id long, url string, html string")
    one, two = extract.extract_pages(df).orderBy("page_id").collect()
    assert (one.title, one.author, one.published_date) == ("My Page", "Ann", "2024-03-07T00:00:00.000Z")
    assert one.links == ["https://x.com/nav", "https://x.com/y"]
    assert "```sql\nSELECT 1\nFROM t\n```" in one.markdown and "`ab` and" in one.markdown
    assert "foot" not in one.markdown and "var t" not in one.markdown
    assert one.byte_size == len(one.markdown.encode()) and one.word_count == len(one.markdown.split())
    assert (two.title, two.markdown, two.links, two.word_count) == ("e mpty", "", [], 0)
    links = extract.links_with_meta(df).orderBy("pos").collect()
    assert [(r.href, r.text, r.is_internal) for r in links] == [("https://x.com/nav", "n", True), ("https://x.com/y", "why", True)]


def test_pages_lose_scripts_and_navigation(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    for r in extract.extract_pages(pages).collect():
        assert r.markdown and "track(" not in r.markdown and "margin:0" not in r.markdown and "<p>" not in r.markdown


def test_markdown():
    html = '<h2>T <b>x</b></h2><p>Hi <em>you</em>, <a href="/a">link</a><br>next</p><ul><li>one<ul><li>two</li></ul></li><li>three</ul><ol start=3><li>a<li>b</ol><blockquote><p>q<p>r</blockquote><table><tr><th>a<th>b<tr><td>1<td>2|3</table><hr><p><b>bold<p>again</b> <del>x</del>'
    assert markdown.html_to_markdown(html) == "## T **x**\n\nHi *you*, [link](/a)\\\nnext\n\n- one\n  - two\n- three\n\n3. a\n3. b\n\n> q\n>\n> r\n\n| a | b |\n| --- | --- |\n| 1 | 2\\|3 |\n\n***\n\n**bold**\n\n**again** ~~x~~\n"
    assert markdown.html_to_markdown("  ") == "" and markdown.html_to_markdown("<pre>npm i</pre>") == "```javascript\nnpm i\n```\n".replace("javascript", "bash")


def test_cleaning():
    root = dom.parse('<div class="load-more">x</div><div class="a"><p></p></div><form role="search">s</form><form>f</form><p onclick="x" style="y" data-x="1" data-lang="z">t</p>')
    dom.clean(root)
    assert root.text() == "st"
    assert [n.attrs for n in root.elements() if n.tag == "p"] == [{"data-lang": "z"}]


def test_files_and_sink(spark, tmp_path):
    for name, text in {"src/a.py": "x = 1\n", "pkg/__init__.py": "y\n", "README.MD": "# r", "node_modules/x.js": "n", ".hid/a.py": "h", "package-lock.json": "{}", "Makefile": "m", "e.py": "", "nul.py": "a\0b", "a/b.md": "first", "a-b.md": "second"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    tree = files.read_tree(spark, str(tmp_path), 3)
    assert {r.path: r.language for r in tree.collect()} == {"src/a.py": "python", "pkg/__init__.py": "python", "README.MD": "markdown", "a/b.md": "markdown", "a-b.md": "markdown"}
    out = sink.source_files(tree, crawled=F.lit("now"))
    assert {r.filename for r in out.collect()} == {"src-a.py.md", "pkg-__init__.py.md", "README.MD.md", "a-b.md.md"}
    folder = tmp_path / "out"
    assert sink.write_files(out, str(folder)) == 4
    assert (folder / "src-a.py.md").read_text() == '---\npath: "src/a.py"\nlanguage: python\nsize: 6\ncrawled: "now"\n---\n\n```python\nx = 1\n\n```\n'


def test_page_files(spark):
    rows = [(0, "https://www.X.com/Docs/API/", 'A "t"', "body", None, None), (1, "https://x.com/a?x=1", "", "one", "Ann", "d"), (2, "https://x.com/a?x=2", None, "two", None, None), (3, "https://x.com/", "t", "  \n", None, None), (4, "https://x.com/a%20b", "t", "cut", None, None)]
    df = spark.createDataFrame(rows, "seq long, url string, title string, markdown string, author string, published_date string")
    out = {r.seq: r for r in sink.page_files(df, crawled=F.lit("now")).collect()}
    assert {s: r.filename for s, r in out.items()} == {0: "x.com__docs_api.md", 1: "x.com__a.md", 2: "x.com__a-1.md", 4: "x.com__a_20b.md"}
    assert out[0].content == '---\ntitle: "A \\"t\\""\nurl: "https://www.X.com/Docs/API/"\ncrawled: "now"\n---\nbody'
    assert out[1].content == '---\nurl: "https://x.com/a?x=1"\nauthor: "Ann"\ndate: "d"\ncrawled: "now"\n---\none'
    assert {r.seq for r in sink.page_files(df, cap_bytes=out[0].bytes + 1, crawled=F.lit("now")).collect()} == {0, 1}


def test_crawl(spark):
    words = "enough words to count as a page with some content in it and a little more than twenty words so it is kept here "
    page = lambda *links: f"<html><body><article><p>{words}</p>{''.join(f'<a href={chr(34)}{x}{chr(34)}>l</a>' for x in links)}</article></body></html>"
    site = {"https://s.com/": page("/a", "/b", "/b#x", "https://other.com/z", "/f.pdf"), "https://s.com/a": page("/c", "/"), "https://s.com/b": page("/d", "/secret/x"), "https://s.com/c": page("/e"), "https://s.com/d": "<p>low</p><a href='/q'>q</a>", "https://s.com/secret/x": page(), "https://s.com/e": page()}
    pages = spark.createDataFrame([(u, "fetch", 0, 200, h, None) for u, h in site.items()], "url string, engine string, priority int, status_code int, html string, final_url string")
    seeds = spark.createDataFrame([("s.com", 0)], "url string, seq long")
    txt = spark.createDataFrame([("s.com", "User-agent: *\nDisallow: /secret")], "host string, text string")
    got = {(r.url, r.depth) for r in frontier.crawl(pages, seeds, frontier.CrawlOptions(depth=2), txt).collect()}
    assert got == {("s.com", 0), ("https://s.com/a", 1), ("https://s.com/b", 1), ("https://s.com/c", 2)}
    some = frontier.crawl(pages, seeds, frontier.CrawlOptions(depth=2, max_pages=2), txt)
    assert {(r.url, r.seq) for r in some.collect()} == {("s.com", 1), ("https://s.com/a", 2)}
    assert frontier.plan(["https://x/a"], [True], frontier.CrawlOptions()).depth == 0
    assert frontier.plan(["https://x/"], [False], frontier.CrawlOptions()).depth == 2


def test_the_crawl_query_reaches_its_max_pages(spark, tmp_path):
    words = " ".join(f"word{i}" for i in range(30))
    html = F.concat(F.lit(f"<html><body><article><p>{words} "), F.col("page_id").cast("string"), F.lit("</p></article></body></html>"))
    spark.range(400).select(F.col("id").alias("page_id")).withColumn("html", html).write.parquet(f"{tmp_path}/pages.parquet")
    rows = queries.crawl(spark, str(tmp_path)).collect()
    assert sorted(r.seq for r in rows) == list(range(1, 301))
    assert {r.depth for r in rows} == {0, 1, 2, 3}


def test_the_crawl_query_keeps_its_pages_spread(spark, sf_dir, monkeypatch):
    given = []
    monkeypatch.setattr(frontier, "crawl", lambda site, *a: given.append(site) or site.withColumns({c: F.lit(1) for c in ("seq", "depth", "title", "word_count")}))
    queries.crawl(spark, sf_dir)
    assert "Window" not in given[0]._jdf.queryExecution().optimizedPlan().toString()
    n = spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    assert given[0].filter(F.contains("html", F.lit(f'"/p{n - 1}"'))).count() > 0 and given[0].filter(F.contains("html", F.lit(f'"/p{n}"'))).count() == 0


def test_pages_of_any_shape_are_extracted(spark):
    deep, wide = 10_000, 100_000
    shapes = {
        "spans": "<p>" + "<span>" * deep + "deep text " * 30 + "</span>" * deep + "</p>",
        "divs": "<div>" * deep + "<p>" + "deep text " * 30 + "</p>" + "</div>" * deep,
        "lists": "<ul><li>" * 1000 + "deep text " * 30,
        "siblings": "<div>" + "<i></i><script>x</script>" * wide + "<p>" + "plain words " * 30 + "</p></div>",
        "codes": "<p>" + "<code>x</code>" * wide + "</p>",
        "ends": "<p>words" + "</b>" * wide,
        "bodies": "<body>" * wide + "<p>" + "plain words " * 30,
    }
    df = spark.createDataFrame([(k, f"https://a.example/{k}", h) for k, h in shapes.items()], "k string, url string, html string").repartition(7)
    began = time.time()
    got = {r.k: r.markdown for r in extract.extract_pages(df).collect()}
    assert time.time() - began < 90
    assert set(got) == set(shapes)
    for k in ("spans", "divs", "lists"):
        assert "deep text deep text" in got[k]
    assert "plain words" in got["siblings"] and "plain words" in got["bodies"] and "words" in got["ends"] and "`xxx" in got["codes"]


def test_the_fallback_takes_tags_out(spark):
    df = spark.createDataFrame([(1, "https://a.example/x", "<h1>Hi</h1><p>there <b>you</b></p><pre><code>a &lt; b</code></pre>")], "k int, url string, html string")
    whole = extract.extract_pages(df).first()
    before = extract.raw_fields

    def fails(html, with_links=True):
        raise ValueError

    extract.raw_fields = fails
    try:
        row = extract.extract_pages(df).first()
    finally:
        extract.raw_fields = before
    assert whole.title == "Hi" and (row.k, row.url) == (1, "https://a.example/x")
    assert "Hi there you" in row.markdown and "```\na < b\n```" in row.markdown and "<" not in row.markdown.replace("a < b", "")
    assert row.links == [] and row.word_count > 0


def test_names_never_clash(spark):
    rng = random.Random(4)
    stems = [rng.choice(["a", "a-1", "a-1-2", "b", "b-7", "c", "d-3"]) for _ in range(300)]
    files_ = ["a-2.md", "c.md", "c-1.md", "z.md", "b-1.txt"]

    def want(there):
        used, out = set(there), {}
        for i, x in enumerate(stems):
            name, n = x, 1
            while f"{name}.md" in used:
                name, n = f"{x}-{n}", n + 1
            used.add(f"{name}.md")
            out[i] = f"{name}.md"
        return out

    rows = spark.createDataFrame(list(enumerate(stems)), "seq long, stem string").repartition(5)
    assert {r.seq: r.filename for r in sink.unique_names(rows).collect()} == want([])
    existing = spark.createDataFrame([(f,) for f in files_], "filename string")
    assert {r.seq: r.filename for r in sink.unique_names(rows, existing=existing).collect()} == want(files_)


def test_urls_with_a_session(spark):
    urls = spark.createDataFrame([(1, "https://www.a.example/x"), (2, "https://b.example"), (3, "https://c.example/y")], "i int, url string")
    stored = spark.createDataFrame([("a.example",), ("a.example",), ("www.C.example",)], "domain string")
    assert sorted(r.i for r in files.with_session(urls, stored).collect()) == [1, 3]


def test_news_sitemaps_come_first(spark):
    url = lambda p, d="": f"<url><loc>{p}</loc>{d}</url>"
    dated = "<lastmod>2024-01-02</lastmod>"
    rows = [
        ("a", "https://a/sitemap.xml", url("old", dated)), ("a", "https://a/sitemaps/news.xml", url("late", dated)), ("a", "https://a/sitemap-news.xml", url("n1", dated) + "<url></url>" + url("n2")), ("a", "https://a/news-sitemap.xml", "<urlset/>"),
        ("b", "https://b/sitemap.xml", ""), ("b", "https://b/sitemap_index.xml", "<sitemapindex>" + "".join(f"<sitemap><loc>https://b/{k}.xml</loc></sitemap>" for k in range(4)) + "</sitemapindex>"), *[("b", f"https://b/{k}.xml", url(f"c{k}", dated) + url(f"d{k}")) for k in range(4)],
        ("c", "https://c/other.xml", url("x")), ("d", "https://d/sitemap.xml", None),
    ]
    made = sitemaps.news_first(spark.createDataFrame(rows, "host string, sitemap_url string, xml string"), most=7)
    got = [(r.host, r.pos, r.loc, r.lastmod) for r in made.orderBy("host", "pos").collect()]
    below = [x for k in range(4) for x in (f"c{k}", f"d{k}")][:7]
    assert got == [("a", 1, "n1", "2024-01-02"), ("a", 2, "n2", None), *[("b", i + 1, x, None) for i, x in enumerate(below)]]
