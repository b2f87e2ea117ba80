from sitelake.operators.frontier import CrawlOptions
from sitelake.plans import api


def test_single_pages_to_files(spark, tmp_path):
    text = "<article><p>" + "enough words for a page that is kept by the crawl " * 5 + "</p></article>"
    pages = spark.createDataFrame([(f"https://s.com/{p}", "fetch", 0, 200, text, None) for p in "ab"], "url string, engine string, priority int, status_code int, html string, final_url string")
    got = api.crawl_to_files(spark, pages, ["https://s.com/a"], str(tmp_path / "docs"), CrawlOptions(), crawled="now")
    assert got["pages"] == 1 and [f.name for f in (tmp_path / "docs").iterdir()] == ["docs__a.md"]
    assert got["bytes"] == (tmp_path / "docs" / "docs__a.md").stat().st_size


def test_routing_and_preview(spark, tmp_path):
    (tmp_path / "repo" / ".git").mkdir(parents=True)
    web, git = api.route(spark, ["https://x.com", "https://github.com/a/b", str(tmp_path / "repo"), str(tmp_path)])
    assert web == ["https://x.com", str(tmp_path)] and git == ["https://github.com/a/b", str(tmp_path / "repo")]
    xml = "<urlset><url><loc>https://x.com/a</loc></url><url><loc>https://x.com/b</loc><lastmod>2024-05-01</lastmod></url></urlset>"
    table = spark.createDataFrame([("x.com", 0, "s", xml)], "host string, priority int, sitemap_url string, xml string")
    got = api.preview(table, "x.com", 1)
    assert got == {"domain": "x.com", "total_pages": 2, "has_sitemap": True, "estimated_size": "0MB (fits in free tier)", "recent_pages": [{"url": "https://x.com/b", "lastmod": "2024-05-01"}]}
    assert api.preview(table, "y.com")["has_sitemap"] is False
