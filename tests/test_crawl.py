"""P12, P17, J1-J3 on a hand-made link graph (FIXTURES.md `linked_pages`)."""
from pyspark.sql import functions as F

from quarry.operators.crawl import classify_links, crawl_from_seeds, crawl_budget

B = "https://site.org/docs"


def page(url, links, status=200, html=True):
    body = "".join(f'<a href="{h}">x</a>' for h in links)
    return (url, f"<html><body>{body}<link rel='x' href='/style'></body></html>" if html else None, status)


PAGES = [
    page(f"{B}/", [f"{B}/a", f"{B}/b", f"{B}/c", "https://other.org/x", f"{B}/guide.pdf", f"{B}/missing"]),
    page(f"{B}/a", ["/a1", "a2", "/b", "/gone", "x.pdf", "/q?x=1"]),   # /b is also level 0: stays level 0
    page(f"{B}/b", ["/b1", "/b2/"]),
    page(f"{B}/c", ["/c1"], status=404),                                # 404: wrong, not expanded
    page(f"{B}/a1", ["/deep1", "/deep2"]),                              # level 1: links not followed
    page(f"{B}/a2", [f"{B}/a"]),                                        # cycle
    page(f"{B}/b1", [], status=403),                                    # 403 is kept
    page(f"{B}/b2", [], status=500),
    page(f"{B}/deep1", []),
    page(f"{B}/gone", [], html=False),                                  # no html: wrong
]


def _pages(spark):
    return spark.createDataFrame(PAGES, "url string, html string, status_code int")


def test_two_hop_crawl(spark):
    seeds = spark.createDataFrame([(f"{B}/",)], "seed_url string")
    got = {(r.url, r.level, r.status) for r in crawl_from_seeds(seeds, _pages(spark)).collect()}
    assert got == {
        (f"{B}/a", 0, "inside"), (f"{B}/b", 0, "inside"), (f"{B}/c", 0, "wrong"),
        (f"{B}/missing", 0, "wrong"), (f"{B}/guide.pdf", 0, "pdf"),
        (f"{B}/a1", 1, "inside"), (f"{B}/a2", 1, "inside"), (f"{B}/gone", 1, "wrong"),
        (f"{B}/b1", 1, "inside"), (f"{B}/b2", 1, "inside"),
        (f"{B}/style", 1, "wrong"),
    }


def test_processed_links_are_skipped(spark):
    seeds = spark.createDataFrame([(f"{B}/",)], "seed_url string")
    processed = spark.createDataFrame([(f"{B}/a",), (f"{B}/b1",)], "url string")
    got = {r.url for r in crawl_from_seeds(seeds, _pages(spark), processed).collect()}
    assert f"{B}/a" not in got and f"{B}/b1" not in got and f"{B}/a1" not in got
    assert f"{B}/b2" in got


def test_invalid_seed_and_budget(spark):
    seeds = spark.createDataFrame([(f"{B}/x/y",)], "seed_url string")   # > 3 slashes, no final slash
    assert crawl_from_seeds(seeds, _pages(spark)).count() == 0
    seeds = spark.createDataFrame([(f"{B}/",)], "seed_url string")
    top = crawl_budget(crawl_from_seeds(seeds, _pages(spark)), max_pages=3).orderBy("fetch_rank").collect()
    assert [r.url for r in top] == [f"{B}/a", f"{B}/b", f"{B}/c"]


def test_classify(spark):
    fr = spark.createDataFrame([(f"{B}/b1",), (f"{B}/c",), (f"{B}/nothing",)], "url string")
    got = {r.url: r.status for r in classify_links(fr, _pages(spark)).collect()}
    assert got == {f"{B}/b1": "inside", f"{B}/c": "wrong", f"{B}/nothing": "wrong"}


def test_one_row_per_url_by_the_last_fetch(spark):
    rows = [(1, f"{B}/", f"<a href='{B}/a'>x</a>"), (2, f"{B}/a", "<a href='/old'>x</a>"), (5, f"{B}/a", "<a href='/new'>x</a>"),
            (4, f"{B}/a", None), (6, f"{B}/new", "<p>x</p>"), (7, f"{B}/new", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    seeds = spark.createDataFrame([(f"{B}/",), (f"{B}/",)], "seed_url string")
    got = sorted((r.url, r.level, r.status) for r in crawl_from_seeds(seeds, pages).collect())
    assert got == [(f"{B}/a", 0, "inside"), (f"{B}/new", 1, "wrong")]


def test_pages_past_the_budget_are_not_parsed(spark, monkeypatch):
    from quarry.operators import crawl as C
    parsed = []
    real = C.extract_links
    monkeypatch.setattr(C, "extract_links", lambda pages, **kw: parsed.append(sorted(
        r.url for r in pages.select("url").collect())) or real(pages, **kw) if "url_col" not in kw else real(pages, **kw))
    seeds = spark.createDataFrame([(f"{B}/",)], "seed_url string")
    got = {(r.url, r.level, r.fetched) for r in crawl_from_seeds(seeds, _pages(spark), max_pages=1).collect()}
    assert parsed == [[f"{B}/a"]]                                       # b is beyond the budget
    assert got == {(f"{B}/a", 0, True), (f"{B}/b", 0, False), (f"{B}/c", 0, False), (f"{B}/missing", 0, False), (f"{B}/guide.pdf", 0, False),
                   (f"{B}/a1", 1, False), (f"{B}/a2", 1, False), (f"{B}/gone", 1, False), (f"{B}/style", 1, False)}
    parsed.clear()
    got = {(r.url, r.fetched) for r in crawl_from_seeds(seeds, _pages(spark), max_pages=6).collect()}
    assert {u for u, f in got if f} == {f"{B}/a", f"{B}/b", f"{B}/c", f"{B}/missing", f"{B}/a1", f"{B}/a2"}


def test_unbounded_crawl_ends_on_cycles(spark):
    seeds = spark.createDataFrame([(f"{B}/",)], "seed_url string")
    got = {r.url: r.level for r in crawl_from_seeds(seeds, _pages(spark), max_level=None).collect()}
    assert got[f"{B}/deep1"] == 2 and got[f"{B}/deep2"] == 2 and got[f"{B}/a"] == 0
    chain = [page(f"{B}/", [f"{B}/n0"])] + [page(f"{B}/n{i}", [f"/n{i + 1}", "/n0"]) for i in range(7)]
    pages = spark.createDataFrame(chain, "url string, html string, status_code int")
    got = {r.url: r.level for r in crawl_from_seeds(seeds, pages, max_level=None).collect()}
    assert got == {f"{B}/n{i}": i for i in range(8)} | {f"{B}/style": 1}


def test_unbounded_crawl_parses_pages_once(spark, monkeypatch):
    from quarry.operators import crawl as C
    parsed = []
    real = C.extract_links
    monkeypatch.setattr(C, "extract_links", lambda pages, **kw: parsed.append(kw.get("url_col")) or real(pages, **kw))
    chain = [page(f"{B}/", [f"{B}/n0"])] + [page(f"{B}/n{i}", [f"/n{i + 1}/"]) for i in range(3)]
    pages = spark.createDataFrame(chain, "url string, html string, status_code int")
    seeds = spark.createDataFrame([(f"{B}/",)], "seed_url string")
    got = {r.url: r.level for r in crawl_from_seeds(seeds, pages, max_level=None).collect()}
    assert got == {f"{B}/n{i}": i for i in range(4)} | {f"{B}/style": 1}
    assert parsed == ["seed_url", None]                                 # the seed pages, then every page


def test_followed_links_by_both_ways(spark):
    """Repeated rows, an older fetch, a failed one: the same links whether few or
    most pages are asked; most pages meet nothing before they are parsed."""
    from quarry.operators.crawl import fetch_status, followed_links
    rows = [(1, "u", "<a href='/old'>x</a>"), (2, "u", "<a href='/a/'>x</a><a href='/a'>x</a><a href='http://far'>x</a>"),
            (2, "u", "<a href='/a'>x</a>"), (3, "v", None), (4, "w", "<a href='/'>x</a><a href=''>x</a>"), (5, None, "<a href='/n'>x</a>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    status = fetch_status(pages).where("_fetched = 'inside'")
    few, most = followed_links(pages, status), followed_links(pages, status, most=True)
    assert [tuple(r) for r in few.collect()] == [tuple(r) for r in most.collect()] == [("u", "/a")]


def test_last_fetch_shuffles_html_once(spark):
    from quarry.plans.ingest import page_sources
    rows = [(i % 7, f"u{i % 5}", None if i % 3 else f"<p>{i % 7}</p>") for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").dropDuplicates(["page_id", "url"])
    last = {}
    for r in pages.collect():
        last[r.url] = max(last.get(r.url, (-1, None)), (r.page_id, r.html or ""))
    assert {r.source: (r.fetch, r.content or "") for r in page_sources(pages).collect()} == last
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = spark.createDataFrame(rows, "page_id long, url string, html string")
        plan = page_sources(table)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 3                 # html with its key; the status, before and after its aggregate
