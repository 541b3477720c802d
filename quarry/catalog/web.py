"""Queries for scans, links and the crawl (S1, S2, S13, P1-P12, P17, J1-J4,
A1, T3, U1, U4, U5).

Driver pages only carry root-relative hrefs, so page URLs (which vary more:
``?``, ``#``, ``.html``, trailing ``/``) are added as href candidates, and the
crawl starts from the page URLs as level-0 links (the shape of a seed page that
lists every page).  Processed URLs of an "earlier run" are the ``https`` pages.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from quarry.catalog import register
from quarry.catalog import sqlfrag as Q
from quarry.functions import urls as U
from quarry.functions.elements import element_text
from quarry.functions.html import html_to_text
from quarry.operators import crawl as C
from quarry.operators.links import distinct_links, extract_links
from quarry.sources.tables import scan_pages, table


def _links(spark, sf):
    return extract_links(scan_pages(spark, sf))


def _candidates(spark, sf):
    """Link hrefs plus page URLs, with the base of the page they are on (a
    function of its URL, which every row has)."""
    pages = scan_pages(spark, sf)
    links = _links(spark, sf).select("page_id", "tag", F.col("pos").cast("bigint").alias("pos"), "href", "page_url")
    urls = pages.select("page_id", F.lit("url").alias("tag"), F.lit(0).cast("bigint").alias("pos"),
                        F.col("url").alias("href"), F.col("url").alias("page_url"))
    return links.unionByName(urls).withColumn("base", U.derive_base(F.col("page_url"))).drop("page_url")


CAND_SQL = f"""cand AS (
  SELECT page_id, tag, pos, href FROM ({Q.extract_links()})
  UNION ALL SELECT page_id, 'url', CAST(0 AS BIGINT), url FROM pages),
candb AS (SELECT c.*, {Q.derive_base('p.url')} AS base FROM cand c JOIN pages p USING (page_id))"""


def _processed(spark, sf):
    return scan_pages(spark, sf).where(F.col("url").startswith("https://")).select("url")


PROCESSED_SQL = "processed AS (SELECT url FROM pages WHERE prefix(url, 'https://'))"


def _start(spark, sf):
    return scan_pages(spark, sf).select(F.col("url").alias("seed_url"),
                                        U.derive_base(F.col("url")).alias("base"), "url")


def _crawl(spark, sf, processed=None):
    return C.crawl(_start(spark, sf), scan_pages(spark, sf), processed)


def _crawl_sql(with_processed: bool = False) -> str:
    anti = " AND url NOT IN (SELECT url FROM processed)" if with_processed else ""
    return f"""st AS (SELECT url, CASE WHEN html IS NOT NULL THEN 'inside' ELSE 'wrong' END AS f FROM pages),
start AS (SELECT DISTINCT url AS seed_url, {Q.derive_base('url')} AS base, url FROM pages WHERE true{anti}),
l0 AS (SELECT s.seed_url, s.base, s.url, CAST(0 AS BIGINT) AS level, coalesce(st.f, 'wrong') AS status
       FROM start s LEFT JOIN st USING (url)),
ex AS (SELECT DISTINCT url FROM l0 WHERE status = 'inside'),
raw AS (SELECT page_url, href FROM ({Q.extract_links('(SELECT p.* FROM pages p SEMI JOIN ex USING (url))')})),
nl AS (SELECT l0.seed_url, l0.base, {Q.normalize('raw.href')} AS href
       FROM raw JOIN l0 ON raw.page_url = l0.url AND l0.status = 'inside'),
ac AS (SELECT DISTINCT seed_url, base, {Q.absolute('base', 'href')} AS url FROM nl
       WHERE href IS NOT NULL AND href <> '' AND NOT contains(href, 'http') AND {Q.accept('base', 'href')}),
l1c AS (SELECT * FROM ac a WHERE contains(url, base){anti}
        AND NOT EXISTS (SELECT 1 FROM l0 WHERE l0.seed_url = a.seed_url AND l0.url = a.url)),
l1 AS (SELECT l1c.seed_url, l1c.base, l1c.url, CAST(1 AS BIGINT) AS level,
              CASE WHEN contains(l1c.url, '.pdf') THEN 'pdf' ELSE coalesce(st.f, 'wrong') END AS status
       FROM l1c LEFT JOIN st USING (url)),
crawled AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1)"""


@register("scan_pages", "S1", "SELECT page_id, url, CAST(length(html) AS BIGINT) AS html_chars FROM pages")
def q_scan_pages(spark, sf):
    return scan_pages(spark, sf).select("page_id", "url", F.length("html").cast("bigint").alias("html_chars"))


@register("html_to_text", "S2", lambda: f"SELECT page_id, url, {Q.html_to_text_sql('html')} AS text FROM pages")
def q_html_to_text(spark, sf):
    return scan_pages(spark, sf).select("page_id", "url", html_to_text(F.col("html")).alias("text"))


@register("element_text", "S2", lambda: f"SELECT page_id, url, {Q.html_to_text_sql('html')} AS text FROM pages")
def q_element_text(spark, sf):
    """Page text by elements: on regular markup what the regex chain gives."""
    return element_text(scan_pages(spark, sf)).select("page_id", "url", "text")


@register("extract_links", "P1", lambda: f"SELECT * FROM ({Q.extract_links()})")
def q_extract_links(spark, sf):
    return _links(spark, sf).select("page_id", "page_url", "tag", F.col("tag_rank").cast("bigint").alias("tag_rank"),
                                    F.col("pos").cast("bigint").alias("pos"), "href")


@register("distinct_links", "A1", lambda: f"SELECT DISTINCT page_url, href FROM ({Q.extract_links()})")
def q_distinct_links(spark, sf):
    return distinct_links(_links(spark, sf))


@register("normalize_href", "P2,P3", lambda: f"""WITH {CAND_SQL}
SELECT page_id, tag, pos, href AS raw_href, {Q.normalize('href')} AS href FROM cand
WHERE href IS NOT NULL AND {Q.normalize('href')} <> ''""")
def q_normalize_href(spark, sf):
    c = _candidates(spark, sf)
    return (c.select("page_id", "tag", "pos", F.col("href").alias("raw_href"),
                     U.normalize_href(F.col("href")).alias("href"))
            .where(U.href_present(F.col("href"))))


@register("relative_links", "P4", lambda: f"""WITH {CAND_SQL}
SELECT page_id, tag, pos, h AS href FROM (SELECT *, {Q.normalize('href')} AS h FROM cand)
WHERE h IS NOT NULL AND h <> '' AND NOT contains(h, 'http')""")
def q_relative_links(spark, sf):
    c = _candidates(spark, sf).withColumn("href", U.normalize_href(F.col("href")))
    return (c.where(U.href_present(F.col("href")) & U.is_relative(F.col("href")))
            .select("page_id", "tag", "pos", "href"))


@register("accept_links", "P5", lambda: f"""WITH {CAND_SQL}
SELECT page_id, tag, pos, base, h AS href, {Q.accept('base', 'h')} AS accepted
FROM (SELECT *, {Q.normalize('href')} AS h FROM candb) WHERE h IS NOT NULL AND h <> ''""")
def q_accept_links(spark, sf):
    c = _candidates(spark, sf).withColumn("href", U.normalize_href(F.col("href")))
    return (c.where(U.href_present(F.col("href")))
            .select("page_id", "tag", "pos", "base", "href",
                    U.accept_href(F.col("base"), F.col("href")).alias("accepted")))


@register("absolute_links", "P6", lambda: f"""WITH {CAND_SQL}
SELECT page_id, tag, pos, base, h AS href, {Q.absolute('base', 'h')} AS link
FROM (SELECT *, {Q.normalize('href')} AS h FROM candb)
WHERE h IS NOT NULL AND h <> '' AND NOT contains(h, 'http') AND {Q.accept('base', 'h')}""")
def q_absolute_links(spark, sf):
    c = _candidates(spark, sf).withColumn("href", U.normalize_href(F.col("href")))
    b, h = F.col("base"), F.col("href")
    return (c.where(U.href_present(h) & U.is_relative(h) & U.accept_href(b, h))
            .select("page_id", "tag", "pos", "base", "href", U.absolute_link(b, h).alias("link")))


@register("in_scope", "P7", lambda: f"""SELECT a.page_id, {Q.derive_base('a.url')} AS base, b.url AS link,
contains(b.url, {Q.derive_base('a.url')}) AS in_scope
FROM pages a JOIN pages b ON b.page_id = a.page_id + 1""")
def q_in_scope(spark, sf):
    """Each page's base against the next page's URL (an equi join on id + 1)."""
    p = scan_pages(spark, sf)
    a = p.select("page_id", U.derive_base(F.col("url")).alias("base"))
    b = p.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("link"))
    return a.join(b, "page_id").select("page_id", "base", "link",
                                       U.in_scope(F.col("link"), F.col("base")).alias("in_scope"))


@register("route_links", "P8,P9", lambda: f"""WITH {CAND_SQL}
SELECT page_id, tag, pos, href, {Q.route('href')} AS route FROM cand WHERE href IS NOT NULL AND href <> ''""")
def q_route_links(spark, sf):
    c = _candidates(spark, sf)
    return (c.where(U.href_present(F.col("href")))
            .select("page_id", "tag", "pos", "href", U.route(F.col("href")).alias("route")))


@register("derive_base", "P10", lambda: f"SELECT page_id, url, {Q.derive_base('url')} AS base FROM pages")
def q_derive_base(spark, sf):
    return scan_pages(spark, sf).select("page_id", "url", U.derive_base(F.col("url")).alias("base"))


@register("validate_seeds", "P11", lambda: f"SELECT page_id, url, {Q.seed_valid('url')} AS valid FROM pages")
def q_validate_seeds(spark, sf):
    return scan_pages(spark, sf).select("page_id", "url", U.seed_valid(F.col("url")).alias("valid"))


@register("classify_links", "P12,J3,U5", lambda: f"""WITH {CAND_SQL},
fr AS (SELECT DISTINCT {Q.absolute('base', 'h')} AS url FROM (SELECT *, {Q.normalize('href')} AS h FROM candb)
       WHERE h IS NOT NULL AND h <> '' AND NOT contains(h, 'http') AND {Q.accept('base', 'h')}
       UNION SELECT url FROM pages)
SELECT fr.url, coalesce(CASE WHEN p.html IS NOT NULL THEN 'inside' ELSE 'wrong' END, 'wrong') AS status
FROM fr LEFT JOIN pages p USING (url)""")
def q_classify_links(spark, sf):
    c = _candidates(spark, sf).withColumn("href", U.normalize_href(F.col("href")))
    b, h = F.col("base"), F.col("href")
    fr = (c.where(U.href_present(h) & U.is_relative(h) & U.accept_href(b, h))
          .select(U.absolute_link(b, h).alias("url"))
          .union(scan_pages(spark, sf).select("url")).distinct())
    return C.classify_links(fr, scan_pages(spark, sf)).select("url", "status")


@register("crawl_two_hop", "P17,J2", lambda: f"WITH {_crawl_sql()} SELECT * FROM crawled")
def q_crawl_two_hop(spark, sf):
    return _crawl(spark, sf)


@register("crawl_budget", "T3", lambda: f"""WITH {_crawl_sql()}
SELECT seed_url, url, level, fetch_rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY seed_url ORDER BY level, url) AS BIGINT) AS fetch_rank
  FROM crawled WHERE status <> 'pdf') WHERE fetch_rank <= {C.DEFAULT_MAX_PAGES}""")
def q_crawl_budget(spark, sf):
    return (C.crawl_budget(_crawl(spark, sf))
            .select("seed_url", "url", "level", F.col("fetch_rank").cast("bigint").alias("fetch_rank")))


@register("new_links", "J1,U4", lambda: f"""WITH {PROCESSED_SQL}, {_crawl_sql()}
SELECT DISTINCT url FROM crawled WHERE url NOT IN (SELECT url FROM processed)""")
def q_new_links(spark, sf):
    found = _crawl(spark, sf).select("url").distinct()
    return C.new_links(found, _processed(spark, sf))


@register("crawl_incremental", "J1,J2,P17", lambda: f"""WITH {PROCESSED_SQL}, {_crawl_sql(True)}
SELECT * FROM crawled""")
def q_crawl_incremental(spark, sf):
    """Second run: URLs processed earlier are neither fetched nor expanded."""
    return _crawl(spark, sf, _processed(spark, sf))


@register("processed_union", "U1", lambda: f"""WITH {PROCESSED_SQL}, {_crawl_sql(True)}
SELECT url FROM crawled WHERE status = 'inside' UNION SELECT url FROM processed""")
def q_processed_union(spark, sf):
    crawled = _crawl(spark, sf, _processed(spark, sf))
    return C.processed_union(crawled.where(F.col("status") == "inside"), _processed(spark, sf))


@register("processed_docs", "J4", f"""WITH {PROCESSED_SQL}
SELECT page_id, url FROM pages SEMI JOIN processed USING (url)""")
def q_processed_docs(spark, sf):
    return C.processed_docs(scan_pages(spark, sf), _processed(spark, sf)).select("page_id", "url")


@register("processed_listing", "S13", lambda: f"""WITH {PROCESSED_SQL}, {_crawl_sql(True)}
SELECT url FROM (SELECT url FROM crawled WHERE status = 'inside' UNION SELECT url FROM processed) ORDER BY url""")
def q_processed_listing(spark, sf):
    crawled = _crawl(spark, sf, _processed(spark, sf))
    return C.processed_union(crawled.where(F.col("status") == "inside"), _processed(spark, sf)).orderBy("url")
