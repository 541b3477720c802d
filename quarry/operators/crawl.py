"""Breadth-first bounded crawl as joins.

The live fetcher is replaced by a table of fetched pages ``(url, html[,
status_code])``.  A crawl of ``max_level`` levels is ``max_level + 1`` rounds of
set operations — a constant number of joins a round, no per-URL loop; without a
level limit rounds end when one finds nothing new.  Visited and
processed sets are anti joins; the html column joins only the pages that are
expanded (column pruning keeps it out of the status joins).

Deviation from the reference (documented): expansion is breadth first and a URL
keeps its smallest level, so the result does not depend on set iteration order.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import urls as U
from quarry.session import cut_lineage
from quarry.operators.links import extract_links, normalized_links, resolve_relative

# --- fixed values -----------------------------------------------------------
MAX_LEVEL = 1
# 300 s budget / 2 s politeness delay = 150 pages per request
DEFAULT_MAX_PAGES = 150
# ----------------------------------------------------------------------------


def fetch_status(pages: DataFrame) -> DataFrame:
    """One row per URL, ``url, _fetched, _version``: of several fetches of a URL
    the last counts (greatest ``page_id``; without that column the greatest
    hash of the html).  Narrow; the only step that reads ``html`` to classify."""
    status = F.col("status_code") if "status_code" in pages.columns else F.lit(200)
    ok = F.col("html").isNotNull() & (F.coalesce(status, F.lit(200)) != 404)
    return (pages.select("url", fetch_number(pages).alias("_version"), ok.alias("_ok"))
            .groupBy("url").agg(F.max("_version").alias("_version"), F.max_by("_ok", "_version").alias("_ok"))
            .select("url", F.when(F.col("_ok"), "inside").otherwise("wrong").alias("_fetched"), "_version"))


def fetch_number(pages: DataFrame) -> Column:
    """What orders the fetches of a URL."""
    return F.col("page_id").cast("long") if "page_id" in pages.columns else F.coalesce(F.xxhash64("html"), F.lit(0))


def last_fetch(pages: DataFrame, status: DataFrame, columns: tuple[str, ...] = ("url", "html")) -> DataFrame:
    """The pages, one row per URL of ``status`` (by its ``_version``), with
    ``columns`` of both.  The html is shuffled once: repeated rows of a fetch are
    dropped by the keys of the join."""
    versioned = pages.select(*[c for c in columns if c in pages.columns], fetch_number(pages).alias("_version"))
    return versioned.join(status, ["url", "_version"]).dropDuplicates(["url", "_version"]).select(*columns)


def followed_links(pages: DataFrame, status: DataFrame, most: bool = False) -> DataFrame:
    """``page_url, href``: the distinct links, normalized and relative, of the last
    fetches that ``status`` names.  Nothing is deduplicated by its html: of fetches
    with the same number the links of all count.  ``most`` says that ``status`` has
    most pages: then each page is parsed where it is read and only its links are
    shuffled; otherwise only the named pages are parsed."""
    wanted = status.select(F.col("url").alias("page_url"), "_version")
    numbered = pages.select(F.col("url").alias("page_url"), "html", fetch_number(pages).alias("_version"))
    if not most:
        numbered = numbered.join(wanted, ["page_url", "_version"], "left_semi")
    links = extract_links(numbered.select(F.col("page_url").alias("url"), "html", "_version", F.lit(0).alias("page_id")),
                          carry=("_version",))
    links = normalized_links(links.select("page_url", "_version", "href")).where(U.is_relative(F.col("href"))).distinct()
    if most:
        links = links.join(wanted, ["page_url", "_version"], "left_semi")
    return links.select("page_url", "href")


def classify_links(frontier: DataFrame, pages: DataFrame | None = None,
                   status: DataFrame | None = None) -> DataFrame:
    """Left join on URL; a miss, no html or a 404 is ``wrong``, every
    other status (403, 500, ...) is ``inside``.  Pass ``status`` (from
    :func:`fetch_status`) to avoid re-reading the pages."""
    st = status if status is not None else fetch_status(pages)
    return (frontier.join(st.select("url", "_fetched"), "url", "left")
            .withColumn("status", F.coalesce(F.col("_fetched"), F.lit("wrong")))
            .drop("_fetched"))


def seed_frontier(seeds: DataFrame, pages: DataFrame, processed: DataFrame | None = None) -> DataFrame:
    """Seed handling (P10, P11, P8, P9): ``base, url, level=0, route``.

    Invalid seeds and seeds whose page is missing yield nothing.  Seed-page
    links are not normalized; ``.pdf`` links route to ``pdf``; links with
    ``http`` that contain the base and are not processed become level 0.
    """
    # written, so that its size is known and a short list is broadcast to the pages
    s = cut_lineage(seeds.select(F.col("seed_url").alias("url")).where(U.seed_valid(F.col("url"))).distinct())
    asked = pages.join(s, "url", "left_semi")
    last = fetch_status(asked).where("_fetched = 'inside'").select("url", "_version")
    seed_pages = asked.select("url", "html", fetch_number(asked).alias("_version")).join(last, ["url", "_version"], "left_semi")
    links = (extract_links(seed_pages.select(F.col("url").alias("seed_url"), "html", F.lit(0).alias("page_id")), url_col="seed_url")
             .select(F.col("page_url").alias("seed_url"), U.derive_base(F.col("page_url")).alias("base"), "href"))
    routed = (links.where(U.href_present(F.col("href")))
              .withColumn("route", U.route(F.col("href")))
              .where((F.col("route") == "pdf")
                     | ((F.col("route") == "page") & U.in_scope(F.col("href"), F.col("base"))))
              .select("seed_url", "base", F.col("href").alias("url"), F.lit(0).alias("level"), "route")
              .dropDuplicates(["seed_url", "url"]))
    if processed is not None:
        routed = routed.join(processed.select("url"), "url", "left_anti")
    return routed


def within_budget(found: DataFrame, earlier: DataFrame | None, max_pages: int) -> DataFrame:
    """T3 inside a round: ``found`` with ``fetched``, true for the pages that are
    among the first ``max_pages`` of their seed by (level, url); ``earlier`` are the
    rows of the rounds before.  PDF links are not fetched."""
    w = Window.partitionBy("seed_url").orderBy("url")
    first = (found.where(F.col("status") != "pdf").select("seed_url", "url").withColumn("_rank", F.row_number().over(w))
             .where(F.col("_rank") <= max_pages))
    if earlier is not None:
        used = earlier.where(F.col("status") != "pdf").groupBy("seed_url").agg(F.count("*").alias("_used"))
        first = first.join(used, "seed_url", "left").where(F.col("_rank") + F.coalesce("_used", F.lit(0)) <= max_pages)
    return (found.join(first.select("seed_url", "url", F.lit(True).alias("fetched")), ["seed_url", "url"], "left")
            .withColumn("fetched", F.coalesce("fetched", F.lit(False))))


def crawl(start: DataFrame, pages: DataFrame, processed: DataFrame | None = None,
          max_level: int | None = MAX_LEVEL, max_pages: int | None = None) -> DataFrame:
    """``start(seed_url, base, url)`` are level-0 pages.  Returns
    ``seed_url, base, url, level, status`` with status ``inside``, ``wrong`` or
    ``pdf``; every URL once per seed, at its smallest level.

    Rounds are semi-naive: each expands only what the one before it found first.
    ``max_level=None`` goes on until a round finds nothing.  ``max_pages`` ends the
    crawl of a seed after so many fetches (T3): pages beyond it are reported with
    ``fetched`` false and never expanded."""
    frontier = start.select("seed_url", "base", "url").withColumn("level", F.lit(0))
    if processed is not None:
        frontier = frontier.join(processed.select("url"), "url", "left_anti")
    frontier = frontier.dropDuplicates(["seed_url", "url"])
    # one row per URL, whether it was fetched: read from the html once, kept narrow
    status = cut_lineage(fetch_status(pages))

    def visit(found: DataFrame, earlier: DataFrame | None) -> DataFrame:
        # narrow (no html) and written: later rounds, the anti join and the final
        # union read it instead of recomputing the rounds before it
        rows = cut_lineage(found)
        return rows if max_pages is None else cut_lineage(within_budget(rows, earlier, max_pages))

    # a crawl without an end may reach every page in as many rounds as it is deep:
    # pages are parsed once, before it, and its rounds read the links alone
    every = (cut_lineage(followed_links(pages, status.where("_fetched = 'inside'"), True))
             if max_level is None and max_pages is None else None)
    visited = visit(classify_links(frontier, status=status), None)
    result, level = visited, 0
    while max_level is None or level < max_level:
        level += 1
        expand = visited.where(F.col("status") == "inside")
        if max_pages is not None:
            expand = expand.where("fetched")
        # each distinct page is parsed once, then its links go to every seed that reached it
        # (the list of them is written: its size says whether it is broadcast to the pages)
        raw = every if every is not None else followed_links(
            pages, cut_lineage(status.join(expand.select("url").distinct(), "url", "left_semi")))
        links = raw.join(expand.select(F.col("url").alias("page_url"), "seed_url", "base"), "page_url")
        nxt = (resolve_relative(links)
               .select("seed_url", "base", F.col("link").alias("url"))
               .dropDuplicates(["seed_url", "url"]))
        if processed is not None:
            nxt = nxt.join(processed.select("url"), "url", "left_anti")
        nxt = nxt.join(result.select("seed_url", "url"), ["seed_url", "url"], "left_anti")
        # one branch: PDF links are reported, never fetched or expanded
        cls = classify_links(nxt.withColumn("level", F.lit(level)), status=status)
        cls = cls.withColumn("status", F.when(F.col("url").contains(".pdf"), F.lit("pdf"))
                             .otherwise(F.col("status")))
        visited = visit(cls, result)
        if max_level is None and visited.isEmpty():
            break
        result = result.unionByName(visited)
    return result.select("seed_url", "base", "url", F.col("level").cast("bigint").alias("level"), "status",
                         *(["fetched"] if max_pages is not None else []))


def crawl_from_seeds(seeds: DataFrame, pages: DataFrame, processed: DataFrame | None = None,
                     max_level: int | None = MAX_LEVEL, max_pages: int | None = None) -> DataFrame:
    """Full add-request: seed validation and seed page, then :func:`crawl`.
    Seed-page PDF links are reported with level 0 and status ``pdf``."""
    sf = seed_frontier(seeds, pages, processed)
    pdf = (sf.where(F.col("route") == "pdf")
           .select("seed_url", "base", "url", F.col("level").cast("bigint").alias("level"),
                   F.lit("pdf").alias("status"), *([F.lit(False).alias("fetched")] if max_pages is not None else [])))
    pages_out = crawl(sf.where(F.col("route") == "page"), pages, processed, max_level, max_pages)
    return pages_out.unionByName(pdf)


def crawl_budget(crawled: DataFrame, max_pages: int = DEFAULT_MAX_PAGES) -> DataFrame:
    """T3 over a finished crawl: fetched pages in discovery order ``(level, url)``
    per seed, first ``max_pages`` kept (Catalyst plans a partial WindowGroupLimit,
    so a seed with many pages never lands whole in one task before the limit)."""
    w = Window.partitionBy("seed_url").orderBy("level", "url")
    return (crawled.where(F.col("status") != "pdf")
            .withColumn("fetch_rank", F.row_number().over(w))
            .where(F.col("fetch_rank") <= max_pages))


def new_links(links: DataFrame, processed: DataFrame, col: str = "url") -> DataFrame:
    """Links not processed in an earlier run."""
    return links.join(processed.select(F.col("url").alias(col)), col, "left_anti")


def processed_union(inside: DataFrame, processed: DataFrame) -> DataFrame:
    """Processed ← inside ∪ processed (a set)."""
    return inside.select("url").union(processed.select("url")).distinct()


def processed_docs(pages: DataFrame, processed: DataFrame) -> DataFrame:
    """Pages whose URL is processed."""
    return pages.join(processed.select("url"), "url", "left_semi")
