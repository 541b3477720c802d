"""Link extraction and link predicates over a pages table."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.html import HTML_ENTITIES
from quarry.functions import urls as U

# --- fixed values -----------------------------------------------------------
_WS = r"[ \t\n\r\f]"
_VALUE = r"(\"[^\"]*\"|'[^']*'|[^ \t\n\r\f>\"']+)"
# href of <a> elements and of <link> elements; <a> elements come first
LINK_TAGS = ["a", "link"]
UNQUOTE_PATTERN = "^[\"']|[\"']$"
# text that holds no elements: comments, scripts and style sheets
OPAQUE_PATTERN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
# ----------------------------------------------------------------------------


def tag_href_pattern(tag: str) -> str:
    return rf"(?i)<{tag}{_WS}(?:[^>]*?{_WS})?href{_WS}*={_WS}*{_VALUE}"


def unquote_href(raw):
    """Remove the quotes of a quoted value and decode entities (``&amp;`` last)."""
    out = F.regexp_replace(raw, UNQUOTE_PATTERN, "")
    for ent, ch in HTML_ENTITIES:
        out = F.replace(out, F.lit(ent), F.lit(ch))
    return out


def extract_links(pages: DataFrame, url_col: str = "url", html_col: str = "html",
                  id_col: str = "page_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """``page_id, page_url, tag, tag_rank, pos, href`` — every <a> href in
    document order, then every <link> href; tags inside comments, scripts and
    style sheets are text, not elements.  One pass over the HTML (the per-tag
    lists are concatenated and exploded once), no shuffle.  ``carry`` names
    further columns of the page to keep."""
    html = F.regexp_replace(F.col(html_col), OPAQUE_PATTERN, " ")
    def tagged(tag, rank):
        return lambda raw, i: F.struct(F.lit(tag).alias("tag"), F.lit(rank).alias("tag_rank"),
                                       i.alias("pos"), raw.alias("raw"))

    per_tag = [F.transform(F.regexp_extract_all(html, F.lit(tag_href_pattern(tag)), 1), tagged(tag, rank))
               for rank, tag in enumerate(LINK_TAGS)]
    return (pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("page_url"), *carry,
                         F.explode(F.concat(*per_tag)).alias("_l"))
            .select("page_id", "page_url", *carry, F.col("_l.tag").alias("tag"), F.col("_l.tag_rank").alias("tag_rank"),
                    F.col("_l.pos").alias("pos"), unquote_href(F.col("_l.raw")).alias("href")))


def distinct_links(links: DataFrame) -> DataFrame:
    """A1: the distinct hrefs of each page (a set)."""
    return links.select("page_url", "href").dropDuplicates(["page_url", "href"])


def normalized_links(links: DataFrame) -> DataFrame:
    """P2+P3: strip one trailing slash, drop null/empty."""
    return (links.withColumn("href", U.normalize_href(F.col("href")))
            .where(U.href_present(F.col("href"))))


def resolve_relative(links: DataFrame, base_col: str = "base") -> DataFrame:
    """P4-P7 on normalized links: relative only, accepted, made absolute, in scope."""
    b, h = F.col(base_col), F.col("href")
    return (links.where(U.is_relative(h) & U.accept_href(b, h))
            .withColumn("link", U.absolute_link(b, h))
            .where(U.in_scope(F.col("link"), b)))
