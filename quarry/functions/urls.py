"""URL and link predicates (P2-P11) and request encoding.

All are plain column expressions, so they run inside whole-stage codegen and
filters built from them can be reordered by Catalyst.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Substrings that make a relative href unacceptable (case-sensitive).
BLOCKED_HREF_NEEDLES = ["pdf", "png", "json", ":", ".ico", ".svg", ".si", "?", "%20", "#"]
# Substrings that may occur at most once in base + href.
AT_MOST_ONCE = ["html", ".com"]
MAX_SEED_SLASHES = 3
# ----------------------------------------------------------------------------


def occurrences(s: Column, needle: str) -> Column:
    """Non-overlapping count of a literal needle (both needles above cannot
    overlap themselves, so this equals the overlapping count)."""
    return F.floor((F.length(s) - F.length(F.replace(s, F.lit(needle), F.lit("")))) / len(needle))


def normalize_href(href: Column) -> Column:
    """Strip one trailing slash; ``/`` becomes empty (dropped by P3)."""
    return F.regexp_replace(href, "/$", "")


def href_present(href: Column) -> Column:
    """P3."""
    return href.isNotNull() & (href != "")


def is_relative(href: Column) -> Column:
    """A followed link may not contain ``http`` anywhere."""
    return ~href.contains("http")


def accept_href(base: Column, href: Column) -> Column:
    """P5: all conditions must hold."""
    joined = F.concat(base, href)
    cond = F.lit(True)
    for needle in AT_MOST_ONCE:
        cond = cond & (occurrences(joined, needle) <= 1)
    for needle in BLOCKED_HREF_NEEDLES:
        cond = cond & ~href.contains(needle)
    return cond


def absolute_link(base: Column, href: Column) -> Column:
    """Join base and href with exactly one slash when both or neither have one."""
    href_slash = href.startswith("/")
    base_slash = F.coalesce(base.endswith("/"), F.lit(False))
    return (F.when(~href_slash & ~base_slash, F.concat(base, F.lit("/"), href))
             .when(href_slash & base_slash, F.concat(base, F.substring(href, 2, 1 << 30)))
             .otherwise(F.concat(base, href)))


def in_scope(link: Column, base: Column) -> Column:
    """The base is a substring of the link."""
    return link.contains(base)


def route(href: Column) -> Column:
    """P8/P9 on the seed page: ``pdf`` wins, then absolute ``page`` links."""
    return (F.when(href.contains(".pdf"), F.lit("pdf"))
             .when(href.contains("http"), F.lit("page"))
             .otherwise(F.lit("skip")))


def derive_base(link: Column) -> Column:
    """P10: keep the scheme separator, cut at the last slash.

    ``left`` is the 0-based position of the first ``://`` (-1 if none) and
    ``right`` the 0-based position of the last ``/``; without a slash the
    whole link is the base.
    """
    left = F.instr(link, "://") - 1
    right = F.length(link) - F.instr(F.reverse(link), "/")
    has_slash = F.instr(link, "/") > 0
    head = F.substring(link, F.lit(1), left + 3)
    tail = F.substring(link, left + 4, F.greatest(right - left - 3, F.lit(0)))
    return F.when(has_slash, F.concat(head, tail)).otherwise(link)


def seed_valid(link: Column) -> Column:
    """Invalid when it does not end in ``/`` and has more than 3 slashes."""
    slashes = F.length(link) - F.length(F.replace(link, F.lit("/"), F.lit("")))
    return ~(~link.endswith("/") & (slashes > MAX_SEED_SLASHES))


def encode_component(s: Column) -> Column:
    """JavaScript ``encodeURIComponent`` on top of Java's form encoder."""
    out = F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))
    for code, ch in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(ch))
    return out


def request_param(url: Column, key: str = "msg") -> Column:
    """First ``key`` parameter of the query string, percent-decoded
    with ``+`` as space; a malformed escape gives null."""
    raw = F.regexp_extract(url, r"[?&]" + key + r"=([^&#]*)", 1)
    present = url.rlike(r"[?&]" + key + r"=")
    return F.when(present, F.try_url_decode(raw))
