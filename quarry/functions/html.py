"""HTML → text as a fixed chain of regex rewrites (no Python, no UDF).

The chain approximates an element-based HTML loader: invisible parts go,
block elements become line breaks, inline tags vanish, entities are decoded
(``&amp;`` last so ``&amp;lt;`` stays ``&lt;``), white space is tidied.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NL = "\n"
# --- fixed values: ordered (pattern, replacement) rewrites -------------------
HTML_REWRITES = [
    # script, style and head blocks and comments disappear entirely
    (r"(?is)<script\b.*?</script[ \t\n\r\f]*>|<style\b.*?</style[ \t\n\r\f]*>"
     r"|<head\b.*?</head[ \t\n\r\f]*>|<!--.*?-->", ""),
    # block-level tags (opening or closing) end a line
    (r"(?i)</?(p|div|br|h[1-6]|li|ul|ol|tr|td|th|table|thead|tbody|article|section"
     r"|nav|header|footer|main|aside|blockquote|pre|title|body|html|form|hr)\b[^>]*>", NL),
    # every other tag (inline tags, doctype) is removed
    (r"<[^>]*>", ""),
]
HTML_ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
    ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"),
    ("&amp;", "&"),
]
WHITESPACE_REWRITES = [
    (r"[ \t\r\f\x0B]+", " "),
    (r"( ?\n ?)+", NL),
    (r"^[ \n]+|[ \n]+$", ""),
]
# ----------------------------------------------------------------------------


def html_to_text(col: Column) -> Column:
    out = col
    for pat, rep in HTML_REWRITES:
        out = F.regexp_replace(out, pat, rep)
    for ent, ch in HTML_ENTITIES:
        out = F.replace(out, F.lit(ent), F.lit(ch))
    for pat, rep in WHITESPACE_REWRITES:
        out = F.regexp_replace(out, pat, rep)
    return out


def _sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def html_to_text_sql(expr: str) -> str:
    """DuckDB form of :func:`html_to_text`."""
    out = expr
    for pat, rep in HTML_REWRITES:
        out = f"regexp_replace({out}, {_sql_lit(pat)}, {_sql_lit(rep)}, 'g')"
    for ent, ch in HTML_ENTITIES:
        out = f"replace({out}, {_sql_lit(ent)}, {_sql_lit(ch)})"
    for pat, rep in WHITESPACE_REWRITES:
        out = f"regexp_replace({out}, {_sql_lit(pat)}, {_sql_lit(rep)}, 'g')"
    return out


def sql_lit(s: str) -> str:
    return _sql_lit(s)
