"""DuckDB fragments for the oracle strings.  Fixed values (word lists, sizes) are
the Spark code's; link extraction is written here from the rule, so that it
checks the Spark patterns instead of repeating them."""
from __future__ import annotations

from quarry.functions.html import HTML_ENTITIES, html_to_text_sql, sql_lit
from quarry.functions.text import STRIP_PATTERN, TOKEN_PATTERN, WORD_SPLIT
from quarry.functions.urls import AT_MOST_ONCE, BLOCKED_HREF_NEEDLES, MAX_SEED_SLASHES
from quarry.operators.embed import DEFAULT_DIM

__all__ = ["html_to_text_sql", "sql_lit"]


def strip(e: str) -> str:
    return f"regexp_replace({e}, {sql_lit(STRIP_PATTERN)}, '', 'g')"


def clean(e: str) -> str:
    return f"translate({e}, chr(0) || chr(10), 'f')"


def derive_base(l: str) -> str:
    left = f"(instr({l}, '://') - 1)"
    right = f"(length({l}) - instr(reverse({l}), '/'))"
    return (f"(CASE WHEN instr({l}, '/') > 0 THEN substring({l}, 1, {left} + 3) || "
            f"substring({l}, {left} + 4, greatest({right} - {left} - 3, 0)) ELSE {l} END)")


def seed_valid(l: str) -> str:
    return (f"(NOT (NOT suffix({l}, '/') AND "
            f"(length({l}) - length(replace({l}, '/', ''))) > {MAX_SEED_SLASHES}))")


def occurrences(s: str, needle: str) -> str:
    return f"((length({s}) - length(replace({s}, {sql_lit(needle)}, ''))) // {len(needle)})"


def accept(base: str, href: str) -> str:
    conds = [f"{occurrences(f'({base} || {href})', n)} <= 1" for n in AT_MOST_ONCE]
    conds += [f"NOT contains({href}, {sql_lit(n)})" for n in BLOCKED_HREF_NEEDLES]
    return "(" + " AND ".join(conds) + ")"


def normalize(h: str) -> str:
    return f"regexp_replace({h}, '/$', '')"


def absolute(base: str, href: str) -> str:
    return (f"(CASE WHEN NOT prefix({href}, '/') AND NOT coalesce(suffix({base}, '/'), false) "
            f"THEN {base} || '/' || {href} "
            f"WHEN prefix({href}, '/') AND suffix({base}, '/') THEN {base} || substring({href}, 2) "
            f"ELSE {base} || {href} END)")


def route(h: str) -> str:
    return f"(CASE WHEN contains({h}, '.pdf') THEN 'pdf' WHEN contains({h}, 'http') THEN 'page' ELSE 'skip' END)"


def elements(html: str) -> str:
    """A page without comments, scripts and style sheets."""
    out = f"regexp_replace({html}, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in ("script", "style"):
        out = f"regexp_replace({out}, '(?s)<{tag}\\b.*?</{tag}[ \\t\\n\\r\\f]*>', ' ', 'gi')"
    return out


def unquote(raw: str) -> str:
    quoted = f"(prefix({raw}, chr(34)) OR prefix({raw}, chr(39)))"
    out = f"CASE WHEN {quoted} THEN substring({raw}, 2, length({raw}) - 2) ELSE {raw} END"
    for ent, ch in HTML_ENTITIES:
        out = f"replace({out}, {sql_lit(ent)}, {sql_lit(ch)})"
    return out


def extract_links(pages: str = "pages", id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html") -> str:
    """Every href of <a>, then of <link> elements: a tag name, white space, maybe
    other attributes, ``href =`` and a quoted or a bare value."""
    white = "[ \\t\\n\\r\\f]"
    value = "(\"[^\"]*\"|''[^'']*''|[^ \\t\\n\\r\\f>\"'']+)"
    parts = []
    for rank, tag in enumerate(("a", "link")):
        pattern = f"'(?i)<{tag}{white}([^>]*?{white})?href{white}*={white}*{value}'"
        found = f"regexp_extract_all({elements(html_col)}, {pattern}, 2)"
        parts.append(
            f"SELECT {id_col} AS page_id, {url_col} AS page_url, '{tag}' AS tag, CAST({rank} AS BIGINT) AS tag_rank, "
            f"CAST(generate_subscripts({found}, 1) - 1 AS BIGINT) AS pos, unnest({found}) AS raw FROM {pages}")
    u = " UNION ALL ".join(parts)
    return f"SELECT page_id, page_url, tag, tag_rank, pos, {unquote('raw')} AS href FROM ({u})"


def words_bucket(word: str, dim: int = DEFAULT_DIM) -> str:
    return f"((('0x' || substr(md5({word}), 1, 8))::BIGINT) % {dim})"


def sparse_embedding(src: str, key: str, text: str, dim: int = DEFAULT_DIM) -> str:
    """Rows ``key, b, v`` of the default hashed embedder (unit norm)."""
    return f"""(WITH _w AS (SELECT {key} AS k, unnest(regexp_split_to_array(lower({text}), {sql_lit(WORD_SPLIT)})) AS w FROM {src}),
_b AS (SELECT k, {words_bucket('w', dim)} AS b, CAST(count(*) AS DOUBLE) AS c FROM _w WHERE w <> '' GROUP BY ALL),
_n AS (SELECT k, sqrt(sum(c * c)) AS nrm FROM _b GROUP BY k)
SELECT _b.k AS {key}, b, CAST(CAST(c / nrm AS FLOAT) AS DOUBLE) AS v FROM _b JOIN _n USING (k))"""


def token_list(text: str) -> str:
    return f"regexp_extract_all({text}, {sql_lit(TOKEN_PATTERN)}, 0)"
