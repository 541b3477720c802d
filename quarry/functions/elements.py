"""S2 by elements: the text of a page from one pass over its markup with a stack
of open elements.

The regex chain of :mod:`quarry.functions.html` stays JVM-side and serves pages
whose markup is regular; this one also knows what is inside what: an invisible
element that is never closed ends with its parent, a paragraph ends where the
next block begins, white space of ``pre`` is kept, a ``>`` inside an attribute
ends nothing, and every character reference of HTML is decoded.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: element names -------------------------------------------------
INVISIBLE = set("script style head template".split())
BLOCKS = set("p div br h1 h2 h3 h4 h5 h6 li ul ol tr td th table thead tbody article section nav header footer main aside "
             "blockquote pre title body html form hr".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
# an opening tag closes the open elements that it cannot be inside of, up to the fence
ENDS = {"p": (set("p".split()), set("div td th body li blockquote section article".split())),
        "li": ({"li"}, {"ul", "ol"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "tr": ({"tr"}, {"table", "thead", "tbody"}), "body": ({"head"}, {"html"}), "option": ({"option"}, {"select"})}
CLOSES_P = BLOCKS - {"br", "title", "body", "html", "td", "th", "tr", "thead", "tbody", "li"}
# ---------------------------------------------------------------------------------
SPACE = re.compile(r"[ \t\r\f\v\xa0]+")
EMPTY_COMMENT = re.compile(r"<!--?-?>")
UNFINISHED = re.compile(r"<[/!]?[a-zA-Z][^<>]*\Z")     # a tag that the page ends in
BREAKS = re.compile(r"( ?\n ?)+")


class PageText(HTMLParser):
    """Pieces of visible text; a line end stands for a block border, and the text
    of ``pre`` is kept as it is."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.pieces: list[tuple[bool, str]] = []
        self.hidden = 0                                  # open invisible elements
        self.kept = 0                                    # open pre elements

    def _close_to(self, place: int) -> None:
        for tag in reversed(self.open[place:]):
            self.hidden -= tag in INVISIBLE
            self.kept -= tag == "pre"
            if tag in BLOCKS and not self.hidden:
                self.pieces.append((False, "\n"))
        del self.open[place:]

    def _close_inner(self, tags: set[str], fence: set[str]) -> None:
        for place in range(len(self.open) - 1, -1, -1):
            if self.open[place] in tags:
                self._close_to(place)
                return
            if self.open[place] in fence:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSES_P:
            self._close_inner(*ENDS["p"])
        if tag in ENDS:
            self._close_inner(*ENDS[tag])
        if tag in BLOCKS and not self.hidden:
            self.pieces.append((False, "\n"))
        if tag not in VOID:
            self.open.append(tag)
            self.hidden += tag in INVISIBLE
            self.kept += tag == "pre"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS and not self.hidden:            # <br/>; other elements have no such form in HTML
            self.pieces.append((False, "\n"))
        if tag not in VOID:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for place in range(len(self.open) - 1, -1, -1):
            if self.open[place] == tag:                  # elements left open inside end with it
                self._close_to(place)
                return

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.pieces.append((bool(self.kept), data))


def page_text(html: str | None) -> str | None:
    """Visible text of a page: lines trimmed, runs of white space are one space,
    no empty lines (``pre`` keeps its own spaces and lines)."""
    if html is None:
        return None
    parser = PageText()
    parser.feed(UNFINISHED.sub("", EMPTY_COMMENT.sub("", html)))
    parser.close()
    out, plain = [], []

    def flush() -> None:
        if plain:
            out.append(BREAKS.sub("\n", SPACE.sub(" ", "".join(plain))))
            plain.clear()

    for kept, text in parser.pieces:
        if kept:
            flush()
            out.append("\x00" + text.replace("\x00", "") + "\x00")
        else:
            plain.append(text.replace("\x00", ""))
    flush()
    # borders of kept stretches: one line end between them and what is around
    text = re.sub(r"[ \n]*\x00\n?|\x00[ \n]*", "\n", "".join(out)) if any(k for k, _ in parser.pieces) else "".join(out)
    return text.strip(" \n")


def element_text(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` without ``html_col`` and with its visible text; a null page has a
    null text.  One narrow Arrow pass."""
    kept = [c for c in pages.columns if c not in (html_col, out_col)]
    rows = pages.select(*kept, F.col(html_col).alias("_html"))
    schema = T.StructType([*[rows.schema[c] for c in kept], T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [page_text(h) for h in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)
