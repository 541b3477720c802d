"""Text cleaning expressions (F1-F3) and shared regex fixed values.

Every pattern here is written once and used by the Spark code and by the
DuckDB oracle strings, so both engines see the same rule.  They use only
syntax common to Java regex and RE2 (no look-around, no back-references).
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Characters that Python's str.isspace() accepts (the reference strips with
# str.strip()): ASCII controls 9-13 and 28-31, U+0085 and every Unicode space
# separator (category Z).
WS_CLASS = r"[\t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}]"
STRIP_PATTERN = f"^{WS_CLASS}+|{WS_CLASS}+$"
# Word tokens used by the hashed embedder: runs of letters or digits.
WORD_SPLIT = r"[^\p{L}\p{N}]+"
# Sub-word pieces used by the default tokenizer: an optional leading space and
# a run of letters, of digits or of other visible characters; or a run of
# white space.  The alternatives cover every character, so joining the pieces
# gives the text back.
ASCII_WS = r"[\t\n\x0B\f\r ]"
TOKEN_PATTERN = (r" ?\p{L}+| ?\p{N}+| ?[^\t\n\x0B\f\r \p{L}\p{N}]+|" + ASCII_WS + "+")
# ----------------------------------------------------------------------------


def strip_unicode(col: Column) -> Column:
    """Python ``str.strip()``: Spark's ``trim`` removes only the space char."""
    return F.regexp_replace(col, STRIP_PATTERN, "")


def clean_text(col: Column, newline_replacement: str = "") -> Column:
    """delete (or replace) every newline and turn NUL into ``f``."""
    if newline_replacement == "":
        return F.translate(col, "\x00\n", "f")
    return F.translate(F.regexp_replace(col, "\n", newline_replacement), "\x00", "f")


def collapse_newline_runs(col: Column) -> Column:
    """F3, per-document part: every run of newlines becomes one newline."""
    return F.regexp_replace(col, "\n+", "\n")


def token_pieces(col: Column, size: int) -> Column:
    """A text as pieces of about ``size`` characters, cut only before white space
    that follows something visible: no token of ``TOKEN_PATTERN`` is cut."""
    return F.regexp_extract_all(col, F.lit(f"(?s).{{1,{size}}}{ASCII_WS}*[^{ASCII_WS[1:-1]}]*"), 0)


def token_count(col: Column) -> Column:
    """Number of tokenizer pieces in a text (0 for null)."""
    return F.coalesce(F.size(F.regexp_extract_all(col, F.lit(TOKEN_PATTERN), 0)), F.lit(0))
