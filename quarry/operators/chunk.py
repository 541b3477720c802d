"""M1: recursive character chunking, size 1000 / overlap 50.

Rule: a text is cut before every occurrence of the first of the separators
(blank line, newline, space, nothing) that it contains.  A piece of ``size``
characters or more is cut again by the separators after that one; runs of
shorter pieces are joined greedily into chunks of at most ``size`` characters,
and a chunk repeats at most ``overlap`` characters of the one before.  Chunks
are stripped of white space and empty ones dropped.

Joining needs no pieces, only their bounds ``b``: a chunk that starts at ``a``
ends at the last bound up to ``a + size``, and the next one starts at the first
bound that leaves at most ``overlap`` characters of it and room for the next
piece.  Both are binary searches, so a text costs time linear in its length
plus a search per chunk, with or without spaces.  Texts are handled in Arrow
batches; chunking never shuffles.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.batches import stretches

# --- fixed values -----------------------------------------------------------
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 50
SEPARATORS = ["\n\n", "\n", " ", ""]
# ----------------------------------------------------------------------------
BYTES_AT_A_TIME = 1 << 21   # of texts whose chunks are made together


def cut_points(text: str, lo: int, hi: int, separator: str) -> np.ndarray:
    """Bounds of the pieces of ``text[lo:hi]``: its ends and every place where a
    separator begins, found left to right without overlap."""
    found, at = [lo], text.find(separator, lo, hi)
    while at >= 0:
        found.append(at)
        at = text.find(separator, at + len(separator), hi)
    bounds = np.array([*found, hi], dtype=np.int64)
    return bounds[np.concatenate([[True], np.diff(bounds) > 0])]


def joined(bounds: np.ndarray, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Chunks over pieces that are all shorter than ``size``."""
    start, end = int(bounds[0]), int(bounds[-1])
    while end - start > size:
        last = int(np.searchsorted(bounds, start + size, side="right")) - 1
        stop, after = int(bounds[last]), int(bounds[last + 1])
        yield start, stop
        start = int(bounds[np.searchsorted(bounds, max(start, stop - overlap, after - size))])
    if end > start:
        yield start, end


def strides(lo: int, hi: int, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Chunks of characters that no separator cuts."""
    step = size - min(overlap, size - 1)
    for start in range(lo, hi, step):
        yield start, min(hi, start + size)
        if start + size >= hi:
            return


def spans(text: str, size: int, overlap: int, lo: int = 0, hi: int | None = None,
          separators: list[str] = SEPARATORS) -> Iterator[tuple[int, int]]:
    """Chunks of ``text[lo:hi]`` as (start, end), before stripping."""
    hi = len(text) if hi is None else hi
    level = next(i for i, s in enumerate(separators) if not s or text.find(s, lo, hi) >= 0)
    if not separators[level]:
        yield from strides(lo, hi, size, overlap)
        return
    bounds = cut_points(text, lo, hi, separators[level])
    first = 0
    for piece in [*np.flatnonzero(np.diff(bounds) >= size).tolist(), len(bounds) - 1]:
        if piece > first:
            yield from joined(bounds[first:piece + 1], size, overlap)
        if piece < len(bounds) - 1:
            yield from spans(text, size, overlap, int(bounds[piece]), int(bounds[piece + 1]), separators[level + 1:])
        first = piece + 1


def split_text(text: str | None, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> list[tuple[int, str]]:
    """[(start, chunk text)] of one text."""
    if not text:
        return []
    out, end = [], 0
    for start, end in spans(text, size, overlap):
        chunk = text[start:end].strip()
        if chunk:
            out.append((start, chunk))
    if end != len(text):
        raise AssertionError("the chunks do not reach the end of the text")
    return out


def chunk_documents(docs: DataFrame, key_cols: list[str], text_col: str = "text",
                    size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Return ``key_cols + [chunk_idx:int, start:int, text:string]``.

    ``start`` is the 0-based character offset of the chunk (before stripping).
    A null or empty text has no chunks.
    """
    rows = docs.select(*key_cols, F.col(text_col).alias("_text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("chunk_idx", T.IntegerType()),
                           T.StructField("start", T.IntegerType()), T.StructField("text", T.StringType())])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stretches(batches, len(names) - 3, BYTES_AT_A_TIME):
            row, place, start, chunk = [], [], [], []
            for i, text in enumerate(b.column(len(names) - 3).to_pylist()):
                for n, (at, part) in enumerate(split_text(text, size, overlap)):
                    row.append(i)
                    place.append(n)
                    start.append(at)
                    chunk.append(part)
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[c.take(take) for c in b.columns[:-1]], pa.array(place, pa.int32()), pa.array(start, pa.int32()),
                 pa.array(chunk, pa.string())], names=names)

    return rows.mapInArrow(run, schema)
