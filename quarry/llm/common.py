"""Helpers the training-data operators share."""
from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.session import cut_lineage

# Text bytes handled at a time where a kernel's scratch arrays are a multiple
# of its input; longer texts are cut at a white-space byte and carried on.
PIECE_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select(*columns)


def labels(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet").select(*columns)


def id_crc(id_col: str) -> Column:
    """crc32 of an id written as text (null for a null id)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column's values."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def text_pieces(data: bytes, size: int = PIECE_BYTES) -> Iterator[bytes]:
    """``data`` cut at spaces, tabs and line ends into pieces of about ``size``
    bytes; a longer run without any stays whole."""
    if len(data) <= size:
        yield data
        return
    marks = b" \t\n\v\f\r"
    start = 0
    while start < len(data):
        end = start + size
        if end < len(data):
            found = [at for at in (data.find(bytes([m]), end) for m in marks) if at >= 0]
            end = min(found) if found else len(data)
        yield data[start:end]
        start = end


def sparse_counts(counts: np.ndarray, **constants: int) -> pa.RecordBatch:
    """(constants..., slot, n) rows of the non-zero cells of a count vector."""
    slots = np.flatnonzero(counts)
    columns = {k: pa.array(np.full(len(slots), v, dtype=np.int32)) for k, v in constants.items()}
    columns |= {"slot": pa.array(slots.astype(np.int64)), "n": pa.array(counts[slots].astype(np.int64))}
    return pa.RecordBatch.from_pydict(columns)


def sha256_hex(data: bytes) -> str:
    import hashlib
    return hashlib.sha256(data).hexdigest()


def hashed_words(text: bytes) -> np.ndarray:
    """crc32 of every word of a text, in order, as uint64."""
    parts = []
    for piece in text_pieces(text):
        words = piece.split()
        parts.append(np.fromiter(map(crc32, words), dtype=np.uint64, count=len(words)))
    return np.concatenate(parts)


def ngram_hashes(words: np.ndarray) -> np.ndarray:
    """48-bit hashes of the unigrams and bigrams of hashed words."""
    pairs = words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    return np.concatenate([words * np.uint64(0xD6E8FEB86659FD93), pairs]) >> np.uint64(16)


def ngram_cells(words: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells of a text's n-grams and their counts."""
    return np.unique((ngram_hashes(words) >> np.uint64(8)).astype(np.int64) % cells, return_counts=True)


def labelled(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """``of, label``: one usable label (0 or 1, the smallest given) per id."""
    return (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
            .groupBy(F.col(id_col).alias("of")).agg(F.min(label_col).cast("int").alias("label")))


def sampled_texts(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, most_bytes: int) -> DataFrame:
    """``of, label, text`` for the ids of a bounded sample (``of, label``), written
    out: one row per id, of repeated ids the text with the smallest hash, and in
    the order of the ids' hashes as many as have ``most_bytes`` together.  The
    bounds hold for rows and bytes, however often an id or how long a text is."""
    order = [F.xxhash64(F.col("of").cast("string")), F.col("of")]
    rows = cut_lineage(docs.join(F.broadcast(ids), docs[id_col] == F.col("of"))
                       .groupBy("of", "label").agg(F.min_by(docs[text_col], F.xxhash64(docs[text_col])).alias("text")))
    sizes = rows.select("of", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n"))
    running = F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))      # as many rows as ids
    within = cut_lineage(sizes.select("of", running.alias("total")).where(F.col("total") <= most_bytes).select("of"))
    return rows.join(F.broadcast(within), "of")


def is_remainder(id_col: str, divisor: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves a remainder; false for a null id."""
    return F.coalesce(id_crc(id_col) % divisor == remainder, F.lit(False))
