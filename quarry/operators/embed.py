"""M2: embedding through a pluggable batch interface.

An embedder maps a list of texts to a 2-D float array (one row per text).  It
comes as a :class:`~quarry.operators.hooks.Hook`, built once per Python worker
and fed Arrow batches.  The default is a feature-hashed bag of lower-cased
words, unit-normalised: deterministic, no weights, and exactly reproducible in
SQL (bucket = first 8 hex digits of md5(word) mod dim).  It is a lexical
stand-in for a neural sentence encoder, not a claim of its quality.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import WORD_SPLIT
from quarry.operators.hooks import Hook, built

# --- fixed values -----------------------------------------------------------
DEFAULT_DIM = 256
# ----------------------------------------------------------------------------


def word_buckets(text: Column, dim: int = DEFAULT_DIM) -> Column:
    """Buckets of a text's words, repeats included (empty for null)."""
    words = F.filter(F.split(F.lower(text), WORD_SPLIT), lambda w: w != "")
    bucket = lambda w: (F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("long") % dim).cast("int")
    return F.coalesce(F.transform(words, bucket), F.array().cast("array<int>"))


def vectors_array(matrix: np.ndarray) -> pa.Array:
    """A matrix as a list<float> column, without per-element conversion."""
    n, d = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n + 1, dtype=np.int32) * d),
                                    pa.array(np.ascontiguousarray(matrix, dtype=np.float32).ravel()))


def hashed_vectors(buckets: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors of bucket counts (zero if there is no word)."""
    sizes = np.diff(buckets.offsets.to_numpy())
    flat = buckets.flatten().to_numpy(zero_copy_only=False)
    cells = np.repeat(np.arange(len(sizes), dtype=np.int64) * dim, sizes) + flat
    counts = np.bincount(cells, minlength=len(sizes) * dim).astype(np.float64).reshape(len(sizes), dim)
    norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
    return np.divide(counts, norms, out=counts, where=norms > 0)


def embed(df: DataFrame, text_col: str = "text", out_col: str = "embedding",
          embedder: Hook | None = None, dim: int = DEFAULT_DIM) -> DataFrame:
    """Add ``out_col: array<float>``.  Narrow; the default embedder's hashing runs
    in the JVM and only the counting in Python."""
    kept = df.drop(out_col)
    source = word_buckets(F.col(text_col), dim) if embedder is None else F.col(text_col)
    rows = kept.withColumn("_embed", source)
    schema = T.StructType([*kept.schema.fields, T.StructField(out_col, T.ArrayType(T.FloatType()))])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            given = b.column(len(names) - 1)
            if embedder is None:
                matrix = hashed_vectors(given, dim)
            else:
                matrix = np.asarray(built(embedder)(given.to_pylist()), dtype=np.float32).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], vectors_array(matrix)], names=names)

    return rows.mapInArrow(run, schema)
