"""J5, approximate: random-projection hash tables, a collision join and exact
re-ranking.  :func:`quarry.operators.knn.knn_join` stays the default.

A table hashes a vector by the sides of ``bits`` random planes through the mean on
which it lies; near vectors collide in some of the tables.  A question also looks
into the buckets across its nearest planes.  Bits follow the rows (a bucket has
about ``BUCKET_ROWS`` of them), so a question meets about ``tables * probes *
BUCKET_ROWS`` rows whatever the size of the index; a bucket that got more is cut
into blocks like a cell of the exact join.  The k best of all collisions by exact
distance are the result: its distances are exact, some neighbours may be missing.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators import knn
from quarry.session import cut_lineage

TABLES = 6
PROBES = 4             # buckets per table that a question looks into
BUCKET_ROWS = 2048
MOST_BITS = 20
MEAN_SAMPLE = 4096
SEED = 7


def planes_for(index: DataFrame, key: str, vec: str, tables: int, bits: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(mean of a bounded sample, unit normals by table and bit)."""
    rows = index.select(vec, F.xxhash64(key).alias("_h"), key).orderBy("_h", key).limit(MEAN_SAMPLE).select(vec).toArrow()
    if not rows.num_rows:
        return None
    points = knn.as_matrix(rows.column(vec))
    normals = np.random.default_rng(SEED).normal(size=(tables, bits, points.shape[1]))
    return points.mean(axis=0), normals / np.linalg.norm(normals, axis=2, keepdims=True)


def buckets(vectors: np.ndarray, mean: np.ndarray, normals: np.ndarray, probes: int) -> np.ndarray:
    """Rows x (tables * probes) bucket numbers: a vector's own, then those across
    its nearest planes, one at a time and the two nearest together."""
    tables, bits, _ = normals.shape
    side = np.einsum("nd,tbd->ntb", vectors - mean, normals)
    powers = 1 << np.arange(bits, dtype=np.int64)
    own = (side > 0) @ powers
    order = np.argsort(np.abs(side), axis=2)
    flips = [np.zeros_like(own)] + [powers[order[:, :, j]] for j in range(min(bits, max(probes - 1, 0)))]
    if probes > 2 and bits > 1:
        flips[2:2] = [flips[1] | flips[2]]           # both nearest planes come before the third
    some = np.stack([own ^ f for f in flips[:probes]], axis=2)
    return (some + (np.arange(tables, dtype=np.int64) << bits)[None, :, None]).reshape(len(vectors), -1)


def _with_buckets(rows: DataFrame, model: tuple[np.ndarray, np.ndarray], probes: int) -> DataFrame:
    """``rows`` (key, vector) once per bucket, as ``_bucket``; written with their list
    of buckets, so that each vector is written and hashed once."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*rows.schema.fields, T.StructField("_buckets", T.ArrayType(T.LongType()))])

    def run(batches):
        for b in batches:
            if b.num_rows:
                found = buckets(knn.as_matrix(b.column(1)), *shared.value, probes)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, found.shape[1]), pa.int32()), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns, lists], names=schema.fieldNames())

    return cut_lineage(rows.mapInArrow(run, schema)).withColumn("_bucket", F.explode("_buckets")).drop("_buckets")


def knn_approximate(questions: DataFrame, index: DataFrame, k: int = 1, q_key: str = "q_id", c_key: str = "chunk_id",
                    q_vec: str = "embedding", c_vec: str = "embedding", tables: int = TABLES, probes: int = PROBES,
                    bits: int | None = None) -> DataFrame:
    """``q_key, c_key, dist, rank`` like the exact join, with most of its rows;
    keys are unique on both sides."""
    rows = index.select(F.col(c_key).alias("_c"), F.col(c_vec).alias("_v")).where(F.col("_v").isNotNull())
    asked = questions.select(F.col(q_key).alias("_q"), F.col(q_vec).alias("_qv")).where(F.col("_qv").isNotNull())
    if bits is None:
        bits = int(np.clip(np.log2(max(1, rows.count()) / BUCKET_ROWS), 1, MOST_BITS))
    model = planes_for(rows, "_c", "_v", tables, bits)
    if model is None:
        schema = T.StructType([asked.schema["_q"], rows.schema["_c"], T.StructField("dist", T.DoubleType())])
        return knn.rank_hits(rows.sparkSession.createDataFrame([], schema), k, q_key, c_key)
    left, right = _with_buckets(rows, model, 1), _with_buckets(asked, model, probes)
    n = lambda frame, size, name: (frame.groupBy("_bucket").agg(F.count("*").alias("_n"))
                                   .select("_bucket", F.ceil(F.col("_n") / size).alias(name)))
    blocks = n(left.select("_bucket"), knn.INDEX_BLOCK, "_rows").join(n(right, knn.QUESTION_BLOCK, "_asks"), "_bucket")
    blocks = cut_lineage(blocks)                     # one row per bucket that both sides have
    left, right = left.join(blocks, "_bucket"), right.join(blocks, "_bucket")
    found = knn.block_join(left, right, "_bucket", F.col("_rows"), F.col("_asks"), k)
    return knn.rank_hits(found.groupBy("_q", "_c").agg(F.min("dist").alias("dist")), k, q_key, c_key)


def recall(approximate: DataFrame, exact: DataFrame, q_key: str = "q_id", c_key: str = "chunk_id") -> DataFrame:
    """One row ``wanted, found``: hits of the exact join, and how many of them the
    approximate one has."""
    pair = [q_key, c_key]
    return (exact.select(*pair).join(approximate.select(*pair, F.lit(1).alias("_hit")), pair, "left")
            .agg(F.count("*").alias("wanted"), F.count("_hit").alias("found")))
