"""The vector index as versioned Parquet folders with a commit table.

A version is a list of folders: a full save has its own, an append has those of
the version before and one more, so adding rows copies nothing.  Data is written
first, then one row is added to the commit table; readers see committed versions
only, and a writer that failed halfway leaves a folder that nobody reads.  One
writer at a time.

* Rows lie in a folder per cell (``cell=``, see ``operators.knn``); centres, radii
  and the smallest distances of each cell are in the commit, so a search prunes
  folders instead of assigning the index again.  An append uses the cells that the
  index has (one, if it began small); ``compact_index`` makes them anew, by the
  rows there are, and leaves one folder.
* A version may replace sources: their names lie in a ``gone`` folder, and rows of
  older folders with such a source are left out when the index is loaded.
* A version may record what it was made from: ``source, hash, fetch`` in a
  ``manifest`` folder, the newest row of a source counts (a null hash: removed).
"""
from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.knn import (CellIndex, NEAR, SAMPLE_PER_CELL, LARGEST_SAMPLE, cell_summary, cells_for, choose_pivots, to_cells)
from quarry.session import shuffles_dropped

INDEX_SCHEMA = T.StructType([
    T.StructField("chunk_id", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("chunk_idx", T.IntegerType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])
STORED_SCHEMA = T.StructType([*INDEX_SCHEMA.fields, T.StructField("far", T.DoubleType()), T.StructField("cell", T.IntegerType())])
MANIFEST_SCHEMA = T.StructType([T.StructField("source", T.StringType()), T.StructField("hash", T.LongType()),
                                T.StructField("fetch", T.LongType())])
CELL = T.StructType([T.StructField("centre", T.ArrayType(T.DoubleType())), T.StructField("radius", T.DoubleType()),
                     T.StructField("size", T.LongType()), T.StructField("near", T.ArrayType(T.DoubleType()))])
COMMIT_SCHEMA = T.StructType([T.StructField("version", T.LongType()),
                              *[T.StructField(c, T.ArrayType(T.StringType())) for c in ("parts", "gone", "manifests")],
                              T.StructField("cells", T.ArrayType(CELL))])
ROWS_CODEC = "zstd"        # texts and vectors take two thirds of what the default leaves
VERSION_OF_FOLDER = r"/(?:gone|manifest)-(\d+)-"


@dataclass
class Commit:
    """What a version consists of."""
    version: int = 0
    parts: list[str] = field(default_factory=list)
    gone: list[str] = field(default_factory=list)
    manifests: list[str] = field(default_factory=list)
    cells: list = field(default_factory=list)


class IndexMissing(RuntimeError):
    """No committed index at the path — there is nothing to answer from."""


def _commits(path: str) -> str:
    return f"{path.rstrip('/')}/commits"


def _committed(spark: SparkSession, path: str, version: int | None = None) -> Commit | None:
    """The newest (or the given) committed version."""
    try:
        rows = spark.read.schema(COMMIT_SCHEMA).parquet(_commits(path))
        if version is not None:
            rows = rows.where(F.col("version") == int(version))
        row = rows.orderBy(F.desc("version")).first()
    except AnalysisException:  # PATH_NOT_FOUND
        return None
    return Commit(row.version, *[list(row[c] or []) for c in ("parts", "gone", "manifests", "cells")]) if row else None


def index_exists(spark: SparkSession, path: str) -> bool:
    return _committed(spark, path) is not None


def committed_version(spark: SparkSession, path: str) -> int:
    """The newest committed version (0: none)."""
    last = _committed(spark, path)
    return last.version if last else 0


def _folder(path: str, kind: str, version: int) -> tuple[str, str]:
    """A new folder: rows lie in ``rows/part=``, so several parts are one table."""
    name = f"rows/part={version}-{uuid.uuid4().hex}" if kind == "rows" else f"{kind}-{version}-{uuid.uuid4().hex}"
    return name, f"{path.rstrip('/')}/{name}"


def _delete(spark: SparkSession, folder: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _centres(cells: list) -> np.ndarray:
    return np.array([c[0] for c in cells], dtype=np.float64) if cells and cells[0][0] is not None else np.zeros((0, 0))


def _merged(cells: list, centres: np.ndarray, sizes: np.ndarray, radius: np.ndarray, near: list[np.ndarray]) -> list[tuple]:
    """Cell summaries with further rows; ``cells`` may be empty."""
    out = []
    for j in range(len(centres)):
        old = cells[j] if cells else None
        low = np.sort(np.concatenate([near[j], np.array(old.near if old else [], dtype=np.float64)]))[:NEAR]
        out.append((centres[j].tolist(), float(max(radius[j], old.radius if old else 0.0)), int(sizes[j] + (old.size if old else 0)),
                    low.tolist()))
    return out


def _write_rows(index: DataFrame, path: str, version: int, cells: list, target: int | None) -> tuple[str, list]:
    """Write rows as a folder of cells: the given ones, or new ones (``target``:
    how many).  Returns the folder and the cells' summaries."""
    spark = index.sparkSession
    name, folder = _folder(path, "rows", version)
    rows = index.select(*INDEX_SCHEMA.fieldNames())
    rows.write.mode("errorifexists").parquet(f"{folder}/cell=0", compression=ROWS_CODEC)
    stored = spark.read.schema(INDEX_SCHEMA).parquet(f"{folder}/cell=0")
    centres = _centres(cells)
    if len(cells) <= 1:                                  # one cell holds all rows and needs no centre
        n = stored.count()
        before = cells[0][2] if cells else 0
        wanted = (target or cells_for(n)) if not before else 1
        if wanted <= 1:
            return name, [(None, 0.0, int(n + before), [])]
        centres = choose_pivots(stored.where("embedding IS NOT NULL"), "chunk_id", "embedding", wanted,
                                min(LARGEST_SAMPLE, SAMPLE_PER_CELL * wanted))
        cells = []
        if len(centres) <= 1:
            return name, [(None, 0.0, int(n), [])]
    name, celled = _folder(path, "rows", version)
    placed = to_cells(stored.where("embedding IS NOT NULL"), "embedding", centres)
    with shuffles_dropped(spark):
        (placed.hint("rebalance", F.col("cell"))           # a large cell is many files, small ones share a task
         .write.partitionBy("cell").parquet(celled, compression=ROWS_CODEC))
    summary = cell_summary(spark.read.schema(STORED_SCHEMA).parquet(celled), len(centres))
    _delete(spark, folder)
    return name, _merged(cells, centres, *summary)


def _commit(spark: SparkSession, path: str, commit: Commit) -> int:
    row = (commit.version, commit.parts, commit.gone, commit.manifests, [tuple(c) for c in commit.cells])
    spark.createDataFrame([row], COMMIT_SCHEMA).coalesce(1).write.mode("append").parquet(_commits(path))
    return commit.version


def save_index(index: DataFrame, path: str, version: int | None = None, cells: int | None = None) -> int:
    """Write ``index`` as a version of its own (default: the next one) and
    commit it; a committed version is never written again.  ``cells``: how many
    (default: by the number of rows)."""
    spark = index.sparkSession
    last = committed_version(spark, path)
    version = last + 1 if version is None else int(version)
    if last and _committed(spark, path, version):
        raise ValueError(f"version {version} is committed at {path}")
    part, summary = _write_rows(index, path, version, [], cells)
    return _commit(spark, path, Commit(version, [part], cells=summary))


def append_index(rows: DataFrame, path: str) -> int:
    """Commit a version with the rows of the newest one and ``rows``; only
    ``rows`` are written."""
    return update_index(rows, path)


def update_index(rows: DataFrame, path: str, gone: DataFrame | None = None, manifest: DataFrame | None = None) -> int:
    """Commit a version on top of the newest one: the older rows of the sources
    ``gone(source)`` are left out, ``rows`` are added, and ``manifest`` (``source,
    hash, fetch``) records what they were made from."""
    spark = rows.sparkSession
    last = _committed(spark, path) or Commit()
    new = Commit(last.version + 1, list(last.parts), list(last.gone), list(last.manifests))
    part, new.cells = _write_rows(rows, path, new.version, last.cells, None)
    new.parts.append(part)
    for kind, frame, names in (("gone", gone, new.gone), ("manifest", manifest, new.manifests)):
        if frame is not None:
            name, folder = _folder(path, kind, new.version)
            frame.select(*(["source"] if kind == "gone" else MANIFEST_SCHEMA.fieldNames())).write.parquet(folder)
            names.append(name)
    if gone is not None:                                 # summaries of the rows that are left
        new.cells = _live_cells(_rows(spark, path, new), _centres(new.cells))
    return _commit(spark, path, new)


def _live_cells(rows: DataFrame, centres: np.ndarray) -> list[tuple]:
    if not len(centres):
        return [(None, 0.0, rows.count(), [])]
    return _merged([], centres, *cell_summary(rows, len(centres)))


def _logged(spark: SparkSession, path: str, names: list[str], schema: T.StructType) -> DataFrame:
    """Rows of gone or manifest folders with the version that wrote them."""
    return (spark.read.schema(schema).parquet(*[f"{path.rstrip('/')}/{n}" for n in names])
            .withColumn("_at", F.regexp_extract(F.col("_metadata.file_path"), VERSION_OF_FOLDER, 1).cast("long")))


def _rows(spark: SparkSession, path: str, found: Commit) -> DataFrame:
    root = path.rstrip("/")
    rows = (spark.read.schema(T.StructType([*STORED_SCHEMA.fields, T.StructField("part", T.StringType())]))
            .option("basePath", f"{root}/rows").parquet(*[f"{root}/{p}" for p in found.parts]))
    if not found.gone:
        return rows
    gone = (_logged(spark, path, found.gone, T.StructType([T.StructField("source", T.StringType())]))
            .groupBy(F.col("source").alias("_source")).agg(F.max("_at").alias("_gone")))
    rows = rows.withColumn("_at", F.substring_index("part", "-", 1).cast("long"))
    return rows.join(gone, (F.col("source") == F.col("_source")) & (F.col("_at") < F.col("_gone")), "left_anti").drop("_at")


def _found(spark: SparkSession, path: str, version: int | None) -> Commit:
    found = _committed(spark, path, version)
    if found is None:
        raise IndexMissing(f"no committed index at {path}")
    return found


def load_index(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Read a committed version (default: the newest)."""
    return _rows(spark, path, _found(spark, path, version)).select(*INDEX_SCHEMA.fieldNames())


def load_cells(spark: SparkSession, path: str, version: int | None = None) -> CellIndex:
    """A committed version with its cells, to be searched (``knn_join``)."""
    found = _found(spark, path, version)
    rows, centres = _rows(spark, path, found), _centres(found.cells)
    sizes = np.array([c.size for c in found.cells], dtype=np.int64)
    if not len(centres):
        return CellIndex(rows, centres, sizes, np.zeros(len(sizes)), [])
    return CellIndex(rows, centres, sizes, np.array([c.radius for c in found.cells]), [np.array(c.near) for c in found.cells])


def load_manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """``source, hash, fetch``: what a version was made from (the newest row of each source)."""
    found = _committed(spark, path, version)
    if found is None or not found.manifests:
        return None
    rows = _logged(spark, path, found.manifests, MANIFEST_SCHEMA)
    newest = rows.groupBy("source").agg(F.max_by(F.struct("hash", "fetch"), F.struct("_at", "fetch")).alias("x"))
    return newest.select("source", "x.hash", "x.fetch")


def compact_index(spark: SparkSession, path: str, cells: int | None = None) -> int:
    """Commit a version with the same rows in one folder and new cells; nothing is
    gone in it and its manifest is one folder."""
    found = _found(spark, path, None)
    new = Commit(found.version + 1)
    part, new.cells = _write_rows(load_index(spark, path), path, new.version, [], cells)
    new.parts = [part]
    known = load_manifest(spark, path)
    if known is not None:
        name, folder = _folder(path, "manifest", new.version)
        known.write.parquet(folder)
        new.manifests = [name]
    return _commit(spark, path, new)
