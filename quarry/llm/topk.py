"""Exact top-k search by inner product: a Voronoi k-NN join.

Data and queries are grouped by their nearest pivot.  From the summary of a
cell (its radius and its k + 1 nearest members of distinct ids with their
distances to the pivot) follow, for a query q and a member x of cell j with pivot p and distance d:

    q.p - |q| d  <=  q.x  <=  q.p + |q| d

The lower bounds give a score the query's k best are known to reach (members
with the query's own id are left out, however many rows have it); only cells
whose upper bound reaches it receive the query.  Each (cell, query) group is
solved locally and the local bests are ranked.  Both sides of a cell are split
into blocks of bounded size, so neither a cell with a third of the rows nor one
that every query needs is a task of its own.

What the driver holds are the pivots, drawn from a sample of ``SAMPLE`` rows,
and one summary per pivot.

Defined results: vectors that are null or hold a null or non-finite component,
and rows with a null id, take no part.  Vectors of different lengths are
compared as if padded with zeros (an empty vector scores 0 with all).  Rows
that repeat a query's id are one query (the smallest vector) and no candidates
of it; other repeated rows are candidates each.  Ties go to the smaller id.
Components beyond the range of a long saturate.  Empty tables give no rows.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import cut_lineage

SCALE = 1024
PIVOTS = 64
SAMPLE = 2048            # rows the pivots are drawn from
LLOYD_ROUNDS = 4
DATA_BLOCK = 8192        # rows of a cell solved together
QUERY_BLOCK = 2048
SCORES = 1 << 21         # cells of a score matrix held at a time
EXACT = 2.0 ** 52


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """``id, vector`` with vector = floor(scale * component) as longs."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (rows.where(F.col(id_col).isNotNull() & v.isNotNull() & finite)
            .select(F.col(id_col).cast("long").alias("id"),
                    F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale)))).alias("vector")))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as an int64 matrix, shorter ones padded with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    width = int(sizes.max()) if len(sizes) else 0
    if len(sizes) and sizes.min() == width:
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def aligned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    pad = lambda m: m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))
    return pad(a), pad(b)


def distances(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivot of each row and the distance to it."""
    x, pivots = aligned(x.astype(np.float64), pivots)
    cell = np.argmin((pivots ** 2).sum(1) - 2 * (x @ pivots.T), axis=1)
    return cell, np.sqrt(((x - pivots[cell]) ** 2).sum(1))


def choose_pivots(vectors: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Centres of a few Lloyd rounds over the ``sample`` rows of smallest hash."""
    rows = (vectors.select("id", "vector", F.xxhash64("id").alias("h"))
            .orderBy("h", "id", "vector").limit(sample).select("vector").toArrow())
    if not rows.num_rows:
        return np.zeros((1, 0))
    points = matrix(rows.column("vector").combine_chunks()).astype(np.float64)
    points = np.unique(points, axis=0)
    centres = points[np.linspace(0, len(points) - 1, min(pivots, len(points))).astype(int)]
    for _ in range(LLOYD_ROUNDS):
        cell, _far = distances(points, centres)
        for j in np.unique(cell):
            centres[j] = points[cell == j].mean(axis=0)
    return centres


def with_cells(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``id, vector, cell, far, slot``: nearest pivot, distance, place in the task."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for b in batches:
            if b.num_rows:
                cell, far = distances(matrix(b.column(1)), shared.value)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(cell.astype(np.int32)), pa.array(far),
                     pa.array(np.arange(seen, seen + b.num_rows))], names=["id", "vector", "cell", "far", "slot"])
                seen += b.num_rows

    return vectors.mapInArrow(assign, "id long, vector array<long>, cell int, far double, slot long")


def needed_cells(queries: DataFrame, pivots: np.ndarray, members: list[np.ndarray],
                 radius: np.ndarray, k: int, ids: list[np.ndarray] | None = None) -> DataFrame:
    """``id, vector, cells``: the cells that can hold one of the query's k best.
    ``members[j]`` are the smallest distances in cell j, ``ids[j]`` whose they
    are; without ids at most one member is taken to be the query's own."""
    shared = queries.sparkSession.sparkContext.broadcast((pivots, members, radius, ids))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, near, far, whose = shared.value
        filled = np.array([len(m) > 0 for m in near])
        owner = np.repeat(np.arange(len(near)), [len(m) for m in near])
        reach = np.concatenate([*near, np.zeros(0)])
        listed = np.concatenate([np.zeros(0, np.int64), *whose]) if whose is not None else None
        least = k if whose is not None else k + 1
        for b in batches:
            if not b.num_rows:
                continue
            q, p = aligned(matrix(b.column(1)).astype(np.float64), centres)
            norm = np.sqrt((q ** 2).sum(1))[:, None]
            dot = q @ p.T
            slack = 1e-9 * (norm * (np.sqrt((p ** 2).sum(1)) + far) + 1)
            low = dot[:, owner] - norm * reach - slack[:, owner]
            if listed is not None:
                low[b.column(0).to_numpy()[:, None] == listed] = -np.inf
            sure = np.partition(low, low.shape[1] - least, axis=1)[:, [low.shape[1] - least]] \
                if low.shape[1] >= least else np.full((len(q), 1), -np.inf)
            wanted = (dot + norm * far + slack >= sure) & filled
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([np.flatnonzero(w).tolist() for w in wanted],
                                                    type=pa.list_(pa.int32()))], names=["id", "vector", "cells"])

    return queries.mapInArrow(bound, "id long, vector array<long>, cells array<int>")


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; by floating point where that is exact."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(q.shape[1], 1)
    if top < EXACT:
        return np.rint(q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


def solve(k: int):
    """Best k of a block of data for each query of a block."""
    def local(data: pa.Table, queries: pa.Table) -> pa.Table:
        out_q, out_x, out_s = [], [], []
        if data.num_rows and queries.num_rows:
            ids = data.column("id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            x, q = aligned(matrix(data.column("vector").combine_chunks())[order],
                           matrix(queries.column("id_vector").combine_chunks()))
            q_ids = queries.column("query_id").to_numpy()
            step = max(1, SCORES // len(ids))
            for at in range(0, len(q_ids), step):
                scores = exact_scores(q[at:at + step], x)
                for qid, s in zip(q_ids[at:at + step], scores, strict=True):
                    some = np.flatnonzero(ids != qid)
                    if len(some) > k:
                        kth = np.partition(s[some], len(some) - k)[len(some) - k]
                        some = some[s[some] >= kth]
                    some = some[np.argsort(-s[some], kind="stable")[:k]]
                    out_q.append(np.full(len(some), qid))
                    out_x.append(ids[some])
                    out_s.append(s[some])
        join = lambda parts: pa.array(np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64))
        return pa.table({"query_id": join(out_q), "vec_id": join(out_x), "score": join(out_s)})
    return local


def blocks_of(counts: dict[int, int], cells: int, size: int) -> Column:
    """How many blocks of ``size`` the rows of column ``cell`` are cut into."""
    return F.element_at(F.array(*[F.lit(max(1, -(-counts.get(j, 0) // size))) for j in range(cells)]),
                        F.col("cell") + 1)


def top_k(queries: DataFrame, data: DataFrame, k: int = 10, pivots: int = PIVOTS) -> DataFrame:
    """``query_id, rank, vec_id, score`` for integer vectors (``id, vector``)."""
    centres = choose_pivots(data, pivots)
    cells = len(centres)
    placed = cut_lineage(with_cells(data, centres))

    # summaries: at most k + 1 members of distinct ids and two numbers per cell
    nearest = Window.partitionBy("cell").orderBy("far", "id")
    near = (placed.groupBy("cell", "id").agg(F.min("far").alias("far")).withColumn("n", F.row_number().over(nearest))
            .where(F.col("n") <= k + 1).select("cell", "id", "far").collect())
    members = [np.array([r.far for r in near if r.cell == j]) for j in range(cells)]
    ids = [np.array([r.id for r in near if r.cell == j], dtype=np.int64) for j in range(cells)]
    summary = {r.cell: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("r")).collect()}
    radius = np.array([summary[j].r if j in summary else 0.0 for j in range(cells)])

    one_each = queries.groupBy("id").agg(F.min("vector").alias("vector"))
    bound = cut_lineage(needed_cells(one_each, centres, members, radius, k, ids))
    wants = bound.select(F.col("id").alias("query_id"), F.col("vector").alias("id_vector"),
                         F.explode("cells").alias("cell"))
    asked = {r.cell: r["count"] for r in wants.groupBy("cell").count().collect()}

    data_blocks = blocks_of({j: r.n for j, r in summary.items()}, cells, DATA_BLOCK)
    query_blocks = blocks_of(asked, cells, QUERY_BLOCK)
    key = ["cell", "data_block", "query_block"]
    left = (placed.where(F.col("cell").isin(*asked) if asked else F.lit(False))
            .withColumn("data_block", F.pmod(F.xxhash64("id", "slot"), data_blocks).cast("int"))
            .withColumn("query_block", F.explode(F.sequence(F.lit(0), query_blocks - 1)))
            .select(*key, "id", "vector"))
    right = (wants.withColumn("query_block", F.pmod(F.xxhash64("query_id"), query_blocks).cast("int"))
             .withColumn("data_block", F.explode(F.sequence(F.lit(0), data_blocks - 1)))
             .select(*key, "query_id", "id_vector"))
    local = (left.groupBy(*key).cogroup(right.groupBy(*key))
             .applyInArrow(solve(k), "query_id long, vec_id long, score long"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
