"""Exact nearest-neighbour retrieval.

Exact k-NN under squared L2 (the reference searches a flat index), as a join on
cells.  Index rows belong to the cell of their nearest pivot; by the triangle
inequality a question at distance g from a pivot can have a neighbour within r
only in cells with g - (cell radius) <= r.  r comes from the cells' summaries: the
distances of the rows nearest to each pivot bound the question's k-th distance
from above.  Rows are packed into pieces of bounded size, questions into blocks that
want about the same cells, and each pair of them that can matter is solved:

* cells are made once: a saved index has a folder per cell and the summaries in
  its commit (``sources.index_store``), so a search assigns its questions only and
  reads the wanted cells only.  A plain frame is put into cells on the way;
* the number of cells follows the rows (``CELL_ROWS`` each, at most ``MOST_CELLS``);
  an index of one cell needs no pivots, no summary and no assignment;
* no question passes through the driver, which holds the pivots (drawn from a
  bounded sample) and one summary per pivot;
* the pairs are dealt as a grid: a task takes a share of the pieces and a share of the
  blocks, packed, and unpacks one of each at a time.  Shares are large (``SHARE_ROWS``
  on either side) and the grid follows the cores until they are full, so both sides
  are shuffled a few times, not once per pair of blocks;
* a task carries the k best rows of its questions along; what is farther is not
  measured.  It emits them at its end: k rows per question and share of the pieces;
* a pair is screened in single precision, in tiles that stay in the cache: what is
  within the rounding error of the k best goes through the double precision that
  ranks and is reported.

Ties are broken by the chunk key; distances are ranked rounded to
``RANK_DECIMALS`` so both engines agree on exact duplicates, and reported
unrounded (squared L2, clamped at 0).
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarry.session import cut_lineage

# --- fixed values -----------------------------------------------------------
RANK_DECIMALS = 9
# ----------------------------------------------------------------------------
CELL_ROWS = 8192           # rows of a cell, on average
MOST_CELLS = 4096
SAMPLE_PER_CELL = 32       # rows the pivots are drawn from
LARGEST_SAMPLE = 16384
NEAR = 16                  # smallest distances kept per cell
INDEX_BLOCK = 16384        # index rows that are packed, or solved in a block, together
QUESTION_BLOCK = 16384
PIECE_BYTES = 1 << 22      # vectors of a piece of the index
ASKED_BYTES = 1 << 24      # vectors of a block of questions
HELD_BYTES = 1 << 26       # vectors of question blocks that a task keeps unpacked
SHARE_ROWS = 1 << 18       # rows of either side that a task takes
TASKS_PER_CORE = 4         # of the grid, until shares are full
PACKED_ROW, PACKED_QUESTION, HIT = 400, 140, 80    # bytes that a row, a question and a hit take in a shuffle, about
CELLS_AT_A_TIME = 1 << 21  # cells of a distance matrix
SCREENED_AT_A_TIME = 1 << 20  # cells of a matrix in single precision
SCREEN_COLUMNS = 32        # index rows whose best stands for them when the k-th best is bounded
LARGEST_SCREENED = 1e15    # squares and products of shorter vectors are finite in single precision
PAIRS_AT_A_TIME = 1 << 14  # pairs that are gathered and measured together
MOST_SCREENED = 16         # a screening that leaves over 1 in so many is no gain (copies, say)
FEW_SCREENED = 4           # times k: more than so many per question are bounded by the k-th best of their tile
MOSTLY = 0.5               # a cell that more of a block's questions want is searched for all of them


@dataclass
class CellIndex:
    """Index rows with a ``cell`` column, and what is known of each cell."""
    rows: DataFrame
    centres: np.ndarray      # one row per cell; none for an index of one cell
    sizes: np.ndarray
    radius: np.ndarray
    near: list[np.ndarray]   # the smallest distances to the centre

    @property
    def cells(self) -> int:
        return len(self.sizes)


def as_rows(col: pa.Array) -> np.ndarray:
    """A column of vectors as a matrix in its own precision."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    flat = col.flatten().to_numpy(zero_copy_only=False)
    if n and flat.size % n:
        raise ValueError("vectors of different lengths")
    return flat.reshape(n, flat.size // n if n else 0)


def as_matrix(col: pa.Array) -> np.ndarray:
    return as_rows(col).astype(np.float64, copy=False)


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    if x.shape[1] != y.shape[1]:
        raise ValueError(f"vectors of {x.shape[1]} and of {y.shape[1]} dimensions")
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2.0 * (x @ y.T), 0.0)


def choose_pivots(index: DataFrame, key: str, vec: str, pivots: int, sample: int) -> np.ndarray:
    """Distinct vectors of the ``sample`` rows whose keys have the smallest hash."""
    rows = (index.select(vec, F.xxhash64(key).alias("_h"), key).orderBy("_h", key).limit(sample).select(vec).toArrow())
    points = np.unique(as_matrix(rows.column(vec)), axis=0)
    return points[np.linspace(0, len(points) - 1, min(pivots, len(points))).astype(int)] if len(points) else points


def cells_for(rows: int) -> int:
    return max(1, min(MOST_CELLS, rows // CELL_ROWS))


def to_cells(index: DataFrame, vec: str, centres: np.ndarray) -> DataFrame:
    """``index`` with ``cell`` (the nearest pivot) and ``far`` (the distance to it)."""
    shared = index.sparkSession.sparkContext.broadcast(centres)
    place = index.columns.index(vec)
    schema = T.StructType([*index.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType())])

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            vectors = as_matrix(b.column(place))
            cell, far = np.empty(b.num_rows, dtype=np.int32), np.empty(b.num_rows)
            step = max(1, CELLS_AT_A_TIME // len(shared.value))
            for at in range(0, b.num_rows, step):
                d = squared_distances(vectors[at:at + step], shared.value)
                cell[at:at + step] = d.argmin(axis=1)
                far[at:at + step] = np.sqrt(d.min(axis=1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(far)], names=schema.fieldNames())

    return index.mapInArrow(run, schema)


def cell_summary(placed: DataFrame, cells: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(sizes, radius, near) of the cells, in one job over (cell, far)."""
    first = Window.partitionBy("cell").orderBy("far")
    near = (placed.select("cell", "far").withColumn("n", F.row_number().over(first)).where(F.col("n") <= NEAR)
            .select("cell", "far", F.lit(0).cast("long").alias("n")))
    whole = placed.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).select("cell", "far", "n")
    sizes, radius, low = np.zeros(cells, np.int64), np.zeros(cells), [[] for _ in range(cells)]
    for r in near.unionByName(whole).collect():             # NEAR + 1 numbers per cell
        if r.n:
            sizes[r.cell], radius[r.cell] = r.n, r.far
        else:
            low[r.cell].append(r.far)
    return sizes, radius, [np.sort(np.array(x)) for x in low]


def in_cells(index: DataFrame, key: str, vec: str, pivots: int | None = None, sample: int | None = None) -> CellIndex:
    """Put a plain frame into cells; rows without a vector take no part."""
    rows = index.where(F.col(vec).isNotNull())
    if pivots is None:
        n = rows.count()
        pivots = cells_for(n)
        if pivots == 1:
            return CellIndex(rows.withColumn("cell", F.lit(0)), np.zeros((0, 0)), np.array([n]), np.zeros(1), [])
    centres = choose_pivots(rows, key, vec, pivots, sample or min(LARGEST_SAMPLE, SAMPLE_PER_CELL * pivots))
    if not len(centres):
        return CellIndex(rows.withColumn("cell", F.lit(0)), centres, np.zeros(0, np.int64), np.zeros(0), [])
    placed = cut_lineage(to_cells(rows, vec, centres))
    return CellIndex(placed, centres, *cell_summary(placed, len(centres)))


def _wanted_cells(questions: DataFrame, index: CellIndex, k: int) -> DataFrame:
    """``_q, _qv, _cells``: the cells that can hold one of the k nearest."""
    # rows known to be near: the kept distances, and the rest of a cell within its radius
    owner = np.repeat(np.arange(index.cells), [len(x) + 1 for x in index.near])
    low = np.concatenate([np.append(x, r) for x, r in zip(index.near, index.radius, strict=True)])
    weight = np.concatenate([np.append(np.ones(len(x), np.int64), n - len(x)) for x, n in zip(index.near, index.sizes, strict=True)])
    kept = weight > 0
    shared = questions.sparkSession.sparkContext.broadcast((index.centres, owner[kept], low[kept], weight[kept], index.radius, index.sizes > 0))
    schema = T.StructType([*questions.schema.fields, T.StructField("_cells", T.ArrayType(T.IntegerType()))])

    def run(batches):
        pivots, own, near, many, far, full = shared.value
        step = max(1, CELLS_AT_A_TIME // max(1, len(own)))
        for b in batches:
            vectors = as_matrix(b.column(1)) if b.num_rows else None
            cells, many_cells = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
            for at in range(0, b.num_rows, step):
                to_pivot = np.sqrt(squared_distances(vectors[at:at + step], pivots))
                bound = to_pivot[:, own] + near
                order = np.argsort(bound, axis=1)
                enough = np.cumsum(many[order], axis=1) >= k
                first = order[np.arange(len(order)), enough.argmax(axis=1)]
                reach = np.where(enough.any(axis=1), bound[np.arange(len(order)), first], np.inf)
                slack = 1e-6 * (1.0 + to_pivot + far)
                wanted = (to_pivot - far - slack <= reach[:, None]) & full
                cells.append(np.nonzero(wanted)[1].astype(np.int32))
                many_cells.append(wanted.sum(axis=1))
            ends = np.cumsum(np.concatenate(many_cells)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(cells)))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=schema.fieldNames())

    return questions.mapInArrow(run, schema)


def nearest_columns(ranked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k smallest values of every row, ties to the first
    column, by row and rank."""
    rows = np.arange(len(ranked))
    if ranked.shape[1] > k:
        limit = np.partition(ranked, k - 1, axis=1)[:, k - 1]
        row, column = np.nonzero(ranked <= limit[:, None])
    else:
        row, column = np.repeat(rows, ranked.shape[1]), np.tile(np.arange(ranked.shape[1]), len(rows))
    order = np.lexsort((column, ranked[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, rows)[row]
    return row[place < k], column[place < k]


def _kth_best(score: np.ndarray, k: int) -> np.ndarray:
    """A value per row that its k highest scores reach; none (-inf) in a narrow matrix."""
    wide = score.shape[1] // SCREEN_COLUMNS * SCREEN_COLUMNS
    if score.shape[1] < k:
        return np.full(len(score), -np.inf)
    if wide // SCREEN_COLUMNS >= k:                          # k rows are as good as the k-th best of the groups' bests
        score = score[:, :wide].reshape(len(score), -1, SCREEN_COLUMNS).max(axis=2)
    return np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]


def _below(score: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Single precision numbers below ``score`` by ``room`` at least."""
    return np.nextafter((score - room).astype(np.float32), np.float32(-np.inf))


class _Asked:
    """Questions with what every piece of the index needs of them."""
    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.norm = _norms(vectors)
        self.usable = not len(vectors) or bool(np.sqrt(self.norm.max()) < LARGEST_SCREENED)     # false for NaN
        self.quick = np.empty((len(vectors), vectors.shape[1] + 1), np.float32)
        if self.usable:
            self.quick[:, :-1], self.quick[:, -1] = vectors, -1.0


def _norms(vectors: np.ndarray) -> np.ndarray:
    step = max(1, CELLS_AT_A_TIME // max(1, vectors.shape[1]))
    return np.concatenate([np.zeros(0), *(np.square(vectors[at:at + step], dtype=np.float64).sum(axis=1) for at in range(0, len(vectors), step))])


def _exactly(asked: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, column, squared distance) of the k nearest, from the whole matrix, some rows at a time."""
    step, vectors = max(1, CELLS_AT_A_TIME // len(vectors)), vectors.astype(np.float64, copy=False)
    for at in range(0, len(asked), step):
        dist = squared_distances(asked[at:at + step].astype(np.float64, copy=False), vectors)
        row, column = nearest_columns(np.round(dist, RANK_DECIMALS), k)
        yield at + row, column, dist[row, column]


def _nearest(asked: np.ndarray | _Asked, vectors: np.ndarray, k: int,
             reach: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of ``asked``, row of ``vectors``, squared distance) of the k nearest, ties
    to the first, some rows at a time.  Rows farther than ``reach`` (rounded, per
    question) may be left out."""
    asked = asked if isinstance(asked, _Asked) else _Asked(asked)
    if asked.vectors.shape[1] != vectors.shape[1]:
        raise ValueError(f"vectors of {vectors.shape[1]} and of {asked.vectors.shape[1]} dimensions")
    if not len(asked.vectors) or not len(vectors):
        return
    norm = _norms(vectors)
    largest = np.sqrt(norm.max())
    if len(vectors) <= k or not (asked.usable and largest < LARGEST_SCREENED):
        yield from _exactly(asked.vectors, vectors, k)
        return
    quick = np.empty((len(vectors), vectors.shape[1] + 1), np.float32)     # the product with (question, -1) is the score: the higher, the nearer
    quick[:, :-1], quick[:, -1] = vectors, norm / 2
    unit = float(np.finfo(np.float32).eps) * (vectors.shape[1] + 8)
    slack = unit * largest * (np.sqrt(asked.norm) + largest) + 10.0 ** -RANK_DECIMALS     # scores are off by less
    limit = np.full(len(asked.norm), -np.inf) if reach is None else (asked.norm - reach) / 2
    step = min(len(limit), max(1, int(np.sqrt(SCREENED_AT_A_TIME))))
    width = min(len(vectors), max(1, SCREENED_AT_A_TIME // step))
    space = np.empty(step * width, np.float32)
    for at in range(0, len(limit), step):
        some = asked.vectors[at:at + step]
        held, held_dist = np.full((len(some), k), -1), np.full((len(some), k), np.inf)
        for begin in range(0, len(vectors), width):
            part = vectors[begin:begin + width]
            score = np.matmul(asked.quick[at:at + step], quick[begin:begin + width].T, out=space[:len(some) * len(part)].reshape(len(some), len(part)))
            best, room = score.max(axis=1), 2 * slack[at:at + step]
            low = _below(np.maximum(limit[at:at + step], best) if k == 1 else limit[at:at + step], room)
            rows = np.flatnonzero(best >= low)
            if not len(rows):
                continue
            score = score if len(rows) == len(some) else score[rows]
            near = score >= low[rows, None]
            if k > 1 and np.count_nonzero(near) > FEW_SCREENED * k * len(rows):     # what was met before is far from these questions
                near = score >= np.maximum(low[rows], _below(_kth_best(score, k), room[rows]))[:, None]
            if np.count_nonzero(near) > max(near.size // MOST_SCREENED, k * len(rows)):
                row, column, dist = (np.concatenate(x) for x in zip(*_exactly(some[rows], part, k), strict=True))
            else:
                row, column = np.divmod(np.flatnonzero(near), len(part))
                dist = _measured(some[rows], asked.norm[at + rows], part, norm[begin:begin + width], row, column)
            # the k best of the rows concerned, of these and those held before
            old, rank = np.nonzero(held[rows] >= 0)
            row, column, dist = (np.concatenate(x) for x in ((old, row), (held[rows[old], rank], begin + column), (held_dist[rows[old], rank], dist)))
            order = np.lexsort((column, np.round(dist, RANK_DECIMALS), row))
            row, column, dist = row[order], column[order], dist[order]
            place = np.arange(len(row)) - np.searchsorted(row, np.arange(len(rows)))[row]
            row, column, dist, place = (x[place < k] for x in (row, column, dist, place))
            held[rows[row], place], held_dist[rows[row], place] = column, dist
            limit[at + rows] = np.maximum(limit[at + rows], (asked.norm[at + rows] - np.round(held_dist[rows, -1], RANK_DECIMALS)) / 2)
        row, rank = np.nonzero(held >= 0)
        yield at + row, held[row, rank], held_dist[row, rank]


def _measured(asked: np.ndarray, asked_norm: np.ndarray, vectors: np.ndarray, norm: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Squared distances of pairs, in double precision."""
    return np.concatenate([np.zeros(0), *(
        np.maximum(asked_norm[r] + norm[c] - 2.0 * (asked[r].astype(np.float64, copy=False) * vectors[c]).sum(axis=1), 0.0)
        for r, c in ((row[i:i + PAIRS_AT_A_TIME], column[i:i + PAIRS_AT_A_TIME]) for i in range(0, len(row), PAIRS_AT_A_TIME)))])


def _solve(k: int):
    """k nearest rows of an index block for each question of a block."""
    def run(index: pa.Table, questions: pa.Table) -> pa.Table:
        if index.num_rows and questions.num_rows:
            index = index.sort_by("_c")
            keys, ids = index.column("_c").combine_chunks(), questions.column("_q").combine_chunks()
            q, c, d = (np.concatenate(x) for x in zip(*_nearest(as_rows(questions.column("_qv")), as_rows(index.column("_v")), k), strict=True))
            return pa.table({"_q": ids.take(pa.array(q)), "_c": keys.take(pa.array(c)), "dist": pa.array(d)})
        none = pa.array([], pa.float64())
        return pa.table({"_q": questions.column("_q").slice(0, 0), "_c": index.column("_c").slice(0, 0), "dist": none})
    return run


def block_join(rows: DataFrame, wants: DataFrame, cell: str, row_blocks: Column, question_blocks: Column, k: int) -> DataFrame:
    """``_q, _c, dist``: the k nearest rows of every block pair.  ``rows`` (_c, _v)
    and ``wants`` (_q, _qv) meet in their ``cell``, which is cut into blocks."""
    out_schema = T.StructType([wants.schema["_q"], rows.schema["_c"], T.StructField("dist", T.DoubleType())])
    salt = ["_slot"] if "_slot" in rows.columns else []
    key = [cell, "_index_block", "_question_block"]
    left = (rows.withColumn("_index_block", F.pmod(F.xxhash64("_c", *salt), row_blocks).cast("int"))
            .withColumn("_question_block", F.explode(F.sequence(F.lit(0), question_blocks.cast("int") - 1))).select(*key, "_c", "_v"))
    right = (wants.withColumn("_question_block", F.pmod(F.xxhash64("_q"), question_blocks).cast("int"))
             .withColumn("_index_block", F.explode(F.sequence(F.lit(0), row_blocks.cast("int") - 1))).select(*key, "_q", "_qv"))
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_solve(k), out_schema)


def pack(x: np.ndarray) -> bytes:
    """A matrix as bytes; one with many zeros as a bit per value and the others."""
    some = x != 0
    few = np.count_nonzero(some) * x.itemsize + x.size // 8 < x.nbytes
    head = np.array([*x.shape, ord(x.dtype.char), few], np.int64)
    return head.tobytes() + (np.packbits(some).tobytes() + x[some].tobytes() if few else x.tobytes())


def unpack(data) -> np.ndarray:
    rows, dim, kind, few = (int(n) for n in np.frombuffer(data, np.int64, 4))
    if not few:
        return np.frombuffer(data, chr(kind), offset=32).reshape(rows, dim)
    bits = np.frombuffer(data, np.uint8, -(-rows * dim // 8), 32)
    out = np.zeros(rows * dim, chr(kind))
    out[np.unpackbits(bits, count=rows * dim).view(bool)] = np.frombuffer(data, chr(kind), offset=32 + len(bits))
    return out.reshape(rows, dim)


def _gathered(batches: Iterator[pa.RecordBatch], vec: int, rows: int, size: int) -> Iterator[pa.Table]:
    """The rows of all batches as tables of at most ``rows`` rows, and ``size`` bytes of vectors."""
    held, n = [], 0
    for b in batches:
        at = 0
        while at < b.num_rows:
            vector = as_rows(b.column(vec).slice(at, 1))
            most = max(1, min(rows, size // max(1, vector.nbytes)))
            held.append(b.slice(at, max(1, most - n)))
            n, at = n + held[-1].num_rows, at + held[-1].num_rows
            if n >= most:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _one_list(values: pa.Array | pa.ChunkedArray) -> pa.Array:
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _index_pieces(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` (_c, _v, _cell) packed: ``_cells`` (those it has), ``_cell`` (of each
    row), ``_keys`` and ``_vectors`` of a piece, in the order of the keys, and ``_piece``."""
    size = PIECE_BYTES
    schema = T.StructType([T.StructField("_cells", T.ArrayType(T.IntegerType())), T.StructField("_cell", T.BinaryType()),
                           T.StructField("_keys", T.ArrayType(rows.schema["_c"].dataType)), T.StructField("_vectors", T.BinaryType()),
                           T.StructField("_piece", T.LongType())])

    def run(batches):
        task = TaskContext.get().partitionId()
        for i, t in enumerate(_gathered(batches, 1, most, size)):
            t = t.sort_by("_c")
            cell = t.column("_cell").to_numpy().astype(np.int32)
            yield pa.RecordBatch.from_arrays([_one_list(pa.array(np.unique(cell))), pa.array([cell.tobytes()], pa.binary()), _one_list(t.column("_c")),
                                              pa.array([pack(as_rows(t.column("_v")))], pa.binary()), pa.array([task + i])], names=schema.fieldNames())

    return rows.select("_c", "_v", "_cell").mapInArrow(run, schema)


def _with_bits(wants: DataFrame, cells: int) -> DataFrame:
    """``wants`` (_q, _qv, _cells) with the wanted cells as a bit each, ``_wanted``."""
    schema = T.StructType([*wants.schema.fields[:2], T.StructField("_wanted", T.BinaryType())])

    def run(batches):
        for b in batches:
            lists = b.column(2)
            mine = np.zeros((b.num_rows, cells), bool)
            mine[np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy(zero_copy_only=False)] = True
            bits = np.packbits(mine, axis=1)
            ends = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * bits.shape[1])
            wanted = pa.BinaryArray.from_buffers(pa.binary(), b.num_rows, [None, ends.buffers()[1], pa.py_buffer(bits.tobytes())])
            yield pa.RecordBatch.from_arrays([*b.columns[:2], wanted], names=schema.fieldNames())

    return wants.mapInArrow(run, schema)


def _question_blocks(wants: DataFrame, cells: int, most: int) -> DataFrame:
    """``wants`` (_q, _qv, _wanted) packed: ``_block`` (its number), ``_asking`` (the
    cells that any of its questions wants), ``_wanted``, ``_ids`` and ``_asked``."""
    size = ASKED_BYTES
    schema = T.StructType([T.StructField("_block", T.LongType()), T.StructField("_asking", T.ArrayType(T.IntegerType())),
                           T.StructField("_wanted", T.BinaryType()), T.StructField("_ids", T.ArrayType(wants.schema["_q"].dataType)),
                           T.StructField("_asked", T.BinaryType())])

    def run(batches):
        task = TaskContext.get().partitionId()
        for i, t in enumerate(_gathered(batches, 1, most, size)):
            bits = b"".join(t.column("_wanted").to_pylist())
            mine = _wanted(bits, t.num_rows, cells)
            yield pa.RecordBatch.from_arrays([pa.array([task + (i << 32)]), _one_list(pa.array(np.flatnonzero(mine.any(axis=0)).astype(np.int32))),
                                              pa.array([bits], pa.binary()), _one_list(t.column("_q")),
                                              pa.array([pack(as_rows(t.column("_qv")))], pa.binary())], names=schema.fieldNames())

    return wants.mapInArrow(run, schema)


def _wanted(bits: bytes, rows: int, cells: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8).reshape(rows, -1), axis=1, count=cells).view(bool)


class _Found:
    """The k best rows of a block's questions so far."""
    def __init__(self, ids: pa.Array):
        self.ids, self.best, self.reach = ids, None, np.full(len(ids), np.inf)

    def add(self, row: np.ndarray, key: pa.Array, dist: np.ndarray, k: int) -> None:
        if not len(row):
            return
        t = pa.table({"row": row, "rounded": np.round(dist, RANK_DECIMALS), "key": key, "dist": dist})
        t = t if self.best is None else pa.concat_tables([self.best, t])
        t = t.sort_by([("row", "ascending"), ("rounded", "ascending"), ("key", "ascending")])
        row = t.column("row").to_numpy()
        place = np.arange(len(row)) - np.searchsorted(row, np.arange(len(self.ids)))[row]
        self.best = t.filter(pa.array(place < k)).combine_chunks()
        last = np.flatnonzero(place == k - 1)
        reach = t.column("rounded").to_numpy()[last]
        self.reach[row[last]] = np.where(np.isnan(reach), np.inf, reach)


def _solve_pairs(k: int, cells: int, schema: pa.Schema):
    """The k nearest rows of a task's pieces for the questions of its blocks."""
    def run(index: pa.Table, blocks: pa.Table) -> pa.Table:
        found, asked = {}, {}
        for piece in range(index.num_rows):
            for at in range(blocks.num_rows):
                cell, keys, vectors = (index.column(c)[piece] for c in ("_cell", "_keys", "_vectors"))
                block, wanted, ids, questions = (blocks.column(c)[at] for c in ("_block", "_wanted", "_ids", "_asked"))
                block, keys = block.as_py(), keys.values
                mine = found.setdefault(block, _Found(ids.values))
                if block not in asked:
                    if sum(x.quick.nbytes for x in asked.values()) >= HELD_BYTES:
                        asked.clear()
                    asked[block] = _Asked(unpack(questions.as_buffer()))
                some, vectors = asked[block], unpack(vectors.as_buffer())
                cell = np.frombuffer(cell.as_buffer(), np.int32)
                here = np.unique(cell)
                wants = _wanted(wanted.as_buffer(), len(mine.ids), cells)[:, here]
                share = wants.mean(axis=0)
                groups = [(None, np.isin(cell, here[share > MOSTLY]))]
                groups += [(np.flatnonzero(wants[:, i]), cell == here[i]) for i in np.flatnonzero((share > 0) & (share <= MOSTLY))]
                for who, part in groups:
                    part = np.flatnonzero(part)
                    if not len(part):
                        continue
                    x = vectors if len(part) == len(vectors) else vectors[part]
                    hits = list(_nearest(some, x, k, mine.reach) if who is None else _nearest(some.vectors[who], x, k, mine.reach[who]))
                    row, column, dist = (np.concatenate(h) for h in zip(*hits, strict=True))
                    mine.add(row if who is None else who[row], keys.take(pa.array(part[column])), dist, k)
        parts = [pa.table([f.ids.take(f.best.column("row").combine_chunks()), f.best.column("key"), f.best.column("dist")], names=schema.names)
                 for f in found.values() if f.best is not None]
        return pa.concat_tables([schema.empty_table(), *parts]).combine_chunks()
    return run


def _grid(rows: int, questions: int, blocks: int, tasks: int, k: int) -> tuple[int, int]:
    """Into how many shares pieces and blocks are dealt: at least ``tasks`` pairs of
    them, the fewest bytes shuffled, and no share above ``SHARE_ROWS``."""
    best = np.sqrt(tasks * questions * (PACKED_QUESTION + k * HIT) / max(1, rows * PACKED_ROW))
    of_blocks = max(-(-questions // SHARE_ROWS), min(blocks, round(best)), 1)
    return max(-(-rows // SHARE_ROWS), -(-tasks // of_blocks), 1), of_blocks


def _pair_join(rows: DataFrame, blocks: DataFrame, cells: int, shares: tuple[int, int], k: int) -> DataFrame:
    """``_q, _c, dist``: the k nearest rows (_c, _v, _cell) that each task met, for
    every question of ``blocks``."""
    of_pieces, of_blocks = shares
    pieces = _index_pieces(rows, INDEX_BLOCK)
    ids, keys = blocks.schema["_ids"].dataType.elementType, rows.schema["_c"].dataType
    schema = T.StructType([T.StructField("_q", ids), T.StructField("_c", keys), T.StructField("dist", T.DoubleType())])
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = pieces.select(F.pmod("_piece", F.lit(of_pieces)).cast("int").alias("_s"), every(of_blocks).alias("_t"), "_cell", "_keys", "_vectors")
    right = blocks.select(every(of_pieces).alias("_s"), F.pmod("_block", F.lit(of_blocks)).cast("int").alias("_t"), "_block", "_wanted", "_ids", "_asked")
    return (left.groupBy("_s", "_t").cogroup(right.groupBy("_s", "_t"))
            .applyInArrow(_solve_pairs(k, cells, to_arrow_schema(schema)), schema))


def rank_hits(found: DataFrame, k: int, q_key: str, c_key: str) -> DataFrame:
    """The k best of each question: ranked on the rounded distance (ties by key),
    the distance itself is reported."""
    w = Window.partitionBy("_q").orderBy(F.round("dist", RANK_DECIMALS), "_c")
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select(F.col("_q").alias(q_key), F.col("_c").alias(c_key), "dist", "rank"))


def knn_join(questions: DataFrame, index: DataFrame | CellIndex, k: int = 1,
             q_key: str = "q_id", c_key: str = "chunk_id",
             q_vec: str = "embedding", c_vec: str = "embedding",
             pivots: int | None = None, sample: int | None = None) -> DataFrame:
    """Top-``k`` index rows per question: ``q_key, c_key, dist, rank``.  Rows
    without a vector take no part; question keys are unique.  ``pivots`` and
    ``sample`` say how a plain frame is put into cells."""
    asked = questions.select(F.col(q_key).alias("_q"), F.col(q_vec).alias("_qv")).where(F.col("_qv").isNotNull())
    stored = isinstance(index, CellIndex)
    cells = index if stored else in_cells(
        index.select(c_key, c_vec).withColumn("_slot", F.monotonically_increasing_id()), c_key, c_vec, pivots, sample)
    slot = [] if stored else ["_slot"]
    rows = cells.rows.select(F.col(c_key).alias("_c"), F.col(c_vec).alias("_v"), F.col("cell").alias("_cell"), *slot).where(F.col("_v").isNotNull())
    wants = _wanted_cells(asked, cells, k) if cells.cells > 1 else asked.withColumn("_cells", F.array(F.lit(0)))
    many = max(1, cells.cells)
    wants = cut_lineage(_with_bits(wants, many))
    n, m = int(cells.sizes.sum()), wants.count()
    parts = max(1, -(-4 * m // (3 * QUESTION_BLOCK)))        # ranges differ in size by some per cent
    blocks = cut_lineage(_question_blocks(wants.repartitionByRange(parts, F.col("_wanted"), F.xxhash64("_q")), many, QUESTION_BLOCK))
    if cells.cells > 1:
        asking = [r[0] for r in blocks.select(F.explode("_asking")).distinct().collect()]       # at most one number per cell
        if len(asking) < cells.cells:
            rows = rows.where(F.col("_cell").isin(sorted(asking)))
    tasks = max(1, -(-n // INDEX_BLOCK))
    if stored or cells.cells <= 1:                           # rows of a stored cell lie together
        rows = rows.coalesce(tasks)
    else:
        rows = cut_lineage(rows.repartitionByRange(tasks, F.col("_cell"), F.xxhash64("_c", "_slot")))
    shares = _grid(n, m, parts, TASKS_PER_CORE * questions.sparkSession.sparkContext.defaultParallelism, k)
    return rank_hits(_pair_join(rows, blocks, many, shares, k), k, q_key, c_key)


def retrieve_context(hits: DataFrame, chunks: DataFrame, c_key: str = "chunk_id",
                     cols: tuple[str, ...] = ("source", "text")) -> DataFrame:
    """Hit ids → chunk text and metadata.  Hits are questions x k rows; the
    join is planned by AQE from runtime sizes (the hit side is normally
    broadcast)."""
    return hits.join(chunks.select(c_key, *cols), c_key, "inner")


def stuff_context(retrieved: DataFrame, q_key: str = "q_id", sep: str = "\n\n") -> DataFrame:
    """A5: retrieved texts of each question, by rank, joined with a blank line;
    sources as ``array<struct<source,text>>`` in rank order."""
    agg = retrieved.groupBy(q_key).agg(
        F.array_sort(F.collect_list(F.struct("rank", "source", "text"))).alias("_r"))
    return agg.select(
        q_key,
        F.array_join(F.transform("_r", lambda x: x["text"]), sep).alias("context"),
        F.transform("_r", lambda x: F.struct(x["source"].alias("source"), x["text"].alias("text"))).alias("sources"))


def top_k_for_vector(index: DataFrame, vector: list[float], k: int = 1,
                     c_key: str = "chunk_id", c_vec: str = "embedding") -> DataFrame:
    """One question, native distance, ``orderBy().limit(k)`` →
    TakeOrderedAndProject (per-partition top-k, k rows to the driver)."""
    from quarry.functions.vectors import squared_l2
    q = F.array(*[F.lit(float(v)) for v in vector])
    return (index.select(c_key, squared_l2(F.col(c_vec), q).alias("dist"))
            .orderBy(F.round("dist", RANK_DECIMALS), c_key).limit(k))
