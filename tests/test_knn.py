"""Exact k-NN against numpy brute force (FIXTURES.md `vectors`)."""
import numpy as np

from quarry.operators import knn
from quarry.operators.knn import knn_join


def _brute(q, c, k):
    out = {}
    for qi, qv in q.items():
        d = sorted((round(float(((np.array(qv) - np.array(cv)) ** 2).sum()), 9), ci) for ci, cv in c.items())
        out[qi] = [ci for _, ci in d[:k]]
    return out


def _run(spark, q, c, k, **kw):
    qdf = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in q.items()], "q_id long, embedding array<double>")
    cdf = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in c.items()], "chunk_id long, embedding array<double>")
    got = {}
    for r in knn_join(qdf, cdf, k=k, **kw).collect():
        got.setdefault(r.q_id, []).append((r.rank, r.chunk_id))
    return {qi: [c for _, c in sorted(v)] for qi, v in got.items()}


def test_ties_zero_distance_and_large_k(spark):
    c = {5: [1, 0], 3: [1, 0], 9: [0, 1], 1: [2, 2], 7: [0, 0]}
    q = {1: [1, 0], 2: [0.5, 0.5], 3: [0, 0]}
    for k in (1, 2, 10):
        assert _run(spark, q, c, k) == _brute(q, c, k)


def test_random_blocks(spark):
    rnd = np.random.default_rng(3)
    c = {i: rnd.normal(size=8).round(2).tolist() for i in range(300)}
    q = {i: rnd.normal(size=8).round(2).tolist() for i in range(37)}
    for pivots in (1, 5, 64):
        assert _run(spark, q, c, 3, pivots=pivots, sample=100) == _brute(q, c, 3)


def test_small_blocks_and_a_hot_cell(spark, monkeypatch):
    monkeypatch.setattr(knn, "INDEX_BLOCK", 16)
    monkeypatch.setattr(knn, "QUESTION_BLOCK", 4)
    rnd = np.random.default_rng(4)
    c = {i: ([1.0, 1.0, 1.0] if i % 3 == 0 else rnd.normal(size=3).round(2).tolist()) for i in range(240)}
    q = {i: rnd.normal(size=3).round(2).tolist() for i in range(30)} | {99: [1.0, 1.0, 1.0]}
    assert _run(spark, q, c, 4) == _brute(q, c, 4)


def test_far_cells_are_left_out(spark):
    """Clusters far apart: a question is sent to few cells, and the result holds."""
    rnd = np.random.default_rng(5)
    c = {i: ((i % 8) * 100 + rnd.normal(size=2)).round(3).tolist() for i in range(400)}
    q = {i: ((i % 8) * 100 + rnd.normal(size=2)).round(3).tolist() for i in range(24)}
    assert _run(spark, q, c, 2, pivots=8, sample=400) == _brute(q, c, 2)
    index = spark.createDataFrame([(i, v) for i, v in c.items()], "chunk_id long, embedding array<double>")
    placed = knn.in_cells(index, "chunk_id", "embedding", 32, 400)
    assert placed.sizes.sum() == 400 and all((np.diff(x) >= 0).all() for x in placed.near)
    asked = spark.createDataFrame([(i, v) for i, v in q.items()], "_q long, _qv array<double>")
    cells = knn._wanted_cells(asked, placed, 2).collect()
    assert all(len(r._cells) <= placed.cells // 2 for r in cells)


def test_k_beyond_the_kept_distances(spark):
    """The bound then rests on the radii."""
    rnd = np.random.default_rng(6)
    c = {i: rnd.normal(size=3).round(2).tolist() for i in range(120)}
    q = {i: rnd.normal(size=3).round(2).tolist() for i in range(9)}
    for k in (knn.NEAR + 5, 119, 200):
        assert _run(spark, q, c, k, pivots=6, sample=60) == _brute(q, c, k)


def test_nearest_columns_break_ties_by_column():
    rnd = np.random.default_rng(2)
    ranked = rnd.integers(0, 4, (50, 30)).astype(float)
    for k in (1, 3, 30, 40):
        row, column = knn.nearest_columns(ranked, k)
        want = [(i, int(j)) for i, x in enumerate(ranked) for j in np.argsort(x, kind="stable")[:k]]
        assert list(zip(row.tolist(), column.tolist(), strict=True)) == want


def test_empty_index(spark):
    assert _run(spark, {1: [1.0, 2.0]}, {}, 2) == {}


def test_approximate_recall_and_work(spark, monkeypatch):
    """Clustered rows, several bits: at least nine of ten neighbours are found, with
    exact distances, from a part of the index."""
    from quarry.operators import knn_approx as A
    rnd = np.random.default_rng(7)
    centres = rnd.normal(size=(40, 16)) * 3
    c = {i: (centres[i % 40] + rnd.normal(size=16) * .5).round(3).tolist() for i in range(4000)}
    q = {i: (centres[i % 40] + rnd.normal(size=16) * .5).round(3).tolist() for i in range(200)}
    qdf, cdf = (spark.createDataFrame(list(x.items()), f"{k} long, embedding array<double>") for x, k in ((q, "q_id"), (c, "chunk_id")))
    monkeypatch.setattr(A, "BUCKET_ROWS", 250)
    got = A.knn_approximate(qdf, cdf, k=10)
    exact = knn_join(qdf, cdf, k=10)
    row = A.recall(got, exact).first()
    assert row.wanted == 2000 and row.found >= 1800
    near = {(r.q_id, r.chunk_id): r.dist for r in exact.collect()}
    rows = got.collect()
    assert all(abs(near[x] - r.dist) < 1e-9 for r in rows if (x := (r.q_id, r.chunk_id)) in near)
    assert len({(r.q_id, r.chunk_id) for r in rows}) == len(rows) and max(r["rank"] for r in rows) == 10
    mean, normals = A.planes_for(cdf, "chunk_id", "embedding", 1, 4)
    codes = A.buckets(np.array(list(c.values())), mean, normals, 1)
    assert np.bincount(codes[:, 0]).max() < 2000             # a bucket is a part of the index
    some = A.buckets(np.array(list(q.values())), mean, normals, 4)
    assert all(len(set(x)) == 4 for x in some.tolist())      # probes are different buckets


def test_approximate_odd_tables(spark):
    from quarry.operators.knn_approx import knn_approximate
    empty = spark.createDataFrame([], "chunk_id long, embedding array<double>")
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0, 2.0])], "chunk_id long, embedding array<double>")
    asked = spark.createDataFrame([(5, [1.0, 2.0]), (6, None)], "q_id long, embedding array<double>")
    assert knn_approximate(asked, empty).collect() == []
    assert [tuple(r) for r in knn_approximate(asked, one, k=5).collect()] == [(5, 1, 0.0, 1), (5, 3, 0.0, 2)]


def _as_before(asked, vectors, k):
    dist = knn.squared_distances(asked.astype(float), vectors.astype(float))
    row, column = knn.nearest_columns(np.round(dist, knn.RANK_DECIMALS), k)
    return row, column, dist[row, column]


def _screened(asked, vectors, k):
    return [np.concatenate(x) for x in zip(*knn._nearest(asked, vectors, k), strict=True)]


def test_screening_leaves_no_neighbour_out(monkeypatch):
    """Single precision only says what to measure: near ties, copies, long and tiny
    vectors, and what cannot be screened, all rank as in double precision."""
    rnd = np.random.default_rng(11)
    close = rnd.normal(size=(1, 40)) + rnd.normal(size=(900, 40)) * 1e-5
    sparse = (rnd.poisson(0.1, (1500, 64)) / 3.0).astype(np.float32)
    cases = [(close[:70], close), (sparse[:90], sparse), (np.ones((5, 3)), np.ones((400, 3))),
             (rnd.normal(size=(40, 6)) * 1e7, rnd.normal(size=(500, 6)) * 1e7), (rnd.normal(size=(20, 4)) * 1e-30, rnd.normal(size=(300, 4)) * 1e-30),
             (np.zeros((3, 5), np.float32), rnd.normal(size=(80, 5)).astype(np.float32)), (rnd.normal(size=(6, 5)), rnd.normal(size=(2, 5))),
             (rnd.normal(size=(6, 5)) * 1e30, rnd.normal(size=(90, 5)) * 1e30), (np.array([[np.nan, 1], [0, 1]]), rnd.normal(size=(50, 2)))]
    for cells in (1 << 23, 1 << 11):
        monkeypatch.setattr(knn, "SCREENED_AT_A_TIME", cells)
        for asked, vectors in cases:
            for k in (1, 2, 7, 60):
                want, got = _as_before(asked, vectors, k), _screened(asked, vectors, k)
                assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])
                scale = 1e-12 * (1 + np.nanmax(np.abs(vectors.astype(float))) ** 2 * vectors.shape[1])
                assert np.allclose(got[2], want[2], rtol=0, atol=scale, equal_nan=True)


def test_screening_measures_few(monkeypatch):
    """Ordinary blocks are multiplied in single precision and few pairs measured."""
    rnd = np.random.default_rng(12)
    x = rnd.normal(size=(3000, 32)).astype(np.float32)
    monkeypatch.setattr(knn, "squared_distances", None)      # the full matrix in double precision is not made
    for k in (1, 3, 10):
        assert [len(a) for a in _screened(x[:200], x, k)] == [200 * k] * 3


def test_a_task_takes_many_blocks(spark, monkeypatch):
    """Pairs of blocks are dealt to few tasks: vectors are not shuffled once per pair,
    and a question has k hits per share of the pieces, not per piece."""
    monkeypatch.setattr(knn, "INDEX_BLOCK", 8)
    monkeypatch.setattr(knn, "QUESTION_BLOCK", 8)
    monkeypatch.setattr(knn, "TASKS_PER_CORE", 1)
    rnd = np.random.default_rng(13)
    qdf, cdf = (spark.createDataFrame([(i, rnd.normal(size=4).tolist()) for i in range(n)], f"{key} long, embedding array<double>")
                for n, key in ((100, "q_id"), (400, "chunk_id")))
    seen = []
    monkeypatch.setattr(knn, "rank_hits", lambda found, k, *keys, rank=knn.rank_hits: seen.append(found) or rank(found, k, *keys))
    assert knn_join(qdf, cdf, k=2, pivots=1).count() == 200
    assert 200 <= seen[0].count() <= 200 * spark.sparkContext.defaultParallelism        # of 50 pieces


def test_grid():
    """Enough tasks, the larger side less often, and no share above its bound."""
    for rows, questions, blocks in ((0, 0, 1), (10, 5, 1), (263_000, 69_000, 6), (69_000, 263_000, 22), (30_000_000, 9_000_000, 733)):
        of_pieces, of_blocks = knn._grid(rows, questions, blocks, 24, 1)
        assert of_pieces * of_blocks >= 24 and of_pieces * knn.SHARE_ROWS >= rows and of_blocks * knn.SHARE_ROWS >= questions
    assert knn._grid(263_000, 69_000, 6, 24, 1) == (12, 2)


def test_packed_matrices_come_back():
    rnd = np.random.default_rng(14)
    for x in (rnd.normal(size=(7, 5)), rnd.normal(size=(9, 3)).astype(np.float32), rnd.poisson(0.2, (30, 11)) * rnd.normal(size=(30, 11)),
              np.array([[0.0, np.nan], [np.inf, 0.0]], np.float32), np.zeros((4, 6), np.float32), np.zeros((3, 0)), rnd.integers(0, 2, (5, 40))):
        got = knn.unpack(knn.pack(x))
        assert got.dtype == x.dtype and got.shape == x.shape and np.array_equal(got, x, equal_nan=x.dtype.kind == "f")
    sparse = (rnd.random((500, 256)) < 0.2).astype(np.float32)
    assert len(knn.pack(sparse)) < sparse.nbytes / 3


def test_what_is_known_to_be_near_bounds_the_rest():
    """With the k-th distances known, farther rows are left out and nearer ones are not."""
    rnd = np.random.default_rng(15)
    x, y = rnd.normal(size=(50, 6)), rnd.normal(size=(700, 6))
    row, column, dist = _as_before(x, y, 3)
    reach = np.round(dist.reshape(50, 3)[:, 2], knn.RANK_DECIMALS)
    for known in (reach, reach + 0.3):
        got = [np.concatenate(z) for z in zip(*knn._nearest(x, y, 3, known), strict=True)]
        assert np.array_equal(got[0], row) and np.array_equal(got[1], column)
    assert sum(len(r) for r, *_ in knn._nearest(x, y + 50.0, 3, reach)) == 0
