"""Exact search against all scores."""
import math

import numpy as np
import pytest

from quarry.llm import topk


def slow(rows, k):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    queries = {}
    for i, v in ok:
        if i % 100 == 0:
            queries[i] = min(queries.get(i, v), v)
    out = []
    for q, v in queries.items():
        best = sorted((-dot(v, w), i) for i, w in ok if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def found(spark, rows, k=10, pivots=8, kind="float"):
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, cell int")
    v = topk.integer_vectors(table, "vec_id", "embedding")
    return sorted(map(tuple, topk.top_k(v.where("id % 100 = 0"), v, k, pivots).collect()))


def clustered(rng, n, dim=6):
    centres = rng.normal(size=(5, dim))
    return [[float(np.float32(x)) for x in centres[rng.integers(5)] + 0.2 * rng.normal(size=dim)] for _ in range(n)]


@pytest.mark.parametrize("pivots", [1, 8, 64])
def test_all_scores(spark, pivots):
    rows = list(enumerate(clustered(np.random.default_rng(1), 700)))
    assert found(spark, rows, pivots=pivots) == slow(rows, 10)


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    same = [0.5, -0.25, 1.0]
    rows = list(enumerate(clustered(rng, 60, 3))) + [(i, same) for i in range(90, 330)]
    rows += [(400, None), (401, [1.0, None, 2.0]), (402, [float("nan")] * 3), (403, [float("inf"), 0.0, 0.0]), (None, same),
             (500, []), (501, [1.0]), (502, [1.0, 2.0, 3.0, 4.0]), (600, same), (600, same), (600, [0.1, 0.1, 0.1])]
    assert found(spark, rows) == slow(rows, 10)


def test_fewer_rows_than_asked_for(spark):
    rows = [(0, [1.0, 2.0]), (100, [2.0, 1.0]), (7, [0.0, 0.0])]
    assert found(spark, rows) == slow(rows, 10)
    assert found(spark, [(100, [1.0])]) == []
    assert found(spark, [(7, [1.0])]) == []
    assert found(spark, []) == []


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2 ** 19, 2 ** 19, 4)]) for i in range(150)]
    assert found(spark, rows, 5, kind="double") == slow(rows, 5)


def test_blocks(monkeypatch, spark):
    monkeypatch.setattr(topk, "DATA_BLOCK", 20)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 1)
    rows = list(enumerate(clustered(np.random.default_rng(4), 450)))
    assert found(spark, rows) == slow(rows, 10)


def test_cells_far_away_are_not_needed(spark):
    rng = np.random.default_rng(5)
    far = [[100.0 * (j == c) + float(rng.normal()) * 0.01 for j in range(4)] for c in range(4) for _ in range(100)]
    v = topk.integer_vectors(spark.createDataFrame(list(enumerate(far)), "vec_id long, embedding array<double>"), "vec_id", "embedding")
    centres = topk.choose_pivots(v, 16)
    cell, dist = topk.distances(np.array([[math.floor(1024 * x) for x in r] for r in far]), centres)
    members = [np.sort(dist[cell == j])[:11] for j in range(len(centres))]
    radius = np.array([dist[cell == j].max() for j in range(len(centres))])
    needed = topk.needed_cells(v.where("id % 100 = 0"), centres, members, radius, 10).collect()
    assert all(0 < len(r.cells) <= len(centres) - 6 for r in needed)


def test_copies_of_a_query_do_not_fill_the_bound(spark):
    rng = np.random.default_rng(6)
    rows = [(100, [8.0, 0.0, 0.0, 0.0])] * 20
    rows += [(i + 1, [float(3.0 * (j == i % 4)) + float(rng.normal()) * 0.01 for j in range(4)]) for i in range(99)]
    assert found(spark, rows) == slow(rows, 10)
    assert len(found(spark, rows)) == 10
