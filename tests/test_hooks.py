"""Hooks are built once per worker, not once per task."""
import os
import tempfile

import numpy as np

from quarry.operators.embed import embed
from quarry.operators.generate import batch_answer
from quarry.operators.hooks import Hook


def _counted(folder, make):
    """A factory that leaves a file per build, named after its process."""
    def factory():
        fd, _ = tempfile.mkstemp(prefix=f"built-{os.getpid()}-", dir=folder)
        os.close(fd)
        return make()
    return factory


def _builds(folder):
    pids = [f.split("-")[1] for f in os.listdir(folder)]
    return len(pids), len(set(pids))


def test_embedder_and_predictor(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir(), b.mkdir()
    df = spark.createDataFrame([(i, f"t{i}") for i in range(64)], "id long, context string").repartition(16)
    vectors = Hook("lengths", _counted(str(a), lambda: lambda texts: np.array([[len(t), 1.0] for t in texts])))
    rows = embed(df, "context", embedder=vectors).collect()
    assert {tuple(r.embedding) for r in rows} == {(2.0, 1.0), (3.0, 1.0)}
    builds, workers = _builds(a)
    assert builds == workers < 16
    answers = batch_answer(df, Hook("shout", _counted(str(b), lambda: lambda pdf: pdf["context"].str.upper()))).collect()
    assert {r.answer for r in answers} == {f"T{i}" for i in range(64)}
    builds, workers = _builds(b)
    assert builds == workers < 16


def test_without_a_hook_the_answer_is_the_context(spark):
    df = spark.createDataFrame([(1, "c"), (2, None)], "id long, context string")
    assert {r.id: r.answer for r in batch_answer(df).collect()} == {1: "c", 2: ""}
