"""Quality classifier: logistic regression on hashed word n-grams, trained with
follow-the-regularised-leader (proximal) updates, scored as sparse dot products.

A text's unigrams and bigrams of words (runs of ``[^\\x20\\x09-\\x0D]``) are
hashed into ``BUCKETS`` cells; a cell's value is log(1 + count), scaled to unit
length over the text, and there is one bias cell.

The classifier is fitted on at most ``SAMPLE_ROWS`` labelled rows, those with
the smallest hashes of their id (a row that several labels name takes the
smallest label), one row per id and ``SAMPLE_BYTES`` of text together.  Features are made where the texts are; the updates are
sequential and run over the bounded sample's sparse rows in one task.  The
weights, one number per cell, are broadcast.

Defined results: null, empty and blank texts have the bias only; without a
labelled row every score is 0.5; rows without a usable label or id teach
nothing; repeated rows are scored each.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import hashed_words, labelled, ngram_cells, sampled_texts, utf8
from quarry.session import cut_lineage

BUCKETS = 1 << 18
SAMPLE_ROWS = 16_000
SAMPLE_BYTES = 512 << 20   # text of the sample
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
PASSES = 2


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Cells and values of a text, bias last."""
    cells, counts = ngram_cells(hashed_words(text or b""), BUCKETS)
    values = np.log1p(counts)
    norm = float(np.sqrt((values ** 2).sum()))
    return np.append(cells, BUCKETS), np.append(values / norm if norm else values, 1.0)


def sparse_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, text) to (id, label, cells, values)."""
    for b in batches:
        made = [features(t) for t in utf8(b.column(2))]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array([c.astype(np.int32) for c, _ in made], pa.list_(pa.int32())),
             pa.array([v.astype(np.float32) for _, v in made], pa.list_(pa.float32()))],
            names=["id", "label", "cells", "values"])


class Learner:
    """Proximal FTRL: weights are a function of the summed gradients ``z`` and
    their squares ``n``, and stay zero until |z| exceeds L1."""

    def __init__(self):
        self.z = np.zeros(BUCKETS + 1)
        self.n = np.zeros(BUCKETS + 1)

    def weights(self, cells: np.ndarray) -> np.ndarray:
        z = self.z[cells]
        l1 = np.where(cells == BUCKETS, 0.0, L1)
        strength = (BETA + np.sqrt(self.n[cells])) / ALPHA + np.where(cells == BUCKETS, 0.0, L2)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / strength)

    def learn(self, cells: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(cells)
        gradient = (1 / (1 + np.exp(-float(w @ values))) - label) * values
        n = self.n[cells]
        self.z[cells] += gradient - (np.sqrt(n + gradient ** 2) - np.sqrt(n)) / ALPHA * w
        self.n[cells] = n + gradient ** 2


def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for b in batches:
        rows += [(np.asarray(c, np.int64), np.asarray(v, np.float64), y) for y, c, v in zip(
            b.column(0).to_pylist(), (x.values.to_numpy() for x in b.column(1)), (x.values.to_numpy() for x in b.column(2)),
            strict=True)]
    learner = Learner()
    for _ in range(PASSES):
        for cells, values, label in rows:
            learner.learn(cells, values, label)
    weights = learner.weights(np.arange(BUCKETS + 1))
    cells = np.flatnonzero(weights)
    yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(weights[cells])], names=["cell", "weight"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality") -> np.ndarray:
    """Weights by cell, learned from the rows of ``docs`` that ``labels`` names."""
    order = F.xxhash64(F.col("of").cast("string"))
    sample = labelled(labels, id_col, label_col).orderBy(order, "of").limit(SAMPLE_ROWS)
    rows = (sampled_texts(docs, sample, id_col, text_col, SAMPLE_BYTES)
            .select(F.col("of").cast("string").alias("id"), "label", "text"))
    made = cut_lineage(rows.mapInArrow(sparse_rows, "id string, label int, cells array<int>, values array<float>"))
    learned = (made.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id", "cells").select("label", "cells", "values")
               .mapInArrow(fit, "cell long, weight double")).toArrow()
    weights = np.zeros(BUCKETS + 1)
    weights[learned["cell"].to_numpy()] = learned["weight"].to_numpy()
    return weights


def scoring(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for b in batches:
            scores = []
            for text in utf8(b.column(1)):
                cells, values = features(text)
                scores.append(1 / (1 + np.exp(-float(weights[cells] @ values))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], names=["id", "score"])
    return run


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score`` of every document, from its text only."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scoring(shared), f"id {rows.schema['id'].dataType.simpleString()}, score double")
