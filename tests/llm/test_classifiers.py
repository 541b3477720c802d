"""Held-out accuracy and defined results of the two trained classifiers."""
import math
import random
from collections import Counter

import numpy as np
import pytest

from quarry.llm import common, quality_classifier, toxicity
from quarry.llm.queries import op4_toxicity, op9_quality_classifier

SF = "/root/testdata/sf0.1"      # smaller tables have few toxic rows; labels are partly wrong


def auc(pairs):
    scores = np.array([s for s, _ in pairs])
    y = np.array([bool(v) for _, v in pairs])
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(order))
    _, inverse, n = np.unique(scores[order], return_inverse=True, return_counts=True)
    ranks[order] = (np.cumsum(n) - (n - 1) / 2)[inverse]
    return (ranks[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())


@pytest.mark.parametrize("query,label,least", [(op9_quality_classifier, "quality", 0.98), (op4_toxicity, "toxic", 0.93)])
def test_held_out(spark, query, label, least):
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = query(spark, SF).collect()
    assert len(rows) == n and all(0 <= r.score <= 1 for r in rows)
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert auc(held) > least, auc(held)
    again = {r.doc_id: r.score for r in query(spark, SF).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in rows)


def test_ftrl_weights_follow_the_definition():
    learner = quality_classifier.Learner()
    cells, values = np.array([3, 7, quality_classifier.BUCKETS]), np.array([0.6, 0.8, 1.0])
    z, n = {}, {}
    for y in (1, 1, 0, 1):
        w = {}
        for c in cells:
            l1, l2 = (0, 0) if c == quality_classifier.BUCKETS else (quality_classifier.L1, quality_classifier.L2)
            zc, nc = z.get(c, 0.0), n.get(c, 0.0)
            w[c] = 0.0 if abs(zc) <= l1 else -(zc - np.sign(zc) * l1) / ((quality_classifier.BETA + nc ** 0.5) / quality_classifier.ALPHA + l2)
        assert np.allclose(learner.weights(cells), [w[c] for c in cells])
        p = 1 / (1 + np.exp(-sum(w[c] * v for c, v in zip(cells, values, strict=True))))
        for c, v in zip(cells, values, strict=True):
            g = (p - y) * v
            z[c] = z.get(c, 0.0) + g - ((n.get(c, 0.0) + g * g) ** 0.5 - n.get(c, 0.0) ** 0.5) / quality_classifier.ALPHA * w[c]
            n[c] = n.get(c, 0.0) + g * g
        learner.learn(cells, values, y)


def frames(spark):
    rng = random.Random(7)
    plain = ["the", "house", "was", "old", "and", "tall", "with", "some", "trees", "near", "it"]
    rows, labels = [], []
    for i in range(240):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        if i % 4 == 0:
            words[rng.randrange(len(words))] = rng.choice(["nasty", "vile"])
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(i % 4 == 0)))
    odd = [(900, None, None), (901, "", "y"), (902, " \n", "y"), (None, "the vile house", "y"), (0, rows[0][1], "x")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, score string")
    bad = [(None, 1), (1, None), (5, 7), (4, 1), (4, 1)]
    return docs, spark.createDataFrame(labels + bad, "doc_id long, mark int"), len(rows + odd)


def test_toxicity_frames(spark):
    docs, labels, n = frames(spark)
    model = toxicity.train(docs, labels, label_col="mark")
    got = toxicity.score(docs, model).collect()
    assert len(got) == n
    score = {r.id: r.score for r in got}
    assert sum((score[i] > 0.5) == (i % 4 == 0) for i in range(240)) > 225
    assert score[900] == score[901] == score[902] and score[None] > score[901]
    none = toxicity.train(docs, labels.limit(0), label_col="mark")
    assert none is None and {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0


def plain_model(counted, corpus):
    """P(class, word, before) of word bigrams by the formulas, with dictionaries."""
    n = {c: Counter() for c in (1, 0)}
    for text, label in counted:
        words = text.split()
        n[label].update(zip(["<s>", *words], words))
    vocabulary = {w for c in n for _, w in n[c]}
    every = Counter(w for text in corpus for w in text.split())
    frequency = {w: 0.5 * (every[w] + 0.5) / (sum(every.values()) + 0.5) + 0.5 / len(vocabulary) for w in vocabulary}
    d, prior = toxicity.DISCOUNT, toxicity.PRIOR * len(vocabulary)

    def probability(c, w, before):
        kinds = Counter(v for _, v in n[c])
        total = sum(kinds.values()) + prior
        single = max(kinds[w] - d, 0) / total + (d * len(kinds) + prior) / total * frequency[w]
        after = {v: k for (h, v), k in n[c].items() if h == before}
        count = sum(after.values()) + prior
        return max(after.get(w, 0) - d, 0) / count + (d * len(after) + prior) / count * single
    return vocabulary, probability


def kneser_ney_rows():
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice("a a b c d e".split() if i % 3 else "a b f f g".split()) for _ in range(rng.randint(1, 30))))
            for i in range(120)]
    return rows, [(i, int(i % 3 == 0)) for i in range(100)]


def test_kneser_ney_measures_by_brute_force(spark):
    """Probabilities sum to at most one, and every measure and score follows from
    probabilities computed with dictionaries."""
    rows, marks = kneser_ney_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    text = dict(rows)
    sample = toxicity.sample_rows(docs, labels, "doc_id", "text", "toxic").collect()
    assert sorted(r.text for r in sample) == sorted(text[i] for i, _ in marks)
    vocabulary, probability = plain_model([(r.text, r.label) for r in sample if r.part], text.values())
    for c in (0, 1):
        for before in ["<s>", *vocabulary]:
            assert 0.6 < sum(probability(c, w, before) for w in vocabulary) <= 1 + 0.02       # S is smoothed

    def plain_measures(t):
        words = t.split()
        r = [math.log(probability(1, w, h) / probability(0, w, h)) if w in vocabulary else 0.0 for h, w in zip(["<s>", *words], words)]
        windows = [r[i:i + toxicity.WINDOW] for i in range(max(1, len(r) - toxicity.WINDOW + 1))]
        return max(sum(w) / len(w) for w in windows), sum(r) / len(r), len(windows)

    arrays = toxicity.unpacked(model["shared"].value)
    want = {i: plain_measures(t) for i, t in rows}
    for i, t in rows:
        assert np.allclose(toxicity.measures(arrays, [t.encode()])[0], want[i], atol=1e-5)
    curve = model["curve"]
    left = [(r.label, *plain_measures(r.text)) for r in sample if not r.part]
    x, y = np.log([m[3] for m in left if not m[0]]), [m[1] for m in left if not m[0]]
    assert abs(curve.growth - max(0, np.polyfit(x, y, 1)[0])) < 1e-5 and curve.longest == max(x)
    for r in toxicity.score(docs, model).collect():
        best, mean, n = want[r.id]
        level = best - curve.growth * min(math.log(n), curve.longest)
        assert abs(r.score - 1 / (1 + math.exp(-curve.slope * level - curve.offset))) < 1e-4 and abs(r.mean_ratio - mean) < 1e-5


def test_long_ordinary_texts_are_not_toxic_for_their_length(spark):
    """Texts of one distribution, some longer than a piece: the greatest window
    grows with the length, the score does not follow it; a passage in one counts."""
    rng = random.Random(5)
    plain = [f"word{k}" for k in range(400)]
    some = lambda n: [plain[int(400 * rng.random() ** 2)] for _ in range(n)]
    rows = [(i, some(rng.randint(20, 200) if i % 50 else 2000)) for i in range(600)]
    for i, words in rows:
        if i % 5 == 1:
            words[rng.randrange(len(words))] = rng.choice(["nasty", "vile"])
    rows += [(1000 + k, some(180_000)) for k in range(3)]
    rows.append((1003, [*some(90_000), "vile", *some(90_000)]))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    assert len(" ".join(rows[-1][1])) > common.PIECE_BYTES
    labels = spark.createDataFrame([(i, int(i % 5 == 1)) for i in range(600)], "doc_id long, toxic int")
    score = {r.id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert max(score[1000 + k] for k in range(3)) < 0.3 and score[1003] > 0.7


def test_packed_parts():
    value = {"a": toxicity.packed([np.arange(3.0)]), "b": toxicity.packed([np.ones((2, k), np.float32) * k for k in (0, 2, 0, 1)])}
    got = toxicity.unpacked(value)
    assert got["a"].tolist() == [0, 1, 2] and got["b"].tolist() == [[2, 2, 1], [2, 2, 1]]


def test_quality_frames(spark):
    docs, labels, n = frames(spark)
    weights = quality_classifier.train(docs, labels, label_col="mark")
    got = quality_classifier.score(docs, weights).collect()
    assert len(got) == n
    score = {r.id: r.score for r in got}
    assert score[900] == score[901] == score[902]
    assert auc([(score[i], i % 4 == 0) for i in range(240)]) > 0.9
    none = quality_classifier.train(docs, labels.limit(0), label_col="mark")
    assert {r.score for r in quality_classifier.score(docs, none).collect()} == {0.5}
    assert quality_classifier.score(docs.limit(0), weights).count() == 0


def test_toxic_copies_are_scored(spark):
    """Their words follow one other word each, however many copies there are."""
    rng = random.Random(3)
    plain = ["the", "house", "was", "old", "and", "tall", "with", "some", "trees", "near", "it"]
    rows = [(i, "zork blag frim dwel" if i % 4 == 0 else " ".join(rng.choice(plain) for _ in range(20))) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(160)], "doc_id long, toxic int")
    score = {r.id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert min(score[i] for i in range(160, 240, 4)) > 0.5 > max(score[i] for i in range(160, 240) if i % 4)


def test_the_sample_is_bounded_in_rows_and_bytes(spark):
    """An id that stands in thousands of rows counts once, and long texts do not
    pass the byte bound."""
    rows = [(1, f"copy {i}") for i in range(5000)] + [(2, "x" * 400), (3, "y" * 400), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    ids = spark.createDataFrame([(i, i % 2) for i in range(1, 6)], "of long, label int")
    got = common.sampled_texts(docs, ids, "doc_id", "text", 10 ** 6).collect()
    assert sorted(r.of for r in got) == [1, 2, 3, 4]
    assert {r.of: r.text for r in got} == {r.of: r.text for r in common.sampled_texts(docs.repartition(3), ids, "doc_id", "text", 10 ** 6).collect()}
    small = common.sampled_texts(docs, ids, "doc_id", "text", 500).collect()
    assert sum(len(r.text or "") for r in small) <= 500 and len(small) < 4


def test_query_scores_are_the_dot_products(spark):
    """Scores of the quality query from its weights, feature by feature."""
    from zlib import crc32
    docs, labels, _ = frames(spark)
    weights = quality_classifier.train(docs, labels, label_col="mark")
    got = {r.id: r.score for r in quality_classifier.score(docs, weights).collect()}
    mask = (1 << 64) - 1
    for r in docs.where("doc_id < 60").collect():
        words = [crc32(w) for w in r.text.encode().split()]
        grams = [w * 0xD6E8FEB86659FD93 & mask for w in words]
        grams += [(a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) & mask for a, b in zip(words, words[1:])]
        counts = {}
        for g in grams:
            cell = (g >> 24) % quality_classifier.BUCKETS
            counts[cell] = counts.get(cell, 0) + 1
        value = {c: np.log1p(n) for c, n in counts.items()}
        norm = np.sqrt(sum(v * v for v in value.values()))
        dot = weights[quality_classifier.BUCKETS] + sum(weights[c] * v / norm for c, v in value.items())
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-dot))) < 1e-9
