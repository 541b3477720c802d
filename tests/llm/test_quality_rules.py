"""Counts against a direct computation, the ratio against its definition."""
import random

import numpy as np

from quarry.llm import quality_rules
from quarry.llm.common import hashed_words
from quarry.llm.queries import op7_quality_rules

WHITE = " \t\n\x0b\x0c\r"


def slow_counts(text):
    text = text or ""
    words, word = [], ""
    for c in text + " ":
        if c in WHITE:
            words += [word] if word else []
            word = ""
        else:
            word += c
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    again = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else set()
    covered = {i + k for i, w in enumerate(windows) if w in again for k in range(8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def texts():
    rng = random.Random(1)
    out = [None, "", " \n\t", "a", "x y z " * 20, "line one\nline one\n line one\n\n \nline two\nline two", "é ü b c ##<>|",
           "a b c d e f g h i a b c d e f g h", "\x1c\x1d a\x85b"]
    return out + [" ".join(rng.choice(["a", "b", "é", "c\n", "d|"]) for _ in range(rng.randint(1, 200))) for _ in range(40)]


def test_counts():
    for text in texts():
        data = (text or "").encode()
        assert quality_rules.base_counts(data, hashed_words(data)) == slow_counts(text), text


def test_equal_hashes_are_not_equal_words():
    words = [f"w{i}" for i in range(16)]
    data = " ".join(words).encode()
    same = np.concatenate([np.arange(8), np.arange(8)]).astype(np.uint64)   # pretend that all collide
    assert quality_rules.repeated_words(data, same) == 0


def test_ratio_is_the_mean_over_ngrams():
    target, raw = np.zeros(quality_rules.BUCKETS), np.zeros(quality_rules.BUCKETS)
    good, bad = hashed_words(b"a clean text of words"), hashed_words(b"junk junk junk&&&")
    np.add.at(target, quality_rules.cells_of(good), 1)
    for h in (good, bad):
        np.add.at(raw, quality_rules.cells_of(h), 1)
    ratio = quality_rules.log_ratio(target, raw)
    cells = quality_rules.cells_of(good)
    share = lambda c, x: (c[x] + 1) / (c.sum() + quality_rules.BUCKETS)
    assert len(cells) == 9
    assert abs(quality_rules.mean_ratio(good, ratio) - np.mean([np.log(share(target, x) / share(raw, x)) for x in cells])) < 1e-9
    assert quality_rules.mean_ratio(good, ratio) > quality_rules.mean_ratio(bad, ratio)
    assert quality_rules.mean_ratio(hashed_words(b""), ratio) == 0.0


def test_rules(spark):
    rng = random.Random(2)
    clean = [(i, " ".join(rng.choice(["red", "green", "blue", "the", "of", "a"]) for _ in range(60)), "x") for i in range(300)]
    junk = [(1000 + i, " ".join(rng.choice(["buy&&&", "NOW!!", "win$$$", "|"]) for _ in range(60)), "x") for i in range(60)]
    odd = [(2000, None, None), (2001, "", "y"), (2002, "too short", "y"), (2003, "same eight words come here again and again " * 9, "y"),
           (None, "the red of a blue", None), (5, clean[5][1], "x")]
    docs = spark.createDataFrame(clean + junk + odd, "doc_id long, text string, ratio string")
    trusted = spark.createDataFrame([(i,) for i in range(0, 300, 2)] + [(2,), (None,)], "doc_id long")
    rows = quality_rules.rules(docs, trusted).collect()
    assert len(rows) == len(clean + junk + odd)
    for r in rows:
        assert r.kept == (r.id is not None and r.id < 300), r
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
    assert quality_rules.rules(docs.limit(0), trusted).count() == 0
    alone = quality_rules.rules(docs, trusted.limit(0)).collect()
    assert all(r.kept == (not r.base_failed) for r in alone)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op7_quality_rules(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == slow_counts(docs[r.doc_id])[:4]
    judged = [r for r in rows if not r.base_failed and r.doc_id in label]
    good = [r.kept for r in judged if label[r.doc_id] == 1]
    bad = [r.kept for r in judged if label[r.doc_id] == 0]
    assert sum(good) > 0.97 * len(good) and sum(bad) < 0.35 * max(1, len(bad))


def test_every_trusted_row_counts(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "TRUSTED_ROWS", 4, raising=False)
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice([f"w{i % 40}", "the", "of"]) for _ in range(60))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    half = {r.doc_id for r in docs.where("doc_id < 200 and pmod(shiftright(xxhash64(string(doc_id)), 8), 2) = 0").collect()}
    count = lambda ids: sum(np.bincount(quality_rules.cells_of(hashed_words(rows[i][1].encode())),
                                        minlength=quality_rules.BUCKETS) for i in ids)
    ratio = quality_rules.log_ratio(count(half), count(range(400)))
    for r in quality_rules.rules(docs, docs.select("doc_id").where("doc_id < 200")).collect():
        assert abs(r.ratio - quality_rules.mean_ratio(hashed_words(rows[r.id][1].encode()), ratio)) < 1e-9
