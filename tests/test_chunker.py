"""M1: chunks written out for hand-made edge cases; properties on documents."""
import random
import time

import pytest
from pyspark.sql import functions as F

from quarry.operators.chunk import chunk_documents, spans, split_text

NBSP = "\u00a0"
# text, then the (start, end) of its chunks before stripping
CASES = {
    1: ("", []),
    2: ("     ", []),
    3: ("a" * 1000, [(0, 1000)]),
    4: ("b" * 1001, [(0, 1000), (950, 1001)]),
    5: ("x " + "c" * 999 + " y", [(0, 1), (1, 1001), (1001, 1003)]),
    6: ("x " + "d" * 1000 + " y", [(0, 1), (1, 1001), (951, 1002), (1002, 1004)]),
    7: ("x " + "e" * 2500 + " y", [(0, 1), (1, 1001), (951, 1951), (1901, 2502), (2502, 2504)]),
    8: (" ".join(["w"] * 300) + " " + "L" * 1200 + " " + " ".join(["v"] * 300),
        [(0, 599), (599, 1599), (1549, 1800), (1800, 2400)]),
    9: ("a  b   c " * 200, [(0, 1000), (950, 1800)]),
    10: ("   lead and trail   " * 80, [(0, 1000), (951, 1600)]),
    11: (("nb" + NBSP + "sp ") * 400, [(0, 995), (947, 1943), (1895, 2400)]),
    12: ("emoji 😀 text " * 150, [(0, 1000), (954, 1950)]),
    13: (" ".join(["abcd"] * 210) + " " + "z" * 40 + " " + " ".join(["efgh"] * 210), [(0, 999), (949, 1945), (1895, 2140)]),
    14: ("line one\nline two\n\npara two " * 60, [(0, 997), (969, 1680)]),
    15: (None, []),
    16: ("p" * 600 + "\n" + "q " * 700 + "\n\n" + "r" * 10, [(0, 600), (600, 1600), (1550, 2001), (2001, 2013)]),
}


def _spark_chunks(spark, texts, parts=1, **sizes):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(parts)
    out = {}
    for r in chunk_documents(df, ["doc_id"], **sizes).collect():
        out.setdefault(r.doc_id, []).append((r.chunk_idx, r.start, r.text))
    return {k: [(s, t) for _, s, t in sorted(v)] for k, v in out.items()}


@pytest.mark.parametrize("parts", [1, 5])
def test_edge_cases(spark, parts):
    got = _spark_chunks(spark, {k: t for k, (t, _) in CASES.items()}, parts)
    for k, (text, cuts) in CASES.items():
        assert got.get(k, []) == [(a, text[a:b].strip()) for a, b in cuts], f"case {k}"


def _check(text, size, overlap):
    """Bounds that any chunking by the rule keeps."""
    cuts = list(spans(text, size, overlap))
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
    for (a, b), (c, d) in zip(cuts, cuts[1:], strict=False):
        assert a < c <= b < d and b - c <= overlap
    assert all(0 < b - a <= size for a, b in cuts)
    chunks = split_text(text, size, overlap)
    assert chunks == [(a, text[a:b].strip()) for a, b in cuts if text[a:b].strip()]


def test_random_texts():
    rnd = random.Random(7)
    words = ["a", "bb", "ccc", "dddddd", "e" * 30, "f" * 120, "", "\n", "\n\n", "g" * 300]
    for _ in range(200):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 200)))
        if text:
            _check(text, rnd.choice([40, 100, 1000]), rnd.choice([0, 10]))


def test_documents(spark):
    from quarry.functions.text import clean_text
    docs = (spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
            .select("doc_id", "text", clean_text(F.col("text")).alias("clean")))
    for r in docs.collect():
        for text in (r.text, r.clean):
            if text:
                _check(text, 1000, 50)


@pytest.mark.parametrize("unit", ["word ", "字"])
def test_time_is_linear_in_the_length(unit):
    """With spaces and without; the bound leaves room for a busy machine."""
    def took(n):
        best = 9e9
        for _ in range(3):
            t = time.process_time()
            split_text(unit * (n // len(unit)))
            best = min(best, time.process_time() - t)
        return best
    assert took(2_000_000) < 5 * max(took(1_000_000), 0.005)


def test_batches_go_a_stretch_at_a_time():
    """Chunks, ids and texts are made of stretches of a batch: every row once, in order."""
    import pyarrow as pa

    from quarry.operators import batches
    sizes = [3, 0, 50, 7, 7, 7, 0, 1, 20]
    texts = ["x" * n if n else None for n in sizes]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sizes))), pa.array(texts, pa.string())], names=["k", "t"])
    out = list(batches.stretches(iter([batch, batch.slice(0, 0), batch.slice(4)]), 1, 10))
    assert [x for b in out for x in b.column(1).to_pylist()] == texts + texts[4:]
    assert all(sum(len(x or "") for x in b.column(1).to_pylist()[1:]) < 10 for b in out)
    assert max(b.num_rows for b in out) < 5
