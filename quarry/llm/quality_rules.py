"""Quality rules: counts of a text's words, symbols and repeats, and a hashed
n-gram log-likelihood ratio between a trusted target and the raw corpus.

Words are runs of ``[^\\x20\\x09-\\x0D]``.  Unigrams and bigrams are hashed into
``BUCKETS`` cells; the raw multinomial counts every document, the target
multinomial the trusted ones.  A document's ratio is the mean over its n-grams
of log p(target) - log p(raw).  Every document is decided by the same
threshold, ``MARGIN`` below the ``TAIL`` quantile of the ratios of trusted
documents that were left out of the target's counts.

Every trusted row counts, half of them (by a hash of their id) for the target
and the others for the quantile, which is a Spark aggregate.  Only the two count
vectors are broadcast, so what is held is bounded whatever the size of the
corpus.

Defined results: null, empty and blank texts have no words and fail the base
rules; without trusted rows the ratio is 0 for all and only the base rules
decide; repeated rows are judged each.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import hashed_words, ngram_hashes, sparse_counts, utf8
from quarry.session import cut_lineage

MIN_WORDS = 20
WINDOW = 8
REPEAT_SHARE = 30        # percent of words in repeated windows
SYMBOLS = b"#*$%&|<>"
BUCKETS = 1 << 16
SMOOTHING = 1.0
TAIL = 0.002
RANKS = 100_000          # the quantile's rank is right to one in so many
MARGIN = 0.1


def cells_of(hashes: np.ndarray) -> np.ndarray:
    """Cells of all unigrams and bigrams of a text."""
    return (ngram_hashes(hashes) >> np.uint64(8)).astype(np.int64) % BUCKETS


def repeated_words(data: bytes, hashes: np.ndarray) -> int:
    """Words inside windows of ``WINDOW`` words that the text has at least twice."""
    n = len(hashes) - WINDOW + 1
    if n < 2:
        return 0
    code = np.zeros(n, dtype=np.uint64)
    for j in range(WINDOW):
        code = code * np.uint64(0x9E3779B97F4A7C15) + hashes[j:j + n]
        code ^= code >> np.uint64(29)
    _, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
    again = np.flatnonzero(counts[inverse] > 1)
    if not len(again):
        return 0
    words = data.split()
    seen: dict[tuple[bytes, ...], int] = {}          # equal hashes are not yet equal words
    windows = [tuple(words[i:i + WINDOW]) for i in again.tolist()]
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    starts = np.array([i for i, w in zip(again.tolist(), windows, strict=True) if seen[w] > 1], dtype=np.int64)
    if not len(starts):
        return 0
    covered = np.zeros(len(hashes) + 1, dtype=np.int64)
    covered[starts] += 1
    covered[starts + WINDOW] -= 1
    return int((np.cumsum(covered) > 0).sum())


def base_counts(data: bytes, hashes: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    kinds = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    chars = int(kinds.sum() - kinds[0x80:0xC0].sum() - kinds[9:14].sum() - kinds[32])
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\n\v\f\r")]
    return (len(hashes), chars, int(kinds[list(SYMBOLS)].sum()), len(lines) - len(set(lines)),
            repeated_words(data, hashes))


def count_ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for b in batches:
        for data in utf8(b.column(0)):
            np.add.at(counts, cells_of(hashed_words(data or b"")), 1)
    yield sparse_counts(counts, kind=0)


def cell_counts(texts: DataFrame) -> np.ndarray:
    """Counts of all n-grams of ``text``, per cell."""
    rows = (texts.mapInArrow(count_ngrams, "kind int, slot long, n long")
            .groupBy("slot").agg(F.sum("n").alias("n")).toArrow())
    counts = np.zeros(BUCKETS)
    counts[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    return counts


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    if not target.sum():
        return np.zeros(BUCKETS)
    share = lambda c: (c + SMOOTHING) / (c.sum() + SMOOTHING * BUCKETS)
    return np.log(share(target)) - np.log(share(raw))


def mean_ratio(hashes: np.ndarray, ratio: np.ndarray) -> float:
    cells = cells_of(hashes)
    return float(ratio[cells].mean()) if len(cells) else 0.0


def scoring(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for data in utf8(b.column(1)):
                data = data or b""
                hashes = hashed_words(data)
                out.append((*base_counts(data, hashes), mean_ratio(hashes, shared.value)))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(c, pa.int64()) for c in columns[:5]], pa.array(columns[5], pa.float64())],
                names=["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ratio"])
    return run


def measured(docs: DataFrame, ratio: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scoring(shared), f"id {rows.schema['id'].dataType.simpleString()}, n_words long, "
                           "word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double")


def rules(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, the counts, ``base_failed, ratio, kept`` of every document;
    ``trusted`` holds the ids of trusted documents."""
    half = F.pmod(F.shiftright(F.xxhash64(F.col("__id").cast("string")), 8), F.lit(2))
    ids = (trusted.select(F.col(id_col).alias("__id")).where(F.col("__id").isNotNull()).distinct()
           .withColumn("half", half))
    target = ids.where("half = 0")
    # merged at every size: the texts of trusted rows travel once, and the plan does not change as ids grow
    target = target.hint("merge")
    ratio = log_ratio(cell_counts(docs.join(target, docs[id_col] == F.col("__id")).select(docs[text_col].alias("text"))),
                      cell_counts(docs.select(F.col(text_col).alias("text"))))
    rows = cut_lineage(measured(docs, ratio, id_col, text_col))
    held = (rows.where(f"n_words >= {MIN_WORDS}").select("id", "ratio")
            .join(ids.where("half = 1"), F.col("id") == F.col("__id"))
            .agg(F.percentile_approx("ratio", TAIL, RANKS).alias("least")).first())
    threshold = held.least - MARGIN if held.least is not None else float("-inf")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_SHARE * F.col("n_words"))
    return (rows.withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= F.lit(threshold))))
