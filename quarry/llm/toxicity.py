"""Toxicity: class-conditional Kneser-Ney models of word bigrams.

Two models, of toxic and of ordinary documents, give each word a probability
after the word before it:

    P_c(w | h) = ((n_c(h, w) - D)+ + (D t_c(h) + B) P_c(w)) / (n_c(h) + B)
    P_c(w)     = ((k_c(w) - D)+ + (D T_c + B) S(w)) / (K_c + B)

n counts the bigram and its context, t the kinds of words after h, k the kinds
of words before w, K and T the sum and the number of the latter, all in class c:
raw counts for bigrams and kinds for single words, as Kneser-Ney smoothing has
it.  S is shared: half the frequency of w in the whole corpus, half an even share
of the known words.  The backoff weighs as much as B counts, ``PRIOR`` for each
known word, in both classes (the strength of a Pitman-Yor prior), so a rare
expression moves the ratio by as much as its counts say.

Three measures come of the ratios of a document's words: their mean (the
length-normalised log-likelihood ratio of the document), the greatest mean over
its windows of ``WINDOW`` words (of the whole text, if shorter), and how many
windows it has.  The score follows the greatest window, as one abusive passage
makes a document toxic however long the rest is.  The greatest of many windows is
larger by chance, so what ordinary sample rows of as many windows have on average
(a line over the logarithm of their number, level beyond the longest such row) is
taken off; a logistic curve turns the rest into a probability.  Line and curve are
fitted on sample rows that were not counted.

The class models are fitted on a sample of at most ``CLASS_ROWS`` labelled rows
of each class (smallest hashes of their id, one row per id) and ``SAMPLE_BYTES`` of
text.  S counts every word of every
document.  Every word, context and bigram of the counted rows is in the model,
which the sample bounds; rare ones are left to the discount and the backoff.  Words
that no counted row has are unknown, their ratio is 0.

Words are runs of ASCII letters and non-ASCII characters, A-Z lower-cased.
Defined results: a text without words has the score of ratio 0; without labels
of both classes every score is 0; rows without a usable label or id teach
nothing; repeated rows are scored each.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import compress, crc32, decompress

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import labelled, sampled_texts, sparse_counts, text_pieces, utf8
from quarry.llm.words import slices
from quarry.session import cut_lineage

CLASS_ROWS = 10_000
SAMPLE_BYTES = 256 << 20  # text of the sample
CALIBRATION = 4          # one in so many sample rows is left out of the counts
DISCOUNT = 0.75
PRIOR = 8                # counts of the backoff for each known word
WINDOW = 2
SLICE_BITS = 3           # the bigrams come to the driver in so many (as a power of 2) parts
LOCAL_PAIRS = 1 << 20    # bigrams a counting task holds before it passes them on
START = 1                # hash that stands before the first word
LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
LOW = np.uint64(0xFFFFFFFF)


def words_of(text: bytes | None) -> np.ndarray:
    parts = [np.zeros(0, dtype=np.uint64)]
    for piece in text_pieces(text or b""):
        words = piece.lower().translate(LETTERS).split()
        parts.append(np.fromiter(map(crc32, words), dtype=np.uint64, count=len(words)))
    return np.concatenate(parts)


def pairs_of(words: np.ndarray) -> np.ndarray:
    """(word before, word) of every word, as one number."""
    before = np.concatenate([np.array([START], dtype=np.uint64), words[:-1]])[:len(words)]
    return before << np.uint64(32) | words


def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, text) to (label, pair, n) partial sums."""
    held: dict[int, list[np.ndarray]] = {0: [], 1: []}

    def passed_on() -> Iterator[pa.RecordBatch]:
        for label, parts in held.items():
            if parts:
                pair, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(pair), label, np.int32)), pa.array(pair.view(np.int64)), pa.array(n.astype(np.int64))],
                    names=["label", "pair", "n"])
                parts.clear()

    waiting = 0
    for b in batches:
        for label, text in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
            words = words_of(text)
            held[label].append(pairs_of(words))
            waiting += len(words)
            if waiting > LOCAL_PAIRS:
                yield from passed_on()
                waiting = 0
    yield from passed_on()


def counting(shared: Broadcast):
    """Counts of the known words, and of all words as one more slot."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        counts = np.zeros(len(known) + 1, dtype=np.int64)
        for b in batches:
            texts = utf8(b.column(0))
            for begin, end in slices(texts):
                words, n = np.unique(np.concatenate([words_of(t) for t in texts[begin:end]]), return_counts=True)
                at, found = place(known, words)
                counts[at[found]] += n[found]
                counts[-1] += n.sum()
        yield sparse_counts(counts, kind=0)
    return run


def corpus_frequency(docs: DataFrame, text_col: str, known: np.ndarray) -> np.ndarray:
    """S of every known word, from its frequency over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(known)
    rows = (docs.select(F.col(text_col).alias("text")).mapInArrow(counting(shared), "kind int, slot long, n long")
            .groupBy("slot").agg(F.sum("n").alias("n")).toArrow())
    counts = np.zeros(len(known) + 1)
    counts[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    return 0.5 * (counts[:-1] + 0.5) / (counts[-1] + 0.5) + 0.5 / max(1, len(known))


def sample_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """``label, text, part`` of the sample, written out once."""
    order = F.xxhash64(F.col("of").cast("string"))
    usable = labelled(labels, id_col, label_col)
    some = [usable.where(F.col("label") == c).orderBy(order, "of").limit(CLASS_ROWS) for c in (0, 1)]
    ids = some[0].union(some[1])
    return (sampled_texts(docs, ids, id_col, text_col, SAMPLE_BYTES)
            .select("label", "text", F.pmod(F.shiftright(order, 8), F.lit(CALIBRATION)).alias("part")))


def train(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "toxic") -> dict | None:
    """Model from the rows of ``docs`` that ``labels`` names; ``corpus``
    (default ``docs``) gives the shared frequencies."""
    sample = sample_rows(docs, labels, id_col, text_col, label_col)
    in_class = lambda c: F.coalesce(F.sum(F.when(F.col("label") == c, F.col("n"))), F.lit(0))
    both = cut_lineage(sample.where("part <> 0").select("label", "text")
                       .mapInArrow(count_pairs, "label int, pair long, n long")
                       .groupBy("pair").agg(in_class(1).alias("nt"), in_class(0).alias("no")))
    if not (total := both.agg(F.sum("nt"), F.sum("no")).first())[0] or not total[1]:
        return None
    before, word = F.shiftrightunsigned("pair", 32), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    kinds_of = [F.count(F.when(F.col("nt") > 0, 1)).alias("kt"), F.count(F.when(F.col("no") > 0, 1)).alias("ko")]
    words = cut_lineage(both.groupBy(word.alias("word")).agg(*kinds_of))
    kinds = words.agg(F.sum("kt"), F.sum("ko"), F.count(F.when(F.col("kt") > 0, 1)), F.count(F.when(F.col("ko") > 0, 1))).first()
    kept = words.toArrow()
    contexts = (both.groupBy(before.alias("word"))
                .agg(F.sum("nt").alias("nt"), F.sum("no").alias("no"), *kinds_of)).toArrow()
    known = np.sort(kept["word"].to_numpy()).astype(np.uint64)
    frequency = corpus_frequency(corpus if corpus is not None else docs, text_col, known)
    model = tables(kept, contexts, kinds, frequency)
    del kept, contexts
    counts = model.pop("count")
    packs = {k: packed([v]) for k, v in model.items()}
    parts = []
    for part in range(1 << SLICE_BITS):      # never all bigrams at once; the first word's hash orders the parts
        rows = both.where(F.shiftrightunsigned("pair", 64 - SLICE_BITS) == part)
        parts.append(shares(model["context"], counts, rows.select("pair", "nt", "no").orderBy("pair").toArrow()))
        parts[-1] = {k: packed([v]) for k, v in parts[-1].items()}
        pa.default_memory_pool().release_unused()
    packs |= {k: [x for p in parts for x in p[k]] for k in parts[0]}
    shared = docs.sparkSession.sparkContext.broadcast(packs)
    return {"shared": shared, "curve": calibrate(sample.where("part = 0").select("label", "text"), shared,
                                                 labelled(labels, id_col, label_col))}


def packed(arrays: list[np.ndarray]) -> list[tuple]:
    """Arrays, compressed one by one."""
    return [(v.dtype.str, v.shape, compress(np.ascontiguousarray(v), 3)) for v in arrays]


def unpacked(value: dict) -> dict:
    """The arrays of a model; parts are put one after the other, each is
    decompressed alone."""
    out = {}
    for name, parts in value.items():
        kind, shape, _ = parts[0]
        whole = np.empty((*shape[:-1], sum(p[1][-1] for p in parts)), dtype=kind)
        at = 0
        for _, size, data in parts:
            whole[..., at:at + size[-1]] = np.frombuffer(decompress(data), dtype=kind).reshape(size)
            at += size[-1]
        out[name] = whole
    return out


def tables(kept: pa.Table, contexts: pa.Table, kinds: tuple, frequency: np.ndarray) -> dict:
    """Sorted arrays, toxic first: P_c of words, backoff weights of contexts and
    their counts with the prior's."""
    d = DISCOUNT
    by = lambda t, key: {c: t[c].to_numpy()[np.argsort(t[key].to_numpy(), kind="stable")] for c in t.column_names}
    w, c = by(kept, "word"), by(contexts, "word")
    prior = PRIOR * len(w["word"])
    total = np.array([[kinds[0]], [kinds[1]]], dtype=np.float64) + prior
    back = (d * np.array([[kinds[2]], [kinds[3]]]) + prior) / total
    single = np.maximum(np.stack([w["kt"], w["ko"]]) - d, 0) / total + back * frequency
    count = np.stack([c["nt"], c["no"]]).astype(np.float64) + prior
    weight = (d * np.stack([c["kt"], c["ko"]]) + prior) / count
    return {"word": w["word"].astype(np.uint64), "single": single, "context": c["word"].astype(np.uint64), "weight": weight, "count": count}


def shares(context: np.ndarray, count: np.ndarray, seen: pa.Table) -> dict:
    """Discounted shares of bigrams in order; every bigram's context is there."""
    pair = seen["pair"].to_numpy().view(np.uint64)
    n = np.stack([seen["nt"].to_numpy(), seen["no"].to_numpy()])
    of = count[:, np.searchsorted(context, pair >> np.uint64(32))]
    return {"pair": pair, "direct": (np.maximum(n - DISCOUNT, 0) / of).astype(np.float32)}


def place(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of each key in a sorted array and whether it is there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def pair_ratios(model: dict, pairs: np.ndarray) -> np.ndarray:
    """log P_toxic - log P_ordinary of the second word of each pair after the first;
    in sorted order neighbouring searches touch the same parts of the model."""
    out = np.zeros(len(pairs))
    at, known = place(model["word"], pairs & LOW)
    at, pairs = at[known], pairs[known]
    if not len(at):
        return out
    p = model["single"][:, at]
    ctx, has = place(model["context"], pairs >> np.uint64(32))
    p = np.where(has, model["weight"][:, ctx], 1.0) * p if has.any() else p
    at, seen = place(model["pair"], pairs)
    if seen.any():
        p[:, seen] += model["direct"][:, at[seen]]
    out[known] = np.log(p[0]) - np.log(p[1])
    return out


def measures(model: dict, texts: list[bytes | None]) -> np.ndarray:
    """(greatest window mean, mean of all words, windows) of each text; every
    distinct pair of a slice of texts is looked up once."""
    out = np.zeros((len(texts), 3))
    out[:, 2] = 1
    for begin, end in slices(texts):
        pairs = [pairs_of(words_of(t)) for t in texts[begin:end]]
        distinct, place_of = np.unique(np.concatenate(pairs), return_inverse=True)
        every = pair_ratios(model, distinct)[place_of]
        ends = np.cumsum([len(p) for p in pairs]).tolist()
        for row, a, z in zip(out[begin:end], [0, *ends[:-1]], ends, strict=True):
            if a == z:
                continue
            sums = np.concatenate([[0.0], np.cumsum(every[a:z])])
            width = min(WINDOW, z - a)
            row[:] = (sums[width:] - sums[:-width]).max() / width, sums[-1] / (z - a), z - a - width + 1
    return out


def measured(shared: Broadcast):
    """(label, text) to (label, best, windows)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = unpacked(shared.value)
        for b in batches:
            got = measures(model, utf8(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got[:, 0]), pa.array(got[:, 2])], names=["label", "best", "windows"])
    return run


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps with a little ridge."""
    design = np.stack([x, np.ones(len(x))], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (p - y)) + 1e-2 * np.array([beta[0], 0.0])
        curvature = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag([1e-2, 1e-6])
        step = np.linalg.solve(curvature, gradient)
        beta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(beta[0]), 1e-3), float(beta[1])


@dataclass
class Curve:
    """How measures become a probability."""
    growth: float = 0.0      # of the greatest window of ordinary texts with the logarithm of the windows
    longest: float = 0.0     # logarithm of the windows of the longest ordinary sample row
    slope: float = 1.0
    offset: float = 0.0

    def level(self, best: np.ndarray, windows: np.ndarray) -> np.ndarray:
        return best - self.growth * np.minimum(np.log(windows), self.longest)

    def probability(self, best: np.ndarray, windows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.level(best, windows) + self.offset, -30, 30)))


def calibrate(rows: DataFrame, shared: Broadcast, usable: DataFrame) -> Curve:
    """Curve from left-out sample rows, weighted to the classes' shares."""
    got = rows.mapInArrow(measured(shared), "label int, best double, windows double").toArrow()
    y, best, windows = (got[c].to_numpy().astype(np.float64) for c in ("label", "best", "windows"))
    order = np.lexsort((windows, best, y))   # rows come in any order, sums should not
    y, best, windows = y[order], best[order], windows[order]
    curve = Curve()
    if not 0 < y.sum() < len(y):
        return curve
    long = np.log(windows[y == 0])
    if len(np.unique(long)) > 1:
        apart = long - long.mean()
        curve.growth, curve.longest = max(0.0, float(apart @ best[y == 0] / (apart @ apart))), float(long.max())
    share = {r.label: r["count"] for r in usable.groupBy("label").count().collect()}
    weight = np.where(y == 1, share[1] / y.sum(), share[0] / (1 - y).sum())
    curve.slope, curve.offset = logistic(curve.level(best, windows), y, weight * len(y) / weight.sum())
    return curve


def scoring(shared: Broadcast | None, curve: Curve | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = unpacked(shared.value) if shared is not None else None
        for b in batches:
            got = measures(model, utf8(b.column(1))) if model else np.zeros((b.num_rows, 3))
            scores = curve.probability(got[:, 0], got[:, 2]) if model else got[:, 0]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores), pa.array(got[:, 1])], names=["id", "score", "mean_ratio"])
    return run


def score(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score, mean_ratio`` of every document, from its text only; the last is
    the mean log-likelihood ratio of all its words."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scoring(model and model["shared"], model and model["curve"]), f"id {rows.schema['id'].dataType.simpleString()}, score double, mean_ratio double")
