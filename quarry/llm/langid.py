"""Language ID: word-first backoff.

A known word is scored by its log frequency per language; an unseen word by
character n-grams: at each place the longest known one, from five characters
down to one, and their mean counts like one word.  A document's language has
the highest sum, its score is that language's share of the posterior under
equal priors.

Training counts every word of every labelled text (partial sums per task, then
one shuffle); n-grams are counted over the distinct words, weighted.  A word or
n-gram is known, with its counts in all languages, when it makes up at least
1 / s of the words (of n-grams of that length) of any language, where s is a
language's share of ``CAPACITY``.  By that definition there are at most
``CAPACITY`` known words whatever the size of the corpus, which bounds the model
that is broadcast.  Every language's totals are in the model, also those of a
language without any known word (one that is written without spaces, say), and
what a language lacks has the same small frequency in all of them.
Where more than ``MAX_LANGUAGES`` values are labelled, those with most words are
learned.

Defined results: a null text or one without a letter is ``und`` with score 0;
a text whose words and characters are all unknown gets the language with the
smallest name and an even share; null languages and null texts teach nothing;
without any training row every text is ``und``; repeated rows count and are
predicted each; ties go to the smaller language name.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import text_pieces, utf8
from quarry.llm.words import slices
from quarry.session import cut_lineage

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
MAX_GRAM = 5
CAPACITY = 200_000       # known words of all languages together, in equal shares
MAX_LANGUAGES = 512      # a matrix of the model has known units x languages cells
REMEMBERED = 100_000     # unseen words a task keeps the scores of
SMOOTHING = 0.5
LOCAL_WORDS = 200_000    # distinct words a counting task holds before it passes them on
WORDS_TOGETHER = 1 << 16  # words whose n-grams are hashed at a time
UNKNOWN = "und"


def words_in(text: bytes) -> Iterator[list[str]]:
    for piece in text_pieces(text):
        found = WORD.findall(piece.decode("utf-8", "replace").lower())
        if found:
            yield found


def gram_codes(words: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Hashes of the n-grams of the marked words, all words at once: the word of
    each place, and per length 1, 2, ... the hash of the n-gram that begins at
    each place (0 where the word is too short, or for a mark alone)."""
    text = "".join([f"<{w}>" for w in words])
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    ends = np.cumsum(sizes)
    word = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(ends, sizes) - np.arange(len(points))
    begins = np.ones(len(points), dtype=bool)
    begins[ends - 1] = False
    single = begins.copy()
    single[ends - sizes] = False
    out, rolling = [], np.zeros(len(points), dtype=np.uint64)
    for n in range(1, MAX_GRAM + 1):
        after = np.zeros(len(points), dtype=np.uint64)
        after[:max(0, len(points) - n + 1)] = points[n - 1:]
        rolling = rolling * np.uint64(0x9E3779B97F4A7C15) + after + np.uint64(n)
        mixed = (rolling ^ (rolling >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        ok = (left >= n) & (single if n == 1 else begins)
        out.append(np.where(ok, mixed | np.uint64(1), np.uint64(0)))
    return word, out


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) rows to (lang, word, n) partial sums."""
    held: dict[str, Counter] = {}

    def passed_on() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(counts)), pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())],
                names=["lang", "word", "n"])
        held.clear()

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
            counts = held.setdefault(lang, Counter())
            for words in words_in(text):
                counts.update(words)
            if sum(map(len, held.values())) > LOCAL_WORDS:
                yield from passed_on()
    yield from passed_on()


def word_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) rows to (lang, gram, length, n) sums per batch; ``gram``
    is the n-gram's hash."""
    for b in batches:
        langs = b.column(0).dictionary_encode()
        lang, names = langs.indices.to_numpy(), langs.dictionary
        weight = b.column(2).to_numpy()
        for at in range(0, b.num_rows, WORDS_TOGETHER):
            some = slice(at, at + WORDS_TOGETHER)
            word, codes = gram_codes(b.column(1).slice(at, WORDS_TOGETHER).to_pylist())
            for n, code in enumerate(codes, start=1):
                place = np.flatnonzero(code)
                of = lang[some][word[place]]
                for k in np.unique(of):
                    mine = place[of == k]
                    key, inverse = np.unique(code[mine], return_inverse=True)
                    total = np.bincount(inverse, weights=weight[some][word[mine]], minlength=len(key)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [names.take(pa.array(np.full(len(key), k))), pa.array(key.view(np.int64)),
                         pa.array(np.full(len(key), n, np.int32)), pa.array(total)], names=["lang", "gram", "length", "n"])


def known(counts: DataFrame, unit: str, by: list[str], capacity: int) -> tuple[DataFrame, DataFrame]:
    """All rows of the units that make up at least 1 / capacity of some
    language's total, and the totals: one row per language (and length), written
    out, so they are broadcast below the session's limit."""
    totals = cut_lineage(counts.groupBy("lang", *by).agg(F.sum("n").alias("total")))
    rows = counts.join(totals, ["lang", *by]).select("lang", F.col(unit).alias("unit"), "n", "total", *by)
    often = cut_lineage(rows.where(F.col("n") * F.lit(capacity) >= F.col("total")).select("unit", *by).distinct())
    return rows.join(often, ["unit", *by]).select("lang", "unit", "n", *by), totals


def learned(words: DataFrame) -> list[str]:
    """The languages, in order: all, or the ``MAX_LANGUAGES`` with most words."""
    most = words.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES)
    return sorted(r.lang for r in most.collect())


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", capacity: int = CAPACITY) -> dict:
    """Model: ``langs`` in order, and log-frequency rows for words and n-grams."""
    rows = (docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
            .select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")))
    words = cut_lineage(rows.mapInArrow(count_words, "lang string, word string, n long")
                        .groupBy("lang", "word").agg(F.sum("n").alias("n")))
    langs = learned(words)
    words = words.where(F.col("lang").isin(langs))
    grams = cut_lineage(words.repartition(4 * words.sparkSession.sparkContext.defaultParallelism)
                        .mapInArrow(word_grams, "lang string, gram long, length int, n long")
                        .groupBy("lang", "gram", "length").agg(F.sum("n").alias("n")))
    share = max(1, capacity // max(1, len(langs)))
    grams = table(*known(grams, "gram", ["length"], share), langs, ["length"])
    codes = np.fromiter(grams["index"], dtype=np.int64, count=len(grams["index"])).view(np.uint64)
    order = np.argsort(codes)
    return {"langs": langs, "words": table(*known(words, "word", [], share), langs, []),
            "grams": {"codes": codes[order], "logs": grams["logs"][order]}}


def table(rows: DataFrame, totals: DataFrame, langs: list[str], by: list[str]) -> dict:
    """Known units and a matrix of smoothed log frequencies (units x languages),
    by every language's total; at most capacity x languages cells.  All languages
    have one floor, that of the largest: were it each one's own, a word that a large
    language has would be likelier in a small one that lacks it."""
    place = {x: i for i, x in enumerate(langs)}
    size = np.zeros((MAX_GRAM + 1, len(langs)))            # per length; 0 for words
    for r in totals.collect():                             # a row per language (and length)
        size[r["length"] if by else 0, place[r.lang]] = r.total
    got = rows.toArrow()
    units = got.column("unit").to_pylist()
    index: dict[str, int] = {}
    row = np.fromiter((index.setdefault(u, len(index)) for u in units), dtype=np.int64, count=len(units))
    col = np.fromiter((place[x] for x in got.column("lang").to_pylist()), dtype=np.int64, count=len(units))
    length = np.zeros(len(index), dtype=np.int64)
    if by:
        length[row] = got.column("length").to_numpy()
    floor = SMOOTHING / np.maximum(size.max(axis=1, initial=0.0), 1.0)     # per length
    logs = np.repeat(np.log(floor[length])[:, None], len(langs), axis=1)
    logs[row, col] = np.log(got.column("n").to_numpy() / size[length[row], col] + floor[length[row]])
    return {"index": index, "logs": logs}


class Scorer:
    """Sums of word scores."""

    def __init__(self, model: dict):
        self.langs = model["langs"]
        self.words, self.logs = model["words"]["index"], model["words"]["logs"]
        self.grams, self.gram_logs = model["grams"]["codes"], model["grams"]["logs"]
        self.memory: dict[str, np.ndarray] = {}

    def backed_off(self, words: list[str]) -> np.ndarray:
        """A row of scores for each of the unseen words: the mean over its places
        of the longest known n-gram there, zero if none is known."""
        out = np.zeros((len(words), len(self.langs)))
        if not words or not len(self.grams):
            return out
        word, codes = gram_codes(words)
        row = np.full(len(word), -1, dtype=np.int64)
        for code in reversed(codes):
            open_ = np.flatnonzero((row < 0) & (code != 0))
            at = np.minimum(np.searchsorted(self.grams, code[open_]), len(self.grams) - 1)
            hit = self.grams[at] == code[open_]
            row[open_[hit]] = at[hit]
        found = row >= 0
        n = np.bincount(word[found], minlength=len(words))
        for j in range(len(self.langs)):
            out[:, j] = np.bincount(word[found], weights=self.gram_logs[row[found], j], minlength=len(words))
        return out / np.maximum(n, 1)[:, None]

    def unseen(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word: remembered, or backed off now."""
        if len(self.memory) + len(words) > REMEMBERED:
            self.memory.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.memory]
        for at in range(0, len(new), WORDS_TOGETHER):
            some = new[at:at + WORDS_TOGETHER]
            self.memory.update(zip(some, self.backed_off(some), strict=True))
        return np.array([self.memory[w] for w in words]).reshape(len(words), len(self.langs))

    def sums(self, text: bytes | None) -> np.ndarray | None:
        return self.all_sums([text])[0]

    def all_sums(self, texts: list[bytes | None]) -> list[np.ndarray | None]:
        """Scores of some texts by language; null without a word."""
        totals: list[np.ndarray | None] = [None] * len(texts)
        left: list[str] = []                                # unseen words, and the text of each
        of: list[int] = []

        def settle() -> None:
            scores = self.unseen(left)
            for j in range(len(self.langs)):
                added = np.bincount(of, weights=scores[:, j], minlength=len(texts))
                for i in set(of):
                    totals[i][j] += added[i]
            left.clear()
            of.clear()

        for i, text in enumerate(texts):
            for words in words_in(text) if text else ():
                if totals[i] is None:
                    totals[i] = np.zeros(len(self.langs))
                code = np.fromiter(map(self.words.get, words, repeat(-1)), dtype=np.int64, count=len(words))
                seen = code[code >= 0]
                if len(seen):
                    totals[i] += self.logs[seen].sum(axis=0)
                if len(seen) < len(words):
                    some = np.flatnonzero(code < 0).tolist()
                    left += [words[k] for k in some]
                    of += [i] * len(some)
                if len(left) > WORDS_TOGETHER:
                    settle()
        if left:
            settle()
        return totals

    def predict(self, text: bytes | None) -> tuple[str, float]:
        return self.predict_all([text])[0]

    def predict_all(self, texts: list[bytes | None]) -> list[tuple[str, float]]:
        """Language and score of some texts."""
        out = []
        for sums in self.all_sums(texts) if self.langs else [None] * len(texts):
            if sums is None:
                out.append((UNKNOWN, 0.0))
            else:
                best = int(np.argmax(sums))
                out.append((self.langs[best], float(1.0 / np.exp(np.maximum(sums - sums[best], -700)).sum())))
        return out


def predictions(model: Broadcast, text_place: int, kept: int, names: list[str]):
    """The first ``kept`` columns, language and score of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for b in batches:
            texts = utf8(b.column(text_place))
            got = [g for begin, end in slices(texts) for g in scorer.predict_all(texts[begin:end])]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:kept], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                names=names)
    return run


def identify(docs: DataFrame, model: dict, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",),
             names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns of every document with its language and score (called
    ``names``); the prediction sees the text only."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, *[text_col][text_col in keep:])
    schema = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]
    return rows.mapInArrow(predictions(shared, rows.columns.index(text_col), len(keep), [*keep, *names]),
                           ", ".join([*schema, f"`{names[0]}` string", f"`{names[1]}` double"]))
