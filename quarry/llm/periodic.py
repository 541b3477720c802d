"""Runs of words that repeat periodically, found by seed and extend.

A run is a stretch of consecutive words with smallest period q and at least
max(``LEAST``, ``POWER`` * q) words that no neighbouring word extends keeping
the period.  Lags are taken in bands [2^j, 2^(j+1)).  A run of period q agrees
with itself, shifted by q, in at least max(LEAST, POWER * q) - q words; the least
of these over the band and all larger lags is the minimum guaranteed overlap k.
``POWER`` is 3 or more.  For each band

1. the k-grams of every text are indexed (numbered by doubling; only places whose
   shorter grams occur again in their text stay in the index);
2. the pairs of consecutive occurrences of a k-gram in one text with a lag of the
   band are its seeds.  k is at least as long as any period of the band, so inside
   a run equal k-grams are whole periods apart and the consecutive pairs hold
   every run; pairs of a period's multiple are never consecutive, so the period
   found is the smallest;
3. a seed is extended along its diagonal in both directions; the table of the
   furthest word covered per lag drops the seeds that an extension has passed.

Time is n log n in the words of a text, and a text needs no other text, so the
operator is one narrow pass.  A text is handled whole, whatever its length;
working memory is a multiple (about 20) of the longest text of a task.

Defined results: a null or empty text has no words and no runs; repeated rows are
handled each; ids may be null.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import utf8
from quarry.llm.words import Words, slices, split_words

LEAST = 6        # words of the shortest run
POWER = 4        # periods of the shortest run
FIRST_STEP = 64  # words compared at first when a seed is extended

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def guaranteed(low: int, least: int, power: int) -> int:
    """Words in which every run of period ``low`` or more agrees with itself."""
    if power < 3:
        raise ValueError("runs of fewer than three periods")
    return min(max(least, power * q) - q for q in range(low, max(low, least) + 1))


def repeated(left: np.ndarray, right: np.ndarray, width: int) -> np.ndarray:
    """Numbers from 0 of the pairs that occur more than once, -1 for the others."""
    key, inverse, n = np.unique(left * width + right, return_inverse=True, return_counts=True)
    number = np.where(n > 1, np.cumsum(n > 1) - 1, -1)
    return number[inverse]


class Grams:
    """Numbers of the grams that occur again in their text, at their first word."""

    def __init__(self, codes: np.ndarray, ends: np.ndarray):
        self.n = len(codes)
        self.end = np.repeat(ends, np.diff(ends, prepend=0))       # of each word's text
        self.size = 1
        self.at = np.arange(self.n)
        self._keep(self.at, repeated(np.searchsorted(ends, self.at, side="right"), codes, int(codes.max(initial=0)) + 1))

    def _keep(self, at: np.ndarray, number: np.ndarray) -> None:
        some = number >= 0
        self.at, values = at[some], number[some]
        self.name = np.full(self.n, -1, dtype=np.int64)
        self.name[self.at] = values

    def pairs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places whose ``k``-gram occurs again, and its number; ``k`` is between
        the present size and twice that."""
        step = k - self.size
        at = self.at[self.at + k <= self.end[self.at]]
        at = at[self.name[at + step] >= 0]
        number = repeated(self.name[at], self.name[at + step], self.n + 1)
        return at[number >= 0], number[number >= 0]

    def grow(self) -> None:
        at, number = self.pairs(2 * self.size)
        self._keep(at, number)
        self.size *= 2


def seeds(at: np.ndarray, number: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of consecutive occurrences with a lag of the band, by lag and place."""
    order = np.argsort(number, kind="stable")
    place, same = at[order], number[order][1:] == number[order][:-1]
    lag = np.diff(place)
    some = np.flatnonzero(same & (lag >= low) & (lag < high))
    place, lag = place[some], lag[some]
    order = np.lexsort((place, lag))
    return place[order], lag[order]


def agreeing(x: np.ndarray, y: np.ndarray) -> int:
    """How many first elements are equal."""
    at, step = 0, FIRST_STEP
    while at < len(x):
        differ = np.flatnonzero(x[at:at + step] != y[at:at + step])
        if len(differ):
            return at + int(differ[0])
        at += step
        step *= 2
    return len(x)


def text_runs(codes: np.ndarray, ends: np.ndarray, least: int = LEAST, power: int = POWER) -> np.ndarray:
    """(first word, length, period) rows of all runs, by first word and period;
    ``codes`` are the words of several texts, ``ends`` where these end."""
    found: list[tuple[int, int, int]] = []
    grams = Grams(codes, ends)
    longest = int(np.diff(ends, prepend=0).max(initial=0))
    low = 1
    while max(least, power * low) <= longest and len(grams.at):
        k = guaranteed(low, least, power)
        while 2 * grams.size <= k:
            grams.grow()
        place, lag = seeds(*grams.pairs(k), low, 2 * low)
        head = np.ones(len(place), dtype=bool)           # seeds of one diagonal, one word after the other
        head[1:] = (np.diff(lag) != 0) | (np.diff(place) != 1)
        covered: dict[int, int] = {}                     # furthest word that agrees, per lag
        for i, q in zip(place[head].tolist(), lag[head].tolist(), strict=True):
            if i < covered.get(q, -1):
                continue
            text = int(np.searchsorted(ends, i, side="right"))
            first, last = (int(ends[text - 1]) if text else 0), int(ends[text])
            right = i + agreeing(codes[i:last - q], codes[i + q:last])
            left = i - agreeing(codes[first:i][::-1], codes[first + q:i + q][::-1])
            covered[q] = right
            if right - left + q >= max(least, power * q):
                found.append((left, right - left + q, q))
        low *= 2
    rows = np.array(sorted(found), dtype=np.int64).reshape(-1, 3)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def repeats(rows: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` words a run has after its first period."""
    cover = np.zeros(n + 1, dtype=np.int64)
    np.add.at(cover, rows[:, 0] + rows[:, 2], 1)
    np.add.at(cover, rows[:, 0] + rows[:, 1], -1)
    return np.cumsum(cover[:-1]) > 0


def described(words: Words) -> list[pa.Array]:
    """(n_words, runs, collapsed) of some texts."""
    rows = text_runs(words.codes, words.ends)
    begins = np.concatenate([[0], words.ends[:-1]])
    text = np.searchsorted(words.ends, rows[:, 0], side="right")
    structs = pa.StructArray.from_arrays([pa.array(rows[:, 0] - begins[text]), pa.array(rows[:, 1]), pa.array(rows[:, 2])],
                                         names=["start", "length", "period"])
    edges = np.searchsorted(text, np.arange(len(words.ends) + 1))
    return [pa.array(words.ends - begins), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), structs),
            words.joined(~repeats(rows, len(words.codes))).cast(pa.string())]


def scanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = utf8(b.column(1))
        for begin, end in slices(texts):
            yield pa.RecordBatch.from_arrays([b.column(0).slice(begin, end - begin), *described(split_words(texts[begin:end]))],
                                             names=["id", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_words, runs, collapsed``: the runs of every text by start and
    period (word numbers), and its words without those that a run has after its
    first period, joined by one space."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(scanning, f"id {kind}, n_words long, runs {RUNS}, collapsed string")
