"""Secret scan: fixed patterns, plus character Markov models of random strings
and of ordinary identifiers compared by log-likelihood ratio.

Patterns (see ``PATTERNS``) are matched leftmost and non-overlapping per kind,
matches that are too short are dropped afterwards.  The models are first-order
transition tables over the characters of tokens, trained from samples that the
patterns label: the values of pattern matches are random strings, the rest of the
text's tokens are ordinary.  Counting covers every text; a table has 66 x 66 cells
whatever the size of the corpus.

* Ordinary identifiers are words put together: by separators, by case, by digits.
  The step from one class of characters to the next has the share that
  identifiers of all styles have (``STEPS``, a fixed value: prose has few of them
  to count); a letter after a letter has the folded bigram share that the ordinary
  tokens of the corpus give it, a letter that begins a part its share of letters.
* There are two random models: the steps and characters of the labelled values, and
  draws in which all characters are equally likely.  The likelier one counts.

A token, or what is left of it outside all pattern matches, is a further span, kind
``markov``, when its log-likelihood ratio exceeds ``THRESHOLD`` for each
transition, and as much as ``FULL_TOKEN`` characters need in all: shorter ones take
stronger evidence.  Digits alone are as likely an ordinary number.

Spans are code points, end exclusive.  Defined results: null and empty texts
have no spans; without any labelled sample the tables are uniform and add
nothing; repeated rows are scanned each.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import sparse_counts, utf8

# --- fixed values -----------------------------------------------------------
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
MIN_VALUE = 8
# a run that is long enough is the run's only match, so the length is part of these two
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
# ----------------------------------------------------------------------------
TOKEN_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
FULL_TOKEN = 20
THRESHOLD = 0.75         # nats per transition
SMOOTHING = 5.0          # counts of each character, and of each letter pair by the letters' shares
RANDOM_PRIOR = 100.0     # steps drawn evenly that the labelled values are added to
MASK = "[secret]"

# --- fixed value: shares of the steps between lower case, upper case, digit and separator in identifiers ---
STEPS = np.array([[0.85, 0.06, 0.03, 0.06], [0.30, 0.58, 0.04, 0.08], [0.10, 0.05, 0.60, 0.25], [0.65, 0.20, 0.10, 0.05]])
# ------------------------------------------------------------------------------------------------------------
STATES = len(TOKEN_CHARS) + 1      # 0: outside a token
CLASS = np.array([0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in TOKEN_CHARS])
CLASS_SIZE = np.bincount(CLASS)
LETTER = np.array([ord(c.lower()) - ord("a") if c.isalpha() else -1 for c in TOKEN_CHARS])
CODES = np.zeros(256, dtype=np.int64)
for _i, _c in enumerate(TOKEN_CHARS):
    CODES[ord(_c)] = _i + 1
HEX_MAP = bytes(ord("x") if chr(c) in "0123456789abcdef" else ord(" ") for c in range(256))


def base_spans(data: bytes, text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of the pattern matches, sorted."""
    out = []
    lower = data.lower()
    if any(w in lower for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if b"AKIA" in data:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
    if b"x" * 32 in data.translate(HEX_MAP):
        out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def transitions(codes: np.ndarray) -> np.ndarray:
    """Counts of neighbouring token characters, as a flat table."""
    pairs = codes[:-1] * STATES + codes[1:]
    return np.bincount(pairs[(codes[:-1] > 0) & (codes[1:] > 0)], minlength=STATES * STATES)


def text_codes(text: str) -> np.ndarray:
    """States of the code points of a text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return CODES[np.where(points < 256, points, 0)]


def count_samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Transition counts of a task: class 1 pattern values, class 0 the rest."""
    counts = np.zeros((2, STATES * STATES), dtype=np.int64)
    for b in batches:
        for data in utf8(b.column(0)):
            if not data:
                continue
            if data.isascii():
                codes = CODES[np.frombuffer(data, dtype=np.uint8)]
                text = data.decode("ascii")
            else:
                text = data.decode("utf-8", "replace")
                codes = text_codes(text)
            spans = base_spans(data, text)
            if spans:
                codes = codes.copy()
                for _, _, end, value in spans:
                    counts[1] += transitions(codes[value:end])
                for start, _, end, _ in spans:
                    codes[start:end] = 0
            counts[0] += transitions(codes)
    for c in (0, 1):
        yield sparse_counts(counts[c], kind=c)


def random_shares(counts: np.ndarray) -> np.ndarray:
    """P(next | character) of random strings: steps between classes, and characters
    within a class, of the labelled values."""
    steps = np.tile(RANDOM_PRIOR * CLASS_SIZE / CLASS_SIZE.sum(), (4, 1))
    np.add.at(steps, (CLASS[:, None], CLASS[None, :]), counts)
    steps /= steps.sum(axis=1, keepdims=True)
    chars = counts.sum(axis=0) + counts.sum(axis=1) + SMOOTHING
    return steps[CLASS][:, CLASS] * (chars / np.bincount(CLASS, weights=chars)[CLASS])[None, :]


def ordinary_shares(counts: np.ndarray) -> np.ndarray:
    """P(next | character) of ordinary identifiers: ``STEPS`` between classes, letters
    by folded bigrams within a part and by their shares where a part begins."""
    is_letter = LETTER >= 0
    folded = LETTER[is_letter]
    pairs = np.zeros((26, 26))
    np.add.at(pairs, (folded[:, None], folded[None, :]), counts[np.ix_(is_letter, is_letter)])
    first = pairs.sum(axis=0) + 0.002 * pairs.sum() + 1.0
    first /= first.sum()
    pairs += (0.1 * pairs.sum(axis=1, keepdims=True) + SMOOTHING) * first
    pairs /= pairs.sum(axis=1, keepdims=True)
    within = np.tile(1.0 / CLASS_SIZE[CLASS], (len(CLASS), 1))
    within[:, is_letter] = first[folded]
    inner = np.outer(is_letter, is_letter) & ~np.outer(CLASS == 0, CLASS == 1)     # a capital after a small letter begins a part
    within[inner] = pairs[LETTER[:, None], LETTER[None, :]][inner]
    return STEPS[CLASS][:, CLASS] * within


def train(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log-likelihood ratios of every transition, (random over ordinary) by random
    model: of the labelled values, and of even draws."""
    rows = (docs.select(F.col(text_col).alias("text")).mapInArrow(count_samples, "kind int, slot long, n long")
            .groupBy("kind", "slot").agg(F.sum("n").alias("n")).toArrow())
    counts = np.zeros((2, STATES * STATES))
    counts[rows["kind"].to_numpy(), rows["slot"].to_numpy()] = rows["n"].to_numpy()
    counts = counts.reshape(2, STATES, STATES)[:, 1:, 1:]
    out = np.zeros((2, STATES, STATES))
    ordinary = np.log(ordinary_shares(counts[0]))
    out[0, 1:, 1:] = np.log(random_shares(counts[1])) - ordinary
    out[1, 1:, 1:] = -np.log(len(TOKEN_CHARS)) - ordinary
    return out if counts[1].any() else np.zeros_like(out)


def find_spans(data: bytes | None, ratio: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans of a text, in order."""
    if not data:
        return []
    text = data.decode("utf-8", "replace")
    base = base_spans(data, text)
    out = [(start, kind, end) for start, kind, end, _ in base]
    codes = CODES[np.frombuffer(data, dtype=np.uint8)] if data.isascii() else text_codes(text)
    for start, _, end, _ in base:
        codes[start:end] = 0
    edges = np.flatnonzero(np.diff(codes > 0, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros((len(ratio), len(codes)))
    np.cumsum(ratio[:, codes[:-1], codes[1:]], axis=1, out=sums[:, 1:])
    steps = ends - starts - 1
    random = (sums[:, ends - 1] - sums[:, starts]).max(axis=0) > threshold * np.maximum(steps, FULL_TOKEN - 1)
    out += [(s, 3, e) for s, e in zip(starts[random].tolist(), ends[random].tolist(), strict=True)]
    return sorted(out)


def scanned(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find_spans(t, shared.value)]
                     for t in utf8(b.column(b.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(spans, kind)],
                                             names=[*b.schema.names[:-1], "spans"])
    return run


def scan(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, spans`` of every document; spans are (kind, start, end) in order."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scanned(shared), f"id {rows.schema['id'].dataType.simpleString()}, "
                                            "spans array<struct<kind:string,start:bigint,end:bigint>>")


def masked(data: bytes, ratio: np.ndarray) -> bytes:
    """The text with every span, overlapping ones together, replaced by ``MASK``."""
    spans = find_spans(data, ratio)
    if not spans:
        return data
    text, parts, at = data.decode("utf-8", "replace"), [], 0
    for start, _, end in spans:
        if start >= at:
            parts += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*parts, text[at:]]).encode("utf-8")


def masking(shared: Broadcast, place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([t if not t else masked(t, shared.value) for t in utf8(b.column(place))], pa.binary())
            columns = list(b.columns)
            columns[place] = texts.cast(b.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)
    return run


def mask_secrets(docs: DataFrame, ratio: np.ndarray, text_col: str = "text") -> DataFrame:
    """``docs`` with the secrets of their texts masked; all rows and columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    return docs.mapInArrow(masking(shared, docs.columns.index(text_col)), docs.schema)


def span_digest(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")
