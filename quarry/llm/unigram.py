"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

A space becomes the marker U+2581, one is put before the text, and the best
segmentation is the one whose pieces' log scores have the greatest sum.  A
character that is no piece costs ``UNKNOWN_COST`` below the worst piece and is
written as its UTF-8 bytes' pieces.  Nothing is normalised and a marker that
stands in the text itself is written as bytes, so decoding gives back exactly
the text.

No piece of the vocabularies served has a marker after another character
(checked when the model is read), so a text falls into runs of spaces with the
word after them and each can be segmented alone.  Distinct segments of some
texts are solved together, position by position, and remembered up to
``CACHED`` per task.

The vocabulary file is read by the driver from a path that is a parameter and
its tables (bounded by the vocabulary) are broadcast.  A file of merge ranks
instead of log scores gets log scores by Zipf's law: -log(rank + 1).

Defined results: a null text has null pieces and decodes to null; an empty text
has none and decodes to the empty text; equal scores take the longer last
piece; repeated rows are encoded each.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁".encode()
LITERAL_MARK = 0xFE      # stands for a marker of the text; no UTF-8 text has this byte
UNKNOWN_COST = 10.0
SEGMENT = re.compile(rb" +[^ ]*")
TOGETHER = 1 << 20       # bytes of text handled at a time
ROWS_TOGETHER = 256      # rows decoded at a time
SEGMENTS_TOGETHER = 1 << 18  # bytes of new segments solved at a time
CACHED = 100_000         # segments a task remembers
CACHED_BYTES = 48        # longer segments are not remembered


@dataclass
class Model:
    base: np.ndarray         # double array: child of s by byte c is base[s] + c ...
    check: np.ndarray        # ... if its check is s
    piece: np.ndarray        # piece that ends in a state, or -1
    score: np.ndarray
    size: np.ndarray         # bytes of each piece
    byte_piece: np.ndarray   # piece of each byte value
    text: list[bytes]        # what each piece decodes to
    depth: int
    unknown: float


def double_array(words: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trie of ``words`` as base, check and value arrays, root at 0.  A state's
    children are placed together at the first offset where all fit."""
    children: list[dict[int, int]] = [{}]
    value = [-1]
    for word in sorted(words):
        at = 0
        for c in word:
            if c not in children[at]:
                children[at][c] = len(children)
                children.append({})
                value.append(-1)
            at = children[at][c]
        value[at] = words[word]
    room = 4 * len(children) + 1024
    base, check, out = np.zeros(room, np.int32), np.full(room, -1, np.int32), np.full(room, -1, np.int32)
    free = np.ones(room, dtype=bool)
    free[0] = False
    place, first = {0: 0}, 1
    out[0] = value[0]
    for node in range(len(children)):
        kids = children[node]
        if not kids:
            continue
        codes = np.fromiter(sorted(kids), dtype=np.int64)
        while not free[first]:
            first += 1
        start = max(1, first - int(codes[0]))
        while True:
            end = min(start + 4096, room - 256)
            if start >= end:
                raise ValueError("the trie does not fit its arrays")
            fits = free[codes[0] + start:codes[0] + end].copy()
            for c in codes[1:]:
                fits &= free[c + start:c + end]
            if fits.any():
                offset = start + int(np.argmax(fits))
                break
            start = end
        here = place.pop(node)
        base[here] = offset
        for c, kid in kids.items():
            t = offset + c
            free[t], check[t], out[t], place[kid] = False, here, value[kid], t
    return base, check, out


def load(path: str = MODEL) -> Model:
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return build([(sp.id_to_piece(i), sp.get_score(i), "byte" if sp.is_byte(i) else "other" if sp.is_control(i)
                   or sp.is_unknown(i) or sp.is_unused(i) else "piece") for i in range(sp.get_piece_size())])


def build(pieces: list[tuple[str, float, str]]) -> Model:
    """Model of (piece, score, kind) by id; kind is piece, byte or other."""
    own = [(i, p.encode(), s) for i, (p, s, kind) in enumerate(pieces) if kind == "piece"]
    marker = MARK.decode()
    for _, p, _ in own:
        if marker in p.decode().lstrip(marker):
            raise ValueError(f"piece {p!r} has a marker inside")
    ranks = sorted((-s for _, _, s in own))
    if ranks == list(range(len(ranks))) and len(ranks) > 1:
        own = [(i, p, -float(np.log1p(-s))) for i, p, s in own]
    byte_piece = np.full(256, -1, dtype=np.int32)
    score, size = np.zeros(len(pieces)), np.zeros(len(pieces), dtype=np.int64)
    text = [b""] * len(pieces)
    for i, (p, _, kind) in enumerate(pieces):
        if kind == "byte":
            byte_piece[int(p[3:5], 16)] = i
            text[i] = bytes([int(p[3:5], 16)])
    if (byte_piece < 0).any():
        raise ValueError("the vocabulary has no byte fallback")
    for i, p, s in own:
        score[i], size[i], text[i] = s, len(p), p.replace(MARK, b" ")
    base, check, out = double_array({p: i for i, p, _ in own})
    return Model(base, check, out, score, size, byte_piece, text, max(len(p) for _, p, _ in own),
                 min(s for _, _, s in own) - UNKNOWN_COST)


def matches(model: Model, buffer: np.ndarray, limit: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, end, piece) of every piece at the given places; ``limit`` is the
    end of the segment each place is in."""
    out_start, out_end, out_piece = [], [], []
    state = np.zeros(len(starts), dtype=np.int64)
    at = starts
    for _ in range(model.depth):
        inside = at < limit[starts]
        starts, at, state = starts[inside], at[inside], state[inside]
        if not len(starts):
            break
        nxt = model.base[state].astype(np.int64) + buffer[at]
        ok = model.check[nxt] == state
        starts, at, state = starts[ok], at[ok] + 1, nxt[ok]
        found = model.piece[state]
        hit = found >= 0
        out_start.append(starts[hit])
        out_end.append(at[hit])
        out_piece.append(found[hit].astype(np.int64))
    none = np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate([none, *x]) for x in (out_start, out_end, out_piece))


def segment_pieces(model: Model, segments: list[bytes]) -> list[bytes]:
    """Piece ids (int32 bytes) of each segment, by one Viterbi run over all."""
    forms = [s.replace(MARK, bytes([LITERAL_MARK])).replace(b" ", MARK) for s in segments]
    buffer = np.frombuffer(b"".join(forms), dtype=np.uint8)
    sizes = np.fromiter(map(len, forms), dtype=np.int64, count=len(forms))
    ends = np.cumsum(sizes)
    begins = ends - sizes
    limit, origin = np.repeat(ends, sizes), np.repeat(begins, sizes)
    # a segment's end is the next one's begin, so scores of ends are kept one place on
    best = np.full(len(buffer) + len(forms) + 1, -np.inf)
    back = np.full(len(best), -2, dtype=np.int64)            # piece, or -1 for an unknown character
    length = np.zeros(len(best), dtype=np.int64)
    order = np.arange(len(forms))
    shift = np.repeat(order, sizes)                          # place of a start is its byte + its segment's number
    best[begins + order] = 0.0
    lead = np.flatnonzero((buffer & 0xC0) != 0x80)           # first bytes of characters
    head = buffer[lead]
    width = np.where(head < 0x80, 1, np.where(head < 0xE0, 2, np.where(head < 0xF0, 3, np.where(head < 0xF8, 4, 1))))
    for at in range(0, len(lead), SEGMENTS_TOGETHER) if len(forms) == 1 else [0]:
        part = slice(at, at + SEGMENTS_TOGETHER) if len(forms) == 1 else slice(None)
        s, e, p = matches(model, buffer, limit, lead[part])
        alone = np.zeros(len(buffer), dtype=bool)
        chars = np.zeros(len(buffer), dtype=np.int64)
        chars[lead[part]] = width[part]
        alone[s[e - s == chars[s]]] = True
        lost = lead[part][~alone[lead[part]]]
        s = np.concatenate([s, lost])
        e = np.concatenate([e, lost + chars[lost]])
        p = np.concatenate([p, np.full(len(lost), -1)])
        gain = np.where(p >= 0, model.score[p], model.unknown)
        step = s - origin[s]
        by_step = np.argsort(step, kind="stable")
        s, e, p, gain, step = s[by_step], e[by_step], p[by_step], gain[by_step], step[by_step]
        source, target = s + shift[s], e + shift[s]
        cuts = np.flatnonzero(np.diff(step)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(step)], strict=True):
            # matches of one step end at different places
            value = best[source[a:b]] + gain[a:b]
            t = target[a:b]
            better = value > best[t]
            t = t[better]
            best[t], back[t], length[t] = value[better], p[a:b][better], (e[a:b] - s[a:b])[better]
    at, home = ends + order, begins + order
    offset = order
    starts, pieces = [], []
    while len(at):
        on = at > home
        at, home, offset = at[on], home[on], offset[on]
        if not len(at):
            break
        pieces.append(back[at])
        at = at - length[at]
        starts.append(at - offset)
    start = np.concatenate([np.zeros(0, np.int64), *starts])
    piece = np.concatenate([np.zeros(0, np.int64), *pieces])
    by_place = np.argsort(start, kind="stable")
    start, piece = start[by_place], piece[by_place]
    spread = np.ones(len(piece), dtype=np.int64)
    lost = piece < 0
    chars = np.zeros(len(buffer) + 1, dtype=np.int64)
    chars[lead] = width
    spread[lost] = np.where(buffer[start[lost]] == LITERAL_MARK, len(MARK), chars[start[lost]])
    ids = np.repeat(piece, spread)
    first = np.repeat(np.cumsum(spread) - spread, spread)
    within = np.arange(len(ids)) - first
    byte = ids < 0
    where = np.repeat(start, spread)[byte] + within[byte]
    head = buffer[np.repeat(start, spread)[byte]]
    value = np.where(head == LITERAL_MARK, np.frombuffer(MARK, np.uint8)[within[byte] % len(MARK)],
                     buffer[np.minimum(where, len(buffer) - 1)])
    ids[byte] = model.byte_piece[value]
    raw = ids.astype("<i4").tobytes()
    bounds = np.concatenate([[0], np.cumsum(spread)])[np.searchsorted(start, np.concatenate([begins, [len(buffer)]]))] * 4
    return [raw[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


class Encoder:
    def __init__(self, model: Model):
        self.model = model
        self.known: dict[bytes, bytes] = {}

    def encode(self, texts: list[bytes | None]) -> list[np.ndarray | None]:
        out: list[np.ndarray | None] = []
        at = 0
        while at < len(texts):
            end, total = at, 0
            while end < len(texts) and (end == at or total + len(texts[end] or b"") <= TOGETHER):
                total += len(texts[end] or b"")
                end += 1
            out += self.some(texts[at:end])
            at = end
        return out

    def some(self, texts: list[bytes | None]) -> list[np.ndarray | None]:
        parts = [SEGMENT.findall(b" " + t) if t else None for t in texts]
        new = set().union(*(p for p in parts if p)) - self.known.keys()
        group, size = [], 0
        for s in sorted(new, key=len):
            if group and size + len(s) > SEGMENTS_TOGETHER:
                self.known.update(zip(group, segment_pieces(self.model, group), strict=True))
                group, size = [], 0
            group.append(s)
            size += len(s)
        if group:
            self.known.update(zip(group, segment_pieces(self.model, group), strict=True))
        get = self.known.__getitem__
        out = [None if t is None else np.frombuffer(b"".join(map(get, p or ())), dtype="<i4")
               for t, p in zip(texts, parts, strict=True)]
        if len(self.known) > CACHED:
            self.known.clear()
        else:
            for s in new:
                if len(s) > CACHED_BYTES:
                    del self.known[s]
        return out


def list_array(ids: list[np.ndarray | None]) -> pa.Array:
    sizes = [0 if x is None else len(x) for x in ids]
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    values = pa.array(np.concatenate([np.zeros(0, np.int32), *(x for x in ids if x is not None)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, values, mask=pa.array([x is None for x in ids], pa.bool_()))


def encoding(shared: Broadcast, place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for b in batches:
            texts = utf8(b.column(place))
            at = 0
            while at < len(texts):  # some rows at a time, so ids of a batch are not all held
                end, total = at, 0
                while end < len(texts) and (end == at or total < TOGETHER):
                    total += len(texts[end] or b"")
                    end += 1
                rows = b.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([*rows.columns, list_array(encoder.encode(texts[at:end]))],
                                                 names=[*b.schema.names, "pieces"])
                at = end
    return run


def decode_ids(model: Model, ids: list[int] | None) -> bytes | None:
    if ids is None:
        return None
    data = b"".join(map(model.text.__getitem__, ids))
    return data[1:] if data[:1] == b" " else data


def decoding(shared: Broadcast, place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_TOGETHER):  # texts of a batch are not all held
                b = whole.slice(at, ROWS_TOGETHER)
                texts = [None if x is None else decode_ids(shared.value, x).decode("utf-8", "replace")
                         for x in (v.values.to_numpy().tolist() if v.is_valid else None for v in b.column(place))]
                columns = [c for i, c in enumerate(b.columns) if i != place]
                names = [c for i, c in enumerate(b.schema.names) if i != place]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], names=[*names, "decoded"])
    return run


def fields(frame: DataFrame, without: str | None = None) -> list[str]:
    return [f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields if f.name != without]


def encode(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with the piece ids of the text in a new column ``pieces`` (which
    replaces one of that name)."""
    rows = docs.drop("pieces")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(encoding(shared, rows.columns.index(text_col)),
                           ", ".join([*fields(rows), "pieces array<int>"]))


def decode(rows: DataFrame, model: Model, pieces_col: str = "pieces") -> DataFrame:
    """``rows`` with ``decoded`` text in place of the piece ids."""
    rows = rows.drop("decoded")
    shared = rows.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(decoding(shared, rows.columns.index(pieces_col)),
                           ", ".join([*fields(rows, pieces_col), "decoded string"]))


def byte_pieces(model: Model, pieces_col: str = "pieces"):
    """How many of the pieces are bytes."""
    low, high = int(model.byte_piece.min()), int(model.byte_piece.max())
    if high - low != 255:
        raise ValueError("byte pieces are not together")
    return F.size(F.filter(pieces_col, lambda x: x.between(low, high))).cast("long")
