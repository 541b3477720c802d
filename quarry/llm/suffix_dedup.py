"""Suffix-array removal of repeated byte strings.

Each byte of a text that a string of ``LENGTH`` bytes covers is removed when the
string also starts in a document with a smaller id.  Strings never cross
documents and are judged on the input.

1. Texts are packed, some megabytes a row, into a table in the checkpoint folder;
   its rows are the unit that later steps name.
2. Every string of ``LENGTH`` bytes has a minimizer: of its ``ANCHOR``-byte
   substrings the one with the smallest hash.  Consecutive strings with the
   same minimizer form one stretch of text, and equal strings, wherever they
   are, have equal minimizers.  Two stretches that share a string agree in
   ``SIDE`` bytes to the left or to the right of the minimizer as well: packs
   send hashes of these sides, sorted and as differences, and learn which occur
   again.
3. A pack sends each distinct stretch with such a side once, with the smallest
   id that has it, to the shard of its minimizer.  There equal stretches become
   one.  A stretch that shares a side with none but its own copies is answered
   as a whole; the suffix array of the others is built by induced sorting
   (``quarry.llm.induced``), runs of permuted common prefixes of ``LENGTH`` or
   more are the equal strings, and the smallest id of each run goes back to the
   packs that asked.
4. A pack marks what its documents lose and returns the rest.

A minimizer that very many different stretches have (a line of 31 to 49 bytes with
other neighbours in each document) would make one shard as large as all of them.
Such minimizers are estimated from a quarter of the packs; their stretches travel
as single strings, each to the shard of its own hash, where equal ones meet and
nothing is left to sort.  Estimate and bound (``HOT_KEYS``) decide where strings
meet, never what is removed.

A group of copies meets in a shard as one stretch per pack, not one per copy,
and a document's own repeats stay in its pack.  Shards hold about
``SHARD_BYTES``, so their number grows with the text.

Defined results: a null text is empty; a null id counts as larger than all
others; rows that repeat an id do not take from each other; texts shorter than
``LENGTH`` stay whole; what is left may end inside a character and is binary.
Ids are longs.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import utf8
from quarry.llm.induced import common_prefixes, suffix_array
from quarry.session import cut_lineage

LENGTH = 50
ANCHOR = 12
SPAN = LENGTH - ANCHOR + 1           # substrings a string's minimizer is chosen from
WIDEST = SPAN + LENGTH - 1           # bytes of the longest stretch
SIDE = (LENGTH - ANCHOR) // 2
PACK_BYTES = 4 << 20
SHARD_BYTES = 12 << 20
SORT_BYTES = 2 << 20                 # text of one suffix array, unless one minimizer has more
HOT_STRETCHES = 1 << 14              # different stretches of one minimizer, from which on they travel as strings
HOT_KEYS = 1 << 20                   # such minimizers at most, those with most stretches; they are broadcast
PACK_SHARE = 4                       # one in so many packs is asked for its minimizers,
RARE, RARE_SHARE = 4, 16             # with fewer stretches in a pack only one in so many, with that weight
CODE_BITS = 44                       # of a side's hash; more than needed only sends more
BLOCK = 1 << 14
NULL_ID = np.iinfo(np.int64).max
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
WEIGHTS = (np.arange(1, WIDEST + 1, dtype=np.uint64) * M1 ^ M2) * M3 | np.uint64(1)


# --- packs -------------------------------------------------------------------

def packing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) rows to (pack, ids, sizes, bytes, data) rows."""
    ids: list[int | None] = []
    texts: list[bytes] = []
    total, done = 0, 0
    task = TaskContext.get().partitionId() << 32

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([task + done]), pa.array([ids], pa.list_(pa.int64())), pa.array([list(map(len, texts))], pa.list_(pa.int64())),
             pa.array([total], pa.int64()), pa.array([zstandard.compress(b"".join(texts), 3)], pa.binary())],
            names=["pack", "ids", "sizes", "bytes", "data"])

    for b in batches:
        for i, text in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
            text = text or b""
            if ids and total + len(text) > PACK_BYTES:
                yield packed()
                ids, texts, total, done = [], [], 0, done + 1
            ids.append(i)
            texts.append(text)
            total += len(text)
    if ids:
        yield packed()


def unpacked(ids: list[int | None], sizes: list[int], data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids with nulls replaced, ends of the texts, bytes."""
    text = zstandard.decompress(data, max_output_size=sum(sizes)) if sum(sizes) else b""
    return (np.array([NULL_ID if i is None else i for i in ids], dtype=np.int64), np.cumsum(np.array(sizes, dtype=np.int64)),
            np.frombuffer(text, dtype=np.uint8))


# --- stretches ---------------------------------------------------------------

def anchor_hash(first: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Hash of ``ANCHOR`` bytes: the first eight and the last four as numbers."""
    h = (first * M1) ^ (rest * M2)
    return (h ^ (h >> np.uint64(29))) * M3


def keys_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The minimizer hash of the anchors that begin at the given places."""
    number = lambda begin, n: sum((data[begin + k].astype(np.uint64) << np.uint64(8 * (n - 1 - k))) for k in range(n))
    return anchor_hash(number(at, 8), number(at + 8, 4)) >> np.uint64(24)


def stretches(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(begin, strings, minimizer hash, minimizer's offset, document) of each
    stretch of a pack: ``strings`` consecutive strings from ``begin`` on."""
    out: list[tuple[np.ndarray, ...]] = []
    doc = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(ends, prepend=0))
    starts = len(data) - LENGTH + 1
    last = LENGTH - 1
    for a in range(0, starts, BLOCK):
        b = min(starts, a + BLOCK)
        one = data[a:b + last].astype(np.uint64)
        two = (one[:-1] << np.uint64(8)) | one[1:]
        four = (two[:-2] << np.uint64(16)) | two[2:]
        eight = (four[:-4] << np.uint64(32)) | four[4:]
        n = len(one) - ANCHOR + 1
        h = anchor_hash(eight[:n], four[8:8 + n])
        low = (h >> np.uint64(24) << np.uint64(24)) | np.arange(n, dtype=np.uint64)
        width = 1
        while 2 * width <= SPAN:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < SPAN:
            low = np.minimum(low[:-(SPAN - width)], low[SPAN - width:])
        inside = doc[a:b] == doc[a + last:b + last]
        change = (low[1:] != low[:-1]) | (inside[1:] != inside[:-1]) | (doc[a + 1:b] != doc[a:b - 1])
        begin = np.concatenate([[0], np.flatnonzero(change) + 1])
        count = np.diff(np.concatenate([begin, [b - a]]))
        ok = inside[begin]
        begin, count = begin[ok], count[ok]
        at = (low[begin] & np.uint64(0xFFFFFF)).astype(np.int64)
        out.append((begin + a, count, low[begin] >> np.uint64(24), at - begin, doc[begin + a]))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def rows_of(data: np.ndarray, begin: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """Byte strings as rows of a matrix, filled up with zeros; ``data`` has
    ``width`` spare bytes at its end."""
    steps = np.arange(width)
    rows = data[begin[:, None] + steps]
    rows[steps >= size[:, None]] = 0
    return rows


def content_codes(data: np.ndarray, begin: np.ndarray, size: np.ndarray, key: np.ndarray, width: int = WIDEST) -> np.ndarray:
    out = np.empty(len(begin), dtype=np.uint64)
    for a in range(0, len(begin), 8192):
        s = slice(a, a + 8192)
        out[s] = rows_of(data, begin[s], size[s], width).astype(np.uint64) @ WEIGHTS[:width]
    code = (out ^ key) * M2 + size.astype(np.uint64) * M3
    return code ^ (code >> np.uint64(31))


def distinct(data: np.ndarray, begin: np.ndarray, size: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the distinct string of each row, and the first row of each.
    Rows with equal hashes are merged only after their bytes were compared."""
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = content_codes(data, begin, size, key)
    order = np.argsort(code, kind="stable")
    code = code[order]
    again = np.flatnonzero(code[1:] == code[:-1]) + 1
    same = np.zeros(len(order), dtype=bool)
    for a in range(0, len(again), 8192):
        i = again[a:a + 8192]
        x, y = order[i], order[i - 1]
        same[i] = (size[x] == size[y]) & (rows_of(data, begin[x], size[x], WIDEST)
                                          == rows_of(data, begin[y], size[y], WIDEST)).all(axis=1)
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(~same) - 1
    return number, order[~same]


def spare(data: np.ndarray) -> np.ndarray:
    return np.concatenate([data, np.zeros(WIDEST, dtype=np.uint8)])


def gathered(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The strings one after the other."""
    first = np.repeat(begin - (np.cumsum(size) - size), size)
    return data[first + np.arange(len(first))]


def joined(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value."""
    sizes = np.array([a.nbytes for a in arrays], dtype=np.int64)
    return zstandard.compress(b"".join([sizes.tobytes(), *(a.tobytes() for a in arrays)]), 3)


def split(value: bytes, *kinds: type) -> list[np.ndarray]:
    raw = zstandard.decompress(value)
    sizes = np.frombuffer(raw, dtype=np.int64, count=len(kinds))
    out, at = [], sizes.nbytes
    for size, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(raw[at:at + size], dtype=kind))
        at += size
    return out


def pieces(begin: np.ndarray, count: np.ndarray, key: np.ndarray, offset: np.ndarray, doc: np.ndarray,
           hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches, those of hot minimizers cut into their strings, and which rows are such."""
    cut = among(key, hot)
    if not cut.any():
        return begin, count, key, offset, doc, cut
    times = np.where(cut, count, 1)
    row = np.repeat(np.arange(len(begin)), times)
    string = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    return begin[row] + string, np.where(cut, 1, count)[row], key[row], offset[row] - string, doc[row], cut[row]


def key_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pack, ids, sizes, data) to (key, n): different stretches of a minimizer in
    a pack; small numbers stand for ``RARE_SHARE`` times as many, drawn by hash."""
    for b in batches:
        for pack, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            _, _, text, begin, count, key, _, _ = pack_stretches(*row)
            code = content_codes(spare(text), begin, count + LENGTH - 1, key)
            _, one = np.unique(code, return_index=True)
            keys, n = np.unique(key[one], return_counts=True)
            drawn = (keys ^ np.uint64(pack % (1 << 40))) * M2 >> np.uint64(32)
            n = np.where(n >= RARE, n, np.where(drawn % np.uint64(RARE_SHARE) == 0, n * RARE_SHARE, 0))
            yield pa.RecordBatch.from_arrays([pa.array(keys[n > 0].astype(np.int64)), pa.array(n[n > 0].astype(np.int64))], names=["key", "n"])


STRETCH = (np.int64, np.uint8, np.uint8, np.int64, np.uint8, np.uint8)


def sides(data: np.ndarray, begin: np.ndarray, count: np.ndarray, key: np.ndarray,
          offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the anchor with ``SIDE`` bytes to its right, and to its
    left, for the stretches that have them."""
    width = ANCHOR + SIDE
    rows, codes = [], []
    for side, (has, at) in enumerate(((count + LENGTH - 1 - offset >= width, begin + offset),
                                      (offset >= SIDE, begin + offset - SIDE))):
        some = np.flatnonzero(has)
        code = content_codes(data, at[some], np.full(len(some), width), key[some], width)
        rows.append(some)
        codes.append((code ^ np.uint64(side)) * M1 >> np.uint64(64 - CODE_BITS))
    return np.concatenate(rows), np.concatenate(codes)


def sorted_sides(codes: np.ndarray) -> np.ndarray:
    """The codes of a pack in order, each at most twice."""
    codes = np.sort(codes)
    keep = np.ones(len(codes), dtype=bool)
    keep[2:] = codes[2:] != codes[:-2]
    return codes[keep]


def planes(codes: np.ndarray) -> bytes:
    """Sorted codes as differences, byte by byte, compressed."""
    steps = np.diff(codes, prepend=np.uint64(0)).astype("<u8")
    return zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 3)


def from_planes(value: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(value), dtype=np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def side_shards(codes: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each code: ranges of equal width, in order."""
    return ((codes >> np.uint64(12)) * np.uint64(shards) >> np.uint64(CODE_BITS - 12)).astype(np.int64)


def pack_stretches(ids: list, sizes: list, data: bytes) -> tuple[np.ndarray, ...]:
    ids, ends, text = unpacked(ids, sizes, data)
    return ids, ends, text, *stretches(text, ends)


def asking(shards: int):
    """(pack, ids, sizes, data) to (shard, pack, codes) rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pack, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                _, _, text, begin, count, key, offset, _ = pack_stretches(*row)
                if not len(begin):
                    continue
                codes = sorted_sides(sides(spare(text), begin, count, key, offset)[1])
                shard = side_shards(codes, shards)
                parts = np.split(codes, np.flatnonzero(np.diff(shard)) + 1)
                numbers = [int(x[0]) for x in np.split(shard, np.flatnonzero(np.diff(shard)) + 1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers, pa.int64()), pa.array([pack] * len(parts), pa.int64()),
                     pa.array([planes(x) for x in parts], pa.binary())], names=["shard", "pack", "codes"])
    return run


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted ``known``; a search for each, so that many
    short lists against a long one do not cost its length every time."""
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def counting(table: pa.Table) -> pa.Table:
    """All codes of a shard to (pack, shard, shared): one bit per code a pack
    sent, whether it occurs again."""
    parts = [from_planes(x.as_py()) for x in table.column("codes")]
    every = np.sort(np.concatenate(parts))
    shared = np.unique(every[1:][every[1:] == every[:-1]])
    bits = [zstandard.compress(np.packbits(among(x, shared)).tobytes(), 3) for x in parts]
    return pa.table({"pack": table.column("pack"), "shard": table.column("shard"), "shared": pa.array(bits, pa.binary())})


def sending(shards: int, side_count: int, hot: Broadcast):
    """A pack and the answers about its sides to (shard, pack, stretches) rows."""
    def run(packs: pa.Table, answers: pa.Table) -> pa.Table:
        numbers, owners, blobs = [], [], []
        told = {s: zstandard.decompress(x) for s, x in zip(*(answers.column(c).to_pylist() for c in ("shard", "shared")), strict=True)}
        for pack, *row in zip(*(packs.column(c).to_pylist() for c in ("pack", "ids", "sizes", "data")), strict=True):
            ids, _, text, begin, count, key, offset, doc = pack_stretches(*row)
            if not len(begin):
                continue
            wide = spare(text)
            rows, codes = sides(wide, begin, count, key, offset)
            mine = sorted_sides(codes)
            of = side_shards(mine, side_count)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1, [len(of)]])
            again = [np.unpackbits(np.frombuffer(told[int(of[a])], np.uint8), count=int(b - a)).astype(bool)
                     for a, b in zip(edges[:-1], edges[1:], strict=True)]
            begin, count, key, offset, doc, string = pieces(begin, count, key, offset, doc, hot.value)
            if string.any():
                rows, codes = sides(wide, begin, count, key, offset)
            keep = np.unique(rows[np.isin(codes, mine[np.concatenate(again)])])
            begin, count, key, offset, doc, string = (x[keep] for x in (begin, count, key, offset, doc, string))
            size = count + LENGTH - 1
            number, first = distinct(wide, begin, size, key)
            least = np.full(len(first), NULL_ID, dtype=np.int64)
            np.minimum.at(least, number, ids[doc])
            most = np.full(len(first), np.iinfo(np.int64).min, dtype=np.int64)
            np.maximum.at(most, number, ids[doc])
            order = np.argsort(first)
            f = first[order]
            by = key[f]
            by[string[f]] = content_codes(wide, begin[f[string[f]]], size[f[string[f]]], by[string[f]]) >> np.uint64(24)
            shard = shard_of(by, shards)
            order = order[np.argsort(shard, kind="stable")]
            shard = np.sort(shard)
            for part, to in zip(*(np.split(x, np.flatnonzero(np.diff(shard)) + 1) for x in (order, shard)), strict=True) if len(order) else ():
                f = first[part]
                numbers.append(int(to[0]))
                owners.append(pack)
                flags = (least[part] < most[part]).astype(np.uint8) | string[f].astype(np.uint8) << np.uint8(1)
                blobs.append(joined(np.diff(keep[f], prepend=0), size[f].astype(np.uint8), offset[f].astype(np.uint8),
                                    np.diff(least[part], prepend=0), flags, gathered(text, begin[f], size[f])))
        return pa.table({"shard": pa.array(numbers, pa.int64()), "pack": pa.array(owners, pa.int64()),
                         "stretches": pa.array(blobs, pa.binary())})
    return run


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    return ((key * M3) >> np.uint64(33)).astype(np.int64) % shards


# --- shards ------------------------------------------------------------------

def sharing(data: np.ndarray, begin: np.ndarray, size: np.ndarray, offset: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which of the distinct stretches agree with another in a side."""
    rows, codes = sides(data, begin, size - LENGTH + 1, key, offset)
    _, inverse, n = np.unique(codes, return_inverse=True, return_counts=True)
    out = np.zeros(len(begin), dtype=bool)
    out[rows[n[inverse] > 1]] = True
    return out


def least_ids(data: np.ndarray, begin: np.ndarray, size: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Smallest id that has each string of the given stretches, in their order:
    suffix array over the stretches, equal strings by common prefixes."""
    count = size - LENGTH + 1
    text = np.zeros(int((size + 1).sum()) + 1, dtype=np.int64)
    place = np.cumsum(size + 1) - (size + 1)
    inner = np.repeat(place - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    text[:-1] = 1
    text[inner] = gathered(data, begin, size).astype(np.int64) + 2
    array = suffix_array(text)
    starts = np.repeat(place - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    raw = np.full(len(text), 0xFF, dtype=np.uint8)   # separators are a byte that no UTF-8 text has
    raw[inner] = gathered(data, begin, size)
    prefix = np.zeros(len(text), dtype=np.int64)
    prefix[starts] = common_prefixes(raw, array, starts, LENGTH)
    number = np.full(len(text), -1, dtype=np.int64)
    number[starts] = np.arange(len(starts))
    inside = array[number[array] >= 0]
    group = np.flatnonzero(prefix[inside] < LENGTH)
    owner = np.repeat(least, count)
    best = np.minimum.reduceat(owner[number[inside]], group)
    out = np.empty(len(starts), dtype=np.int64)
    out[number[inside]] = np.repeat(best, np.diff(np.concatenate([group, [len(inside)]])))
    return out


def resolving(table: pa.Table) -> pa.Table:
    """All stretches of a shard to (pack, answers): for a pack's stretch, runs of
    strings with the smallest id that has them, where a document loses some."""
    packs = np.array(table.column("pack").to_pylist(), dtype=np.int64)
    order = np.argsort(packs, kind="stable")
    parts = [split(x.as_py(), *STRETCH) for x in table.column("stretches")]
    parts = [parts[i] for i in order]
    lengths = [len(p[0]) for p in parts]
    entry, least = (np.concatenate([np.cumsum(p[i]) for p in parts]) for i in (0, 3))
    size, offset, flags, data = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 4, 5))
    owner = np.repeat(packs[order], lengths)
    many, string = flags & np.uint8(1), (flags & np.uint8(2)) > 0
    size, offset = size.astype(np.int64), offset.astype(np.int64)
    begin = np.cumsum(size) - size
    data = spare(data)
    key = keys_at(data, begin + offset)

    number, first = distinct(data, begin, size, key)
    smallest = np.full(len(first), NULL_ID, dtype=np.int64)
    np.minimum.at(smallest, number, least)
    mixed = np.zeros(len(first), dtype=bool)
    whole = np.flatnonzero(~string[first])                    # strings of hot minimizers are equal or have nothing in common
    f = first[whole]
    mixed[whole] = sharing(data, begin[f], size[f], offset[f], key[f])
    uses = np.bincount(number, minlength=len(first)) + np.bincount(number, weights=many, minlength=len(first))
    alone = np.flatnonzero((uses > 1) & ~mixed)               # copies of one stretch only
    wanted = np.flatnonzero(mixed)
    wanted = wanted[np.argsort(key[first[wanted]], kind="stable")]
    f = first[wanted]
    total = np.cumsum(size[f] + 1)
    groups = np.concatenate([[0], np.flatnonzero(np.diff(key[f])) + 1, [len(f)]]) if len(f) else np.zeros(1, np.int64)
    found, at = [], 0
    while at < len(groups) - 1:
        base = total[groups[at] - 1] if groups[at] else 0
        to = at + 1
        while to < len(groups) - 1 and total[groups[to + 1] - 1] - base <= SORT_BYTES:
            to += 1
        s = slice(groups[at], groups[to])
        found.append(least_ids(data, begin[f[s]], size[f[s]], smallest[wanted[s]]))
        at = to
    answer = np.full(len(first), -1, dtype=np.int64)          # place of a stretch's first answer
    f = first[np.concatenate([wanted, alone])]
    count = size[f] - LENGTH + 1
    answer[np.concatenate([wanted, alone])] = np.cumsum(count) - count
    ids = np.concatenate([np.zeros(0, np.int64), *found, np.repeat(smallest[alone], size[first[alone]] - LENGTH + 1)])

    rows = np.flatnonzero(answer[number] >= 0)
    count = size[rows] - LENGTH + 1
    place = np.repeat(answer[number[rows]] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    value, row = ids[place], np.repeat(rows, count)
    loses = (value < least[row]) | (many[row] > 0)
    string = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    value, row, string = value[loses], row[loses], string[loses]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (string[1:] != string[:-1] + 1) | (value[1:] != value[:-1])
    head = np.flatnonzero(new)
    run = np.diff(np.concatenate([head, [len(row)]]))
    asked, answers = [], []
    to_pack = owner[row[head]]
    for part in np.split(np.arange(len(head)), np.flatnonzero(np.diff(to_pack)) + 1):
        if len(part):
            asked.append(int(to_pack[part[0]]))
            answers.append(joined(entry[row[head[part]]].astype(np.int64), string[head[part]].astype(np.uint8), run[part].astype(np.uint8),
                                  value[head[part]]))
    return pa.table({"pack": pa.array(asked, pa.int64()), "answers": pa.array(answers, pa.binary())})


# --- answers -----------------------------------------------------------------

def removing(hot: Broadcast):
    """A pack and the answers to it to one row per document: (id, n_bytes, spans, kept)."""
    return lambda packs, answers: removed(packs, answers, hot.value)


def removed(packs: pa.Table, answers: pa.Table, hot: np.ndarray) -> pa.Table:
    out_ids, out_sizes, out_spans, out_kept = [], [], [], []
    parts = [split(x.as_py(), np.int64, np.uint8, np.uint8, np.int64) for x in answers.column("answers")]
    for raw_ids, sizes, data in zip(*(packs.column(c).to_pylist() for c in ("ids", "sizes", "data")), strict=True):
        ids, ends, text = unpacked(raw_ids, sizes, data)
        cover = np.zeros(len(text) + 1, dtype=np.int64)
        if parts:
            begin, count, key, _, doc, _ = pieces(*stretches(text, ends), hot)
            entry, string, run, value = (np.concatenate(x) for x in zip(*parts, strict=True))
            near = np.flatnonzero(np.isin(key, key[entry]))     # copies of an answered stretch have its minimizer
            begin, doc = begin[near], doc[near]
            number, _ = distinct(spare(text), begin, count[near] + LENGTH - 1, key[near])
            entry = number[np.searchsorted(near, entry)]
            by_entry = np.argsort(entry, kind="stable")
            low = np.searchsorted(entry[by_entry], number, side="left")
            many = np.searchsorted(entry[by_entry], number, side="right") - low
            row = np.repeat(np.arange(len(number)), many)
            pick = by_entry[np.repeat(low - (np.cumsum(many) - many), many) + np.arange(len(row))]
            lost = value[pick] < ids[doc[row]]
            row, pick = row[lost], pick[lost]
            first = begin[row] + string[pick].astype(np.int64)
            np.add.at(cover, first, 1)
            np.add.at(cover, first + run[pick].astype(np.int64) + LENGTH - 1, -1)
        gone = np.cumsum(cover[:-1]) > 0
        for i, size, end in zip(raw_ids, sizes, ends.tolist(), strict=True):
            mine = gone[end - size:end]
            edge = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]]).astype(np.int8)))
            out_ids.append(i)
            out_sizes.append(size)
            out_spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
            out_kept.append(text[end - size:end][~mine].tobytes())
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.table({"id": pa.array(out_ids, pa.int64()), "n_bytes": pa.array(out_sizes, pa.int64()),
                     "spans": pa.array(out_spans, span), "kept": pa.array(out_kept, pa.binary())})


def hot_keys(packs: DataFrame) -> tuple[np.ndarray, int]:
    """The minimizers with ``HOT_STRETCHES`` and more different stretches, sorted,
    and the number of these stretches, both estimated."""
    some = packs.where(F.pmod(F.xxhash64("pack"), F.lit(PACK_SHARE)) == 0)
    rows = (some.select("pack", "ids", "sizes", "data").mapInArrow(key_counts, "key long, n long")
            .groupBy("key").agg((F.sum("n") * PACK_SHARE).alias("n")).where(F.col("n") >= HOT_STRETCHES)
            .orderBy(F.desc("n"), "key").limit(HOT_KEYS).toArrow())
    return np.sort(rows["key"].to_numpy()).astype(np.uint64), int(rows["n"].to_numpy().sum())


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, spans, kept``: the removed byte ranges of every document
    (ends exclusive) and its remaining bytes."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    packs = cut_lineage(rows.mapInArrow(packing, "pack long, ids array<long>, sizes array<long>, bytes long, data binary"))
    whole = packs.select("pack", "ids", "sizes", "data")
    total = packs.agg(F.sum("bytes")).first()[0] or 0
    keys, many = hot_keys(packs)
    hot = docs.sparkSession.sparkContext.broadcast(keys)
    side_count = int(total * (1 + LENGTH / (SPAN / 2)) // SHARD_BYTES) + 1
    shards = side_count + many * LENGTH * SPAN // 2 // SHARD_BYTES
    told = (whole.mapInArrow(asking(side_count), "shard long, pack long, codes binary")
            .groupBy("shard").applyInArrow(counting, "pack long, shard long, shared binary"))
    sent = (whole.groupBy("pack").cogroup(told.groupBy("pack"))
            .applyInArrow(sending(shards, side_count, hot), "shard long, pack long, stretches binary"))
    answers = sent.groupBy("shard").applyInArrow(resolving, "pack long, answers binary")
    return (whole.groupBy("pack").cogroup(answers.groupBy("pack"))
            .applyInArrow(removing(hot), "id long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary"))
