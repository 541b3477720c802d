"""Removal of repeated word passages by suffix automata.

A window is ``LENGTH`` consecutive words of a document.  Each word is removed
that is covered by a window whose words also start in a document with a smaller
id; windows are judged on the input.

1. Texts are packed, some megabytes a row (``suffix_dedup.packing``).  A pack
   sends short hashes of its windows, sorted and as differences, and learns which
   occur again.  Of these it sends each distinct window once: its hash, the
   smallest id that has it and the reference shard (``SHARD_WORDS`` windows of the
   pack) of that occurrence.
2. Where equal hashes meet, the pack with the smallest id owns the window if it
   occurs in another document as well.  The owner's shard goes back to every pack
   that sent the hash.  This only routes: which shard to compare with.
3. The owned windows of a pack, joined where they follow each other, are its
   reference spans.  Every pack sends the spans of windows that an owner may hold
   to the owner's shard, each distinct window once.
4. The suffix automaton of a shard's reference spans is built over their words, in
   the order of ids, so a state knows the smallest id it occurs in.  It is sent to
   every task that holds spans for the shard; a shard with many askers is asked in
   parts of about ``PART_WORDS`` words.  The spans are streamed through it: where
   the matching statistic reaches ``LENGTH`` words, the state on the suffix path
   that just holds the window gives its smallest id.
5. Packs remove the maximal spans covered by such windows with a smaller id.

Work is linear: a passage is streamed once per pack through one automaton, and a
group of copies is one span per pack.  An automaton is never of the whole corpus
and no data set is broadcast as a whole; its size is bounded by ``SHARD_WORDS``.

Defined results: a null text has no words; a null id counts as larger than all
others; rows that repeat an id do not take from each other; texts shorter than
``LENGTH`` words stay whole.  Ids are longs.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.suffix_dedup import (CODE_BITS, NULL_ID, among, counting, joined, packing, planes, side_shards, sorted_sides, split,
                                     unpacked)
from quarry.llm.words import split_words
from quarry.session import cut_lineage

LENGTH = 13
SHARD_WORDS = 1 << 15        # windows of a pack in one reference shard
PART_WORDS = 1 << 21         # words streamed by one task through one automaton
GROUP_BYTES = 8 << 20        # text whose window hashes meet in one group
SEED = 1
STATE = -1                   # group number of a pack's own row
SHORT = np.uint64(64 - CODE_BITS)


# --- windows -----------------------------------------------------------------

class Pack:
    """A pack's documents by id, and their words."""

    def __init__(self, ids: list, sizes: list, data: bytes):
        keys, ends, text = unpacked(ids, sizes, data)
        raw, begins = text.tobytes(), (ends - np.array(sizes, dtype=np.int64)).tolist()
        order = np.argsort(keys, kind="stable").tolist()
        self.ids = keys[order]
        self.raw_ids = [ids[i] for i in order]
        self.words = split_words([raw[begins[i]:ends[i]] for i in order])

    def doc(self, at: np.ndarray) -> np.ndarray:
        """Document of the word at each place."""
        return np.searchsorted(self.words.ends, at, side="right")

    def hashes(self, length: int, seed: int) -> np.ndarray:
        """A 64-bit hash of the window that begins at each word; 0 where none does."""
        words, n = self.words, len(self.words.codes)
        out = np.zeros(n, dtype=np.uint64)
        if n >= length:
            kinds = words.kinds.to_pylist()
            h = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in kinds), dtype=np.uint64, count=len(kinds))[words.codes]
            odd = np.random.default_rng(seed).integers(1, 1 << 63, length, dtype=np.uint64) | np.uint64(1)
            total = np.zeros(n - length + 1, dtype=np.uint64)
            for k in range(length):
                total += h[k:n - length + 1 + k] * odd[k]
            total ^= total >> np.uint64(29)
            total *= np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(32)
            end = np.repeat(words.ends, np.diff(words.ends, prepend=0))[:len(total)]
            out[:len(total)] = np.where(np.arange(len(total)) + length <= end, total | np.uint64(1), np.uint64(0))
        return out


class Windows:
    """The distinct windows at some places of a pack."""

    def __init__(self, pack: Pack, at: np.ndarray, head: np.ndarray):
        self.at, self.head = at, head                      # places by window, id and place; first place of each window
        self.owner = pack.ids[pack.doc(at)]
        self.number = np.repeat(np.arange(len(head)), np.diff(np.concatenate([head, [len(at)]])))
        last = np.concatenate([head[1:], [len(at)]])[:len(head)] - 1
        self.several = self.owner[head] != self.owner[last]

    @classmethod
    def distinct(cls, pack: Pack, at: np.ndarray, hashes: np.ndarray) -> tuple["Windows", np.ndarray]:
        """By hash (places are in the order of ids), and the hashes."""
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = hashes[1:] != hashes[:-1]
        head = np.flatnonzero(new)
        return cls(pack, at[order], head), hashes[head]


def spans(windows: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first window, count) of the stretches of consecutive windows with one
    tag; ``windows`` are sorted places."""
    cut = np.ones(len(windows), dtype=bool)
    cut[1:] = (np.diff(windows) != 1) | (np.diff(tags) != 0)
    head = np.flatnonzero(cut)
    return windows[head], np.diff(np.concatenate([head, [len(windows)]]))


def byte_rows(values: np.ndarray) -> np.ndarray:
    """Numbers byte by byte, which compresses better."""
    return np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T)


def from_byte_rows(raw: np.ndarray, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel()


def group_of(hashes: np.ndarray, groups: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)


def parts_of(number: np.ndarray) -> list[tuple[int, slice]]:
    """(number, its stretch) of a sorted array."""
    edges = np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1, [len(number)]]) if len(number) else np.zeros(1, np.int64)
    return [(int(number[a]), slice(int(a), int(b))) for a, b in zip(edges[:-1], edges[1:], strict=True)]


# --- routing -----------------------------------------------------------------

def offering(groups: int, length: int):
    """(pack, ids, sizes, data) to (shard, pack, codes) rows: short hashes of all windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pack, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                h = Pack(*row).hashes(length, SEED)
                codes = sorted_sides(h[h != 0] >> SHORT)
                found = parts_of(side_shards(codes, groups))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g for g, _ in found], pa.int64()), pa.array([pack] * len(found), pa.int64()),
                     pa.array([planes(codes[s]) for _, s in found], pa.binary())], names=["shard", "pack", "codes"])
    return run


def asking(groups: int, length: int):
    """A pack and which of its short hashes occur again, to (pack, grp, blob) rows:
    one per group with the windows that may, and under ``STATE`` their places."""
    def run(packs: pa.Table, answers: pa.Table) -> pa.Table:
        told = {s: zstandard.decompress(x) for s, x in zip(*(answers.column(c).to_pylist() for c in ("shard", "shared")), strict=True)}
        owners, numbers, blobs = [], [], []
        for pack, *row in zip(*(packs.column(c).to_pylist() for c in ("pack", "ids", "sizes", "data")), strict=True):
            p = Pack(*row)
            h = p.hashes(length, SEED)
            at = np.flatnonzero(h)
            codes = sorted_sides(h[at] >> SHORT)
            again = [np.unpackbits(np.frombuffer(told[g], np.uint8), count=s.stop - s.start).astype(bool)
                     for g, s in parts_of(side_shards(codes, groups))]
            at = at[among(h[at] >> SHORT, codes[np.concatenate(again)])] if again else at
            w, hashes = Windows.distinct(p, at, h[at])
            check = p.hashes(length, SEED + 1)[w.at[w.head]].astype(np.uint32) if len(at) else np.zeros(0, np.uint32)
            shard = (w.at[w.head] // SHARD_WORDS).astype(np.uint16)
            ids = np.unique(p.ids)
            place = np.searchsorted(ids, w.owner[w.head]).astype(np.uint32)
            for g, s in parts_of(group_of(hashes, groups)):
                used, inner = np.unique(place[s], return_inverse=True)
                numbers.append(g)
                blobs.append(joined(byte_rows(np.diff(hashes[s], prepend=np.uint64(0))), byte_rows(check[s]), byte_rows(inner.astype(np.uint32)),
                                    byte_rows(shard[s]), np.packbits(w.several[s]), ids[used]))
            numbers.append(STATE)
            sent = parts_of(group_of(hashes, groups))
            blobs.append(joined(byte_rows(w.at.astype(np.uint32)), byte_rows(w.head.astype(np.uint32)),
                                np.array([(g, s.start, s.stop) for g, s in sent], dtype=np.int64)))
            owners += [pack] * (len(numbers) - len(owners))
        return pa.table({"pack": pa.array(owners, pa.int64()), "grp": pa.array(numbers, pa.int64()), "blob": pa.array(blobs, pa.binary())})
    return run


def known_state(pack: Pack, blob: bytes) -> tuple[Windows, list[list[int]]]:
    """The windows that a pack sent, and (group, begin, end) of those each group got."""
    at, head, sent = split(blob, np.uint8, np.uint8, np.int64)
    return (Windows(pack, *(from_byte_rows(x, np.uint32).astype(np.int64) for x in (at, head))), sent.reshape(-1, 3).tolist())


def owning(table: pa.Table) -> pa.Table:
    """All windows of a group to (pack, grp, blob) rows: per window a pack sent, the
    pack and shard that own it, or -1 where it occurs in one document only."""
    packs = table.column("pack").to_numpy()
    sent = [split(x.as_py(), *[np.uint8] * 5, np.int64) for x in table.column("blob")]
    hashes = [np.cumsum(from_byte_rows(s[0], np.uint64), dtype=np.uint64) for s in sent]
    sizes = [len(h) for h in hashes]
    least = np.concatenate([s[5][from_byte_rows(s[2], np.uint32)] for s in sent])
    check = np.concatenate([from_byte_rows(s[1], np.uint32) for s in sent])
    shard = np.concatenate([from_byte_rows(s[3], np.uint16) for s in sent]).astype(np.int64)
    several = np.concatenate([np.unpackbits(s[4], count=n).astype(bool) for s, n in zip(sent, sizes, strict=True)])
    pack = np.repeat(packs, sizes)
    every = np.concatenate(hashes)
    order = np.lexsort((pack, least, check, every))
    head = np.ones(len(order), dtype=bool)
    head[1:] = (every[order][1:] != every[order][:-1]) | (check[order][1:] != check[order][:-1])
    number = np.cumsum(head) - 1
    first = order[head]
    most = np.maximum.reduceat(least[order], np.flatnonzero(head)) if len(order) else least
    wanted = (most > least[first]) | np.logical_or.reduceat(several[order], np.flatnonzero(head)) if len(order) else several
    owner = np.empty(len(order), dtype=np.int64)
    owner[order] = np.where(wanted, first, -1)[number]
    blobs = []
    for a, n in zip(np.cumsum([0, *sizes[:-1]]).tolist(), sizes, strict=True):
        mine = owner[a:a + n]
        of, place = np.unique(np.stack([np.where(mine < 0, -1, pack[mine]), np.where(mine < 0, 0, shard[mine])]), axis=1, return_inverse=True)
        blobs.append(joined(np.ascontiguousarray(of[0]), np.ascontiguousarray(of[1]), byte_rows(place.ravel().astype(np.uint32))))
    return pa.table({"pack": table.column("pack"), "grp": table.column("grp"), "blob": pa.array(blobs, pa.binary())})


# --- spans -------------------------------------------------------------------

def sending(length: int):
    """A pack and the owners of its windows to (owner, shard, pack, n, is_reference,
    spans) rows."""
    def run(packs: pa.Table, answers: pa.Table) -> pa.Table:
        blobs = dict(zip(*(answers.column(c).to_pylist() for c in ("grp", "blob")), strict=True))
        rows = []
        for pack, *row in zip(*(packs.column(c).to_pylist() for c in ("pack", "ids", "sizes", "data")), strict=True):
            p = Pack(*row)
            w, sent = known_state(p, blobs.pop(STATE))
            owner, shard = np.full(len(w.head), -1, np.int64), np.zeros(len(w.head), np.int64)
            for g, a, b in sent:
                of, shards, place = split(blobs[g], np.int64, np.int64, np.uint8)
                place = from_byte_rows(place, np.uint32)
                owner[a:b], shard[a:b] = of[place], shards[place]
            first = np.minimum.reduceat(w.at, w.head) if len(w.at) else w.at     # in the pack, whatever its id
            mine = np.flatnonzero(owner == pack)
            asked = np.flatnonzero((owner >= 0) & ((owner != pack) | w.several))
            for is_reference, at, windows in ((True, w.at[w.head[mine]], mine), (False, first[asked], asked)):
                order = np.argsort(at)
                at, windows = at[order], windows[order]
                target, of = np.unique(np.stack([owner[windows], shard[windows]]), axis=1, return_inverse=True)
                of = of.ravel()
                begin, count = spans(at, of)
                of = of[np.searchsorted(at, begin)]
                order = np.argsort(of, kind="stable")
                for t, s in parts_of(of[order]):
                    some = order[s]
                    size = count[some] + length - 1
                    inner = np.repeat(begin[some] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                    text = b" ".join(p.words.words.take(pa.array(inner)).to_pylist())
                    rows.append((int(target[0, t]), int(target[1, t]), pack, int(size.sum()), is_reference,
                                 joined(begin[some], size, p.ids[p.doc(begin[some])], np.frombuffer(text, dtype=np.uint8))))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                        names=["owner", "shard", "pack", "n", "is_reference", "spans"])
    return run


# --- automata ----------------------------------------------------------------

class Automaton:
    """Suffix automaton of several word sequences; sequences are added in the
    order of their ids, so the id of a state's first end is its smallest."""

    def __init__(self):
        self.step: list[dict] = [{}]
        self.link, self.size, self.least = [-1], [0], [NULL_ID]

    def _state(self, step: dict, link: int, size: int, least: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.size.append(size)
        self.least.append(least)
        return len(self.step) - 1

    def _copy(self, p: int, q: int, word: int) -> int:
        """A state for the strings of ``q`` that end a path from ``p``."""
        copy = self._state(dict(self.step[q]), self.link[q], self.size[p] + 1, self.least[q])
        while p >= 0 and self.step[p].get(word) == q:
            self.step[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def add(self, words: list[int], least: int) -> None:
        last = 0
        for word in words:
            q = self.step[last].get(word)
            if q is not None:                              # the string is there already
                last = q if self.size[q] == self.size[last] + 1 else self._copy(last, q, word)
                continue
            new = self._state({}, 0, self.size[last] + 1, least)
            p = last
            while p >= 0 and word not in self.step[p]:
                self.step[p][word] = new
                p = self.link[p]
            if p >= 0:
                q = self.step[p][word]
                self.link[new] = q if self.size[q] == self.size[p] + 1 else self._copy(p, q, word)
            last = new

    def matches(self, words: list[int], length: int) -> Iterator[tuple[int, int]]:
        """(first word, smallest id) of the windows of ``length`` words that occur."""
        step, link, size = self.step, self.link, self.size
        state, matched = 0, 0
        for i, word in enumerate(words):
            while state and word not in step[state]:
                state = link[state]
                matched = size[state]
            state = step[state].get(word, 0)
            matched = matched + 1 if state else 0
            if matched >= length:
                while size[link[state]] >= length:
                    state = link[state]
                matched = min(matched, size[state])
                yield i - length + 1, self.least[state]


def word_lists(blobs: list[bytes], vocabulary: dict[bytes, int]) -> Iterator[tuple[int, int, int, list[int]]]:
    """(row, first word, id, words) of each span."""
    for row, blob in enumerate(blobs):
        begin, size, ids, text = split(blob, np.int64, np.int64, np.int64, np.uint8)
        numbers = [vocabulary.setdefault(w, len(vocabulary)) for w in text.tobytes().split(b" ")]
        at = 0
        for a, n, i in zip(begin.tolist(), size.tolist(), ids.tolist(), strict=True):
            yield row, a, i, numbers[at:at + n]
            at += n


def streaming(length: int):
    """The reference spans of a shard and spans that ask it, to (pack, grp, blob)."""
    def run(reference: pa.Table, asks: pa.Table) -> pa.Table:
        vocabulary: dict[bytes, int] = {}
        automaton = Automaton()
        spans = sorted(word_lists(reference.column("spans").to_pylist(), vocabulary), key=lambda s: s[2])
        for _, _, least, words in spans:
            automaton.add(words, least)
        found: dict[int, list[tuple[int, int]]] = {}
        for row, begin, _, words in word_lists(asks.column("spans").to_pylist(), vocabulary):
            found.setdefault(row, []).extend((begin + i, least) for i, least in automaton.matches(words, length))
        packs, blobs = asks.column("pack").to_pylist(), []
        for rows in found.values():
            at, least = (np.array(x, dtype=np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 2
            head = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(least) != 0)]))[:len(at)]
            blobs.append(joined(at[head], np.diff(np.concatenate([head, [len(at)]])), least[head]))
        return pa.table({"pack": pa.array([packs[r] for r in found], pa.int64()), "grp": pa.array([0] * len(found), pa.int64()),
                         "blob": pa.array(blobs, pa.binary())})
    return run


# --- answers -----------------------------------------------------------------

def removing(length: int):
    """One row per document of a pack: (id, n_words, spans, kept)."""
    def run(packs: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        groups, blobs = (answers.column(c).to_pylist() for c in ("grp", "blob"))
        parts = [split(x, np.int64, np.int64, np.int64) for g, x in zip(groups, blobs, strict=True) if g != STATE]
        for row in zip(*(packs.column(c).to_pylist() for c in ("ids", "sizes", "data")), strict=True):
            p = Pack(*row)
            w, _ = known_state(p, blobs[groups.index(STATE)])
            n = len(p.words.codes)
            least = np.full(n, NULL_ID, dtype=np.int64)                # of the window that begins at a word
            for at, run_, value in parts:
                place = np.repeat(at - (np.cumsum(run_) - run_), run_) + np.arange(int(run_.sum()))
                least[place] = np.repeat(value, run_)
            best = np.minimum.reduceat(least[w.at], w.head) if len(w.at) else least[:0]
            lost = w.at[best[w.number] < w.owner]
            cover = np.zeros(n + 1, dtype=np.int64)
            np.add.at(cover, lost, 1)
            np.add.at(cover, lost + length, -1)
            gone = np.cumsum(cover[:-1]) > 0
            ends = p.words.ends.tolist()
            kept = p.words.joined(~gone)
            for i, a, b, text in zip(p.raw_ids, [0, *ends[:-1]], ends, kept, strict=True):
                edge = np.flatnonzero(np.diff(np.concatenate([[False], gone[a:b], [False]]).astype(np.int8))).tolist()
                out.append((i, b - a, [{"start": x, "end": y} for x, y in zip(edge[::2], edge[1::2], strict=True)], text.as_py()))
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table([pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.int64(), span, pa.string()], strict=True)],
                        names=["id", "n_words", "spans", "kept"])
    return run


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``id, n_words, spans, kept``: the removed word ranges of every document
    (ends exclusive) and its remaining words, joined by one space."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    packs = cut_lineage(rows.mapInArrow(packing, "pack long, ids array<long>, sizes array<long>, bytes long, data binary"))
    whole = packs.select("pack", "ids", "sizes", "data")
    of_pack = whole.groupBy("pack")
    groups = int((packs.agg(F.sum("bytes")).first()[0] or 0) // GROUP_BYTES) + 1
    blobs = "pack long, grp long, blob binary"
    again = (whole.mapInArrow(offering(groups, length), "shard long, pack long, codes binary")
             .groupBy("shard").applyInArrow(counting, "pack long, shard long, shared binary"))
    asked = cut_lineage(of_pack.cogroup(again.groupBy("pack")).applyInArrow(asking(groups, length), blobs))
    state = asked.where(F.col("grp") == STATE)
    owners = asked.where(F.col("grp") != STATE).groupBy("grp").applyInArrow(owning, blobs)
    sent = cut_lineage(of_pack.cogroup(owners.unionByName(state).groupBy("pack"))
                       .applyInArrow(sending(length), "owner long, shard long, pack long, n long, is_reference boolean, spans binary"))
    shard = ["owner", "shard"]
    asks = sent.where("NOT is_reference")
    parts = asks.groupBy(*shard).agg(F.ceil(F.sum("n") / PART_WORDS).alias("parts"))
    part = F.pmod(F.xxhash64("pack"), F.col("parts"))
    asks = asks.join(parts, shard).select(*shard, part.alias("part"), "pack", "spans")
    reference = (sent.where("is_reference").join(parts, shard)
                 .select(F.col("owner").alias("of"), F.col("shard").alias("of_shard"),
                         F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("of_part"), F.col("spans").alias("spans")))
    found = (reference.groupBy("of", "of_shard", "of_part").cogroup(asks.groupBy(*shard, "part"))
             .applyInArrow(streaming(length), blobs))
    return (of_pack.cogroup(found.unionByName(state).groupBy("pack"))
            .applyInArrow(removing(length), "id long, n_words long, spans array<struct<start:bigint,end:bigint>>, kept string"))
