"""Suffix arrays by induced sorting, on numpy arrays.

The steps are the classical ones: classify suffixes as smaller (S) or larger
(L) than the next, sort the substrings between leftmost-S places by inducing
from any order, name them, sort the string of names recursively, and induce the
whole array from the sorted leftmost-S suffixes.

An inducing scan is sequential in principle, since what it places may be read
later in the same scan.  But everything placed by a stretch of the scan lies
behind that stretch when the stretch ends before its nearest target, so such
stretches are handled as whole arrays; they grow and shrink with the distance of
the targets, about the square root of the array.
"""
from __future__ import annotations

import numpy as np

FIRST_STRETCH = 4096


def ranks_within(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rank of each element among equal keys in order, the distinct keys and
    how many there are of each."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    start = np.concatenate([[0], np.flatnonzero(np.diff(ordered)) + 1])
    size = np.diff(np.concatenate([start, [len(ordered)]]))
    ranks = np.empty(len(keys), dtype=np.int64)
    ranks[order] = np.arange(len(keys)) - np.repeat(start, size)
    return ranks, ordered[start], size


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True for S suffixes; the text ends with a unique smallest value."""
    n = len(text)
    differs = np.flatnonzero(text[:-1] != text[1:])
    smaller = text[differs] < text[differs + 1]
    out = np.empty(n, dtype=bool)
    out[:-1] = np.repeat(smaller, np.diff(np.concatenate([[-1], differs])))
    out[-1] = True
    return out


def induce(text: np.ndarray, types: np.ndarray, lms: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Suffix array induced from leftmost-S places in the given order."""
    n = len(text)
    ends = np.cumsum(counts)
    array = np.full(n, -1, dtype=np.int64)
    rank, chars, size = ranks_within(text[lms])
    total = np.zeros(len(counts), dtype=np.int64)
    total[chars] = size
    slots = ends[text[lms]] - total[text[lms]] + rank
    array[slots] = lms
    is_l = ~types

    head = ends - counts
    at, stretch = 0, FIRST_STRETCH
    while at < n:
        to = min(n, at + stretch)
        place = array[at:to]
        before = place - 1
        some = np.flatnonzero(before >= 0)
        some = some[is_l[before[some]]]
        if len(some):
            value = text[before[some]]
            near = int(head[value].min())
            if near < to:
                to = near
                some = some[:np.searchsorted(some, to - at)]
                value = value[:len(some)]
            if len(some):
                rank, chars, size = ranks_within(value)
                array[head[value] + rank] = before[some]
                head[chars] += size
        done = to - at
        stretch = min(2 * stretch, n) if done == stretch else max(64, 2 * done)
        at = to

    array[slots] = -1
    array[0] = n - 1
    tail = ends.copy()
    at, stretch = n, FIRST_STRETCH
    while at > 0:
        to = max(0, at - stretch)
        place = array[to:at][::-1]
        before = place - 1
        some = np.flatnonzero(before >= 0)
        some = some[types[before[some]]]
        if len(some):
            value = text[before[some]]
            near = int(tail[value].max())            # targets end before it
            if near > to:
                to = near
                some = some[:np.searchsorted(some, at - to)]
                value = value[:len(some)]
            if len(some):
                rank, chars, size = ranks_within(value)
                array[tail[value] - 1 - rank] = before[some]
                tail[chars] -= size
        done = at - to
        stretch = min(2 * stretch, n) if done == stretch else max(64, 2 * done)
        at = to
    return array


def names_of(text: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """Name of the leftmost-S substring at each place of ``lms`` (in text order)
    by its rank, and the number of names; ``ordered`` has the sorted places."""
    n = len(text)
    length = np.zeros(n, dtype=np.int64)
    length[lms[:-1]] = np.diff(lms) + 1
    length[lms[-1]] = 1
    same = length[ordered[1:]] == length[ordered[:-1]]
    active = np.flatnonzero(same)
    offset = 0
    while len(active):
        a, b = ordered[active] + offset, ordered[active + 1] + offset
        equal = text[a] == text[b]
        same[active[~equal]] = False
        active = active[equal]
        offset += 1
        active = active[length[ordered[active]] > offset]
    rank = np.concatenate([[0], np.cumsum(~same)])
    names = np.empty(n, dtype=np.int64)
    names[ordered] = rank
    return names[lms], int(rank[-1]) + 1


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of non-negative integers whose last value is 0 and unique."""
    n = len(text)
    if n < 3:
        return np.arange(n - 1, -1, -1, dtype=np.int64)
    counts = np.bincount(text)
    types = suffix_types(text)
    lms = np.flatnonzero(types[1:] & ~types[:-1]) + 1
    array = induce(text, types, lms, counts)
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    ordered = array[is_lms[array]]
    names, kinds = names_of(text, lms, ordered)
    if kinds < len(lms):
        ordered = lms[suffix_array(names)]
    return induce(text, types, ordered, counts)


def common_prefixes(data: np.ndarray, array: np.ndarray, places: np.ndarray, limit: int) -> np.ndarray:
    """Permuted common prefixes: for each of ``places`` (text order) the length,
    at most ``limit``, that its suffix shares with the one before it in the
    array.  Eight bytes are compared at a time; ``data`` are the text's bytes."""
    n = len(data)
    before = np.full(n, -1, dtype=np.int64)
    before[array[1:]] = array[:-1]
    wide = np.zeros(n, dtype=np.uint64)
    padded = np.concatenate([data, np.zeros(8, dtype=data.dtype)]).astype(np.uint64)
    for k in range(8):
        wide = (wide << np.uint64(8)) | padded[k:k + n]
    out = np.zeros(len(places), dtype=np.int64)
    active = np.flatnonzero(before[places] >= 0)
    mine, other = places[active], before[places[active]]
    shared = 0
    while len(active) and shared < limit:
        inside = (mine + shared < n) & (other + shared < n)
        active, mine, other = active[inside], mine[inside], other[inside]
        x = wide[mine + shared] ^ wide[other + shared]
        leading = np.full(len(x), 8, dtype=np.int64)
        for k in range(7, -1, -1):
            leading[(x >> np.uint64(56 - 8 * k)) & np.uint64(255) != 0] = k
        out[active] = np.minimum(shared + leading, limit)
        go = leading == 8
        active, mine, other = active[go], mine[go], other[go]
        shared += 8
    ends = n - np.maximum(places, np.where(before[places] >= 0, before[places], 0))
    return np.minimum(out, ends)
