"""SimHash near-duplicates, linked through a pigeonring filter.

Fingerprint: texts are lower-cased in A-Z and split into words of
``[^\\x20\\x09-\\x0D]+``; every shingle of ``width`` words (repeats included,
joined by one space) votes with its XXH64 (seed 42); a bit is set when it is
set in over half of the hashes.

Linking: equal fingerprints are one node.  The 64 bits are a ring of m = 5
segments.  When two fingerprints differ in at most t = 4 bits, some segment
starts a chain in which the first l segments differ in at most l * t / m bits
for every l (0, 1, 2, 3, 4).  So its first segment is equal and the second
differs in at most one bit: every fingerprint is sent to one key per (segment,
masked bit of the next), 64 keys of 24 or 25 bits.  Within a key the rest of
the chain is tested before the full distance.  Links of a key are reduced to a
spanning forest, which keeps the components, so a dense group never becomes
all its pairs.  A key with more than ``BLOCK`` fingerprints is cut into blocks,
and every two blocks meet in a task of their own.

Defined results: null, empty and blank texts have fingerprint zero and link as
such; texts shorter than a shingle hash as a whole; a group whose ids are all
null has a null component; rows that repeat an id are rows each; an empty table
gives no rows.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import text_pieces, utf8
from quarry.llm.components import components
from quarry.session import cut_lineage

WIDTH = 4
MAX_BITS = 4
SEED = 42
BLOCK = 4096             # fingerprints of a key compared in one go
SMALL = 8                # larger groups are searched breadth first

STARTS = (0, 13, 26, 39, 52)
LENGTHS = (13, 13, 13, 13, 12)
MASKS = [np.uint64(((1 << n) - 1) << s) for s, n in zip(STARTS, LENGTHS, strict=True)]


def fingerprint(text: bytes | None, width: int = WIDTH) -> int:
    votes = np.zeros(64, dtype=np.int64)
    total = 0
    tail: list[bytes] = []
    digest = xxhash.xxh64_intdigest
    for piece in text_pieces(text or b""):
        words = tail + piece.lower().split()
        tail = words[max(0, len(words) - width + 1):]
        n = len(words) - width + 1
        if n < 1:
            continue
        line = b" ".join(words)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(sizes + 1) - 1
        begins = (ends - sizes)[:n].tolist()
        hashes = np.fromiter((digest(line[b:e], SEED) for b, e in zip(begins, ends[width - 1:].tolist(), strict=True)),
                             dtype=np.uint64, count=n)
        for at in range(0, n, 1 << 16):
            part = hashes[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
            votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += n
    if not total and tail:
        votes += np.unpackbits(np.array([digest(b" ".join(tail), SEED)], dtype="<u8").view(np.uint8), bitorder="little")
        total = 1
    return int(np.packbits(2 * votes > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """``id, fp``: the fingerprint as a signed long."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t, width) for t in utf8(b.column(1))), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return rows.mapInArrow(run, f"id {kind}, fp long")


def chain_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, fp) for each segment and masked bit of the segment after it."""
    for b in batches:
        signed = b.column(0).to_numpy()
        fps = signed.view(np.uint64)
        for i in range(5):
            j = (i + 1) % 5
            first = (fps & MASKS[i]) >> np.uint64(STARTS[i])
            after = (fps & MASKS[j]) >> np.uint64(STARTS[j])
            for p in range(LENGTHS[j]):
                head = np.uint64((i * 16 + p) << 26)
                key = head | (first << np.uint64(13)) | (after & ~np.uint64(1 << p))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(signed)], names=["key", "fp"])


def chained(x: np.ndarray, keys: np.ndarray | int, max_bits: int) -> np.ndarray:
    """Which differences pass the chain that their key starts, then the full
    distance.  A pair with equal second segments shares the keys of all masked
    bits and is taken at the first only."""
    code = np.asarray(keys) >> 26
    i, p = code >> 4, code & 15
    ring = np.array(STARTS, dtype=np.uint64)
    masks = np.array(MASKS, dtype=np.uint64)
    bit = (x >> (ring[(i + 1) % 5] + p.astype(np.uint64))) & np.uint64(1)
    ok = (bit == 1) | (p == 0)
    covered = masks[i] | masks[(i + 1) % 5]
    for length in (3, 4):
        covered = covered | masks[(i + length - 1) % 5]
        ok &= np.bitwise_count(x & covered) <= length * max_bits // 5
    return ok & (np.bitwise_count(x) <= max_bits)


def forest(fps: np.ndarray, key: int, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest of the links within one key."""
    out, rest = [], fps
    while len(rest) > 1:
        waiting, rest = [rest[0]], rest[1:]
        while waiting and len(rest):
            node = waiting.pop()
            near = chained(rest ^ node, key, max_bits)
            if near.any():
                found = rest[near]
                out.append((np.full(len(found), node, dtype=np.uint64), found))
                waiting.extend(found)
                rest = rest[~near]
    return out


def key_links(max_bits: int):
    """Streams (key, fp) sorted by key; gives links (kind 0: a, b) and, for keys
    of more than a block, their rows with block numbers (kind 1: key, fp, block)."""
    names = ["kind", "a", "b", "block"]

    def rows(kind: int, a: np.ndarray, b: np.ndarray, block: int = 0) -> pa.RecordBatch:
        n = len(a)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind, np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)),
             pa.array(np.full(n, block, np.int32))], names=names)

    def links(pairs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if pairs:
            a, b = (np.concatenate(side) for side in zip(*pairs, strict=True))
            yield rows(0, a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, block = np.zeros(0, np.int64), np.zeros(0, np.uint64), 0

        def big(group_keys, group, last):
            """Whole blocks of a key that goes on, or what is left of it."""
            nonlocal block
            while len(group) > (0 if last else BLOCK):  # one row of an open key is kept back
                part, group = group[:BLOCK], group[BLOCK:]
                yield from links(forest(part, int(group_keys[0]), max_bits))
                if block or len(group) or not last:
                    yield rows(1, np.full(len(part), group_keys[0], np.int64).view(np.uint64), part, block)
                block += 1
            return group

        def closed(k, f):
            """Groups that are complete; the first may go on from earlier blocks."""
            nonlocal block
            edge = np.flatnonzero(np.diff(k)) + 1
            begin = np.concatenate([[0], edge])
            size = np.diff(np.concatenate([begin, [len(k)]]))
            wide = (size > SMALL) | ((np.arange(len(size)) == 0) & (block > 0))
            pairs = []
            for g in np.flatnonzero(wide):
                part = f[begin[g]:begin[g] + size[g]]
                if block or len(part) > BLOCK:
                    yield from big(k[begin[g]:], part, True)
                else:
                    pairs += forest(part, int(k[begin[g]]), max_bits)
                block = 0
            few = np.repeat((size > 1) & ~wide, size)
            k, f = k[few], f[few]
            for lag in range(1, SMALL):
                at = np.flatnonzero(k[lag:] == k[:-lag])
                if not len(at):
                    break
                a, b = f[at], f[at + lag]
                ok = chained(a ^ b, k[at], max_bits)
                pairs.append((a[ok], b[ok]))
            yield from links(pairs)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield from closed(keys[:cut], fps[:cut])
                block, keys, fps = 0, keys[cut:], fps[cut:]
            if len(fps) >= 2 * BLOCK:
                fps = yield from big(keys, fps, False)
                keys = keys[:len(fps)] if len(fps) else keys[:0]
        if len(keys):
            yield from closed(keys, fps)

    return run


def block_links(max_bits: int):
    """Links between two blocks of one key."""
    def run(table: pa.Table) -> pa.Table:
        fps = np.unique(table.column("fp").to_numpy().view(np.uint64))
        pairs = forest(fps, table.column("key")[0].as_py(), max_bits)
        a, b = (np.concatenate([np.zeros(0, np.uint64), *side]).view(np.int64)
                for side in ((p[0] for p in pairs), (p[1] for p in pairs)))
        return pa.table({"a": a, "b": b})
    return run


def near_links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links ``a, b`` that connect all fingerprints of ``nodes`` (distinct
    ``fp``) at ``max_bits`` or fewer differing bits (at most 4: the keys hold
    for that)."""
    if not 0 <= max_bits <= 4:
        raise ValueError("the five-segment ring serves distances up to 4 bits")
    keyed = nodes.select("fp").mapInArrow(chain_keys, "key long, fp long")
    found = cut_lineage(keyed.repartition("key").sortWithinPartitions("key", "fp")
                        .mapInArrow(key_links(max_bits), "kind int, a long, b long, block int"))
    wide = found.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("fp"), "block")
    counts = wide.groupBy("key").agg((F.max("block") + 1).alias("blocks"))
    other = F.col("other")
    meet = (wide.join(counts, "key")
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where(other != F.col("block"))
            .select("key", "fp", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")))
    across = meet.groupBy("key", "low", "high").applyInArrow(block_links(max_bits), "a long, b long")
    return found.where("kind = 0").select("a", "b").union(across)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    width: int = WIDTH, max_bits: int = MAX_BITS) -> DataFrame:
    """``id, fp, component``: component is the smallest id reachable."""
    fps = cut_lineage(fingerprints(docs, id_col, text_col, width))
    nodes = cut_lineage(fps.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(near_links(nodes, max_bits))
    rooted = (nodes.join(roots, nodes.fp == roots.node, "left")
              .select("fp", "least", F.coalesce("root", "fp").alias("root")))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = rooted.join(smallest, "root").select(F.col("fp").alias("of"), "component")
    return fps.join(named, fps.fp == named.of).select("id", "fp", "component")
