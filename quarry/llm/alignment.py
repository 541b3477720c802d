"""Cross-tokenizer alignment: where two tokenizers cut a text alike.

Each text, with a space before it, is encoded by a byte-level BPE (A) and by a
piece model (B).  Byte offsets where tokens of both end cut it into groups; an
A-B pair of tokens that end together is a link; a pair's count is how many links
of the corpus hold it.

1. Exact-text deduplication: documents are grouped by their full text (partial
   counts first, so a text with many copies is one row a task), and only
   distinct texts are tokenised, once each.
2. Distinct texts are packed, about a slice of text a row, with the pack's
   distinct pairs, their weights (links times copies) and each link as a number
   among them; packs are written to the checkpoint folder.
3. Weights are summed over packs, one row per pair of a pack.
4. The counts return to the packs in slices of at most ``SLICE_PAIRS`` pairs (by
   a hash of the pair): the number of pairs follows the data, a slice does not, so
   a slice is small enough to be broadcast.  Each pass adds what its pairs
   contribute; with one slice there is one pass.  The highest count per B id is
   one number per id of the vocabulary.
5. Measures join document ids by the SHA-256 of the text.  Texts with more than
   1 / ``HOT_SHARE`` of all copies, fewer than ``HOT_SHARE`` by that definition, are
   joined as a broadcast; all others by a shuffle of (id, hash).

Defined results: a text that is null or empty, or whose A or B tokens do not
spell it byte for byte, has no tokens: zeros and an empty digest; it adds to no
count.  Repeated rows count each.  A text is handled whole.
"""
from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
import zstandard

from quarry.llm.common import utf8
from quarry.llm.words import slices
from quarry.session import cut_lineage

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
SLICE_PAIRS = 4 << 20    # pairs of counts broadcast together
HOT_SHARE = 1000
LONG_SPACE = re.compile(r"\s{4096}")   # longer white space overflows the faster library's pattern
# --- fixed value: how the byte-level vocabulary cuts a text before merging ----
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# ------------------------------------------------------------------------------

MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
PACKS = ("hashes array<binary>, copies array<long>, digests array<string>, n_a array<long>, n_b array<long>, n_groups array<long>, "
         "codes array<long>, weights array<long>, links binary, n_best array<long>, count_sum array<long>")


# --- vocabularies --------------------------------------------------------------

def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable
    Latin-1 letters stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(other)}


def load(byte_bpe: str = BYTE_BPE, pieces: str = PIECES) -> dict:
    """Both vocabularies (the files are read here, on the driver): the bytes of
    A's mergeable tokens by id, which are in the order of their merges, and B's model file."""
    with open(byte_bpe, encoding="utf-8") as f:
        whole = json.load(f)
    special = {t["content"] for t in whole.get("added_tokens", [])}
    letters = byte_letters()
    ranks = {bytes(letters[c] for c in token): i for token, i in whole["model"]["vocab"].items() if token not in special}
    with open(pieces, "rb") as f:
        return {"json": json.dumps(whole), "ranks": base64.b64encode(json.dumps([[base64.b64encode(t).decode(), i] for t, i in ranks.items()]).encode()),
                "pieces": f.read()}


class Pair:
    """The two tokenizers, with the bytes of each token."""

    def __init__(self, model: dict):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        ranks = {base64.b64decode(t): i for t, i in json.loads(base64.b64decode(model["ranks"]))}
        self.a = tiktoken.Encoding("a", pat_str=CUTS, mergeable_ranks=ranks, special_tokens={})
        self.slow_a = Tokenizer.from_str(model["json"])
        self.slow_a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model["pieces"])
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[1:-1], 16)]) if self.b.is_byte(i)
                        else self.b.id_to_piece(i).replace(MARK, " ").encode() for i in range(self.b.get_piece_size())]
        top = max(ranks.values()) + 1
        self.a_size = np.zeros(top, dtype=np.int64)
        self.a_size[list(ranks.values())] = [len(t) for t in ranks]
        self.b_size = np.array([len(t) for t in self.b_bytes], dtype=np.int64)
        self.width = len(self.b_bytes)
        written = [str(i) for i in range(max(top, self.width))]
        self.written = pa.array([f"{w}{end}" for end in ",|;" for w in written], pa.large_binary())
        self.kinds = len(written)

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of both tokenizers; two empty lists where B does not spell the text."""
        if not text:
            return [], []
        b = self.b.encode(text)
        spaced = " " + text
        if b"".join([self.b_bytes[i] for i in b]) != spaced.encode():
            return [], []
        if LONG_SPACE.search(text):
            return self.slow_a.encode(spaced, add_special_tokens=False).ids, b
        return self.a.encode_ordinary(spaced), b


@lru_cache(maxsize=1)
def _pair(key: str, value: tuple) -> Pair:
    return Pair(dict(value))


def worker_pair(model: Broadcast) -> Pair:
    """The tokenizers of a worker, built once."""
    value = model.value
    return _pair(hashlib.sha256(value["json"].encode() + value["pieces"]).hexdigest(), tuple(value.items()))


# --- alignment -----------------------------------------------------------------

def aligned(pair: Pair, texts: list[str]) -> dict:
    """Per text: token and group numbers and digest; per link of all texts its
    pair code, and the links up to each text's end."""
    both = [pair.encode(t) for t in texts]
    flat = lambda k: np.fromiter((i for x in both for i in x[k]), dtype=np.int64, count=sum(len(x[k]) for x in both))
    a, b = flat(0), flat(1)
    n_a, n_b = (np.array([len(x[k]) for x in both], dtype=np.int64) for k in (0, 1))
    end_a, end_b = np.cumsum(pair.a_size[a]), np.cumsum(pair.b_size[b])
    cut = np.zeros(int(end_a[-1]) + 1 if len(end_a) else 1, dtype=bool)
    cut[end_a] = True
    last_b = np.flatnonzero(cut[end_b]) if len(end_b) else np.zeros(0, np.int64)
    last_a = np.searchsorted(end_a, end_b[last_b])
    text_ends = np.searchsorted(last_a, np.cumsum(n_a))          # links up to a text's end
    text_begins = np.concatenate([[0], text_ends[:-1]])

    # ids in the order a1,a2|b1;a3|b2: a token follows the other side's earlier groups
    group_a, group_b = (np.searchsorted(last, np.arange(len(ids))) for last, ids in ((last_a, a), (last_b, b)))
    before_b = np.concatenate([[0], last_b + 1])[group_a]
    before_a = (last_a + 1)[group_b]
    ends_a, ends_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    ends_a[last_a], ends_b[last_b] = 1, 2
    order = np.empty(len(a) + len(b), dtype=np.int64)
    order[np.arange(len(a)) + before_b] = a + ends_a * pair.kinds
    order[np.arange(len(b)) + before_a] = b + ends_b * pair.kinds
    text = pair.written.take(pa.array(order))
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64, count=len(order) + 1)[np.concatenate([[0], np.cumsum(n_a + n_b)])]
    data = memoryview(text.buffers()[2] or b"")
    digests = [hashlib.sha256(data[x:y - 1]).hexdigest() if y > x else "" for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return {"n_a": n_a, "n_b": n_b, "n_groups": text_ends - text_begins, "digests": digests,
            "codes": a[last_a] * pair.width + b[last_b], "ends": text_ends}


def packing(model: Broadcast):
    """(text, hash, copies) rows of distinct texts to packs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = worker_pair(model)
        for batch in batches:
            sized = utf8(batch.column(0))
            for begin, end in slices(sized):
                b = batch.slice(begin, end - begin)
                got = aligned(pair, b.column(0).to_pylist())
                copies = b.column(2).to_numpy()
                codes, number = np.unique(got["codes"], return_inverse=True)
                links = np.diff(got["ends"], prepend=0)
                weights = np.bincount(number, weights=np.repeat(copies, links), minlength=len(codes)).astype(np.int64)
                one = lambda x, kind=pa.int64(): pa.array([x], pa.list_(kind))
                zeros = np.zeros(len(copies), dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [one(b.column(1).to_pylist(), pa.binary()), one(copies), one(got["digests"], pa.string()), one(got["n_a"]),
                     one(got["n_b"]), one(got["n_groups"]), one(codes), one(weights),
                     pa.array([zstandard.compress(number.astype(np.int32).tobytes(), 3)], pa.binary()), one(zeros), one(zeros)],
                    names=[x.split()[0] for x in PACKS.split(", ")])
    return run


def adding(counts: Broadcast, highest: Broadcast):
    """Adds to each text of a pack what a slice of the counts contributes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = counts.value
        top = highest.value
        for batch in batches:
            names = batch.schema.names
            place = {c: i for i, c in enumerate(names)}
            sums, best = [], []
            for row in range(batch.num_rows):
                value = lambda c: batch.column(place[c])[row].values.to_numpy()  # noqa: B023, E731
                codes = value("codes")
                at = np.minimum(np.searchsorted(known, codes), max(len(known) - 1, 0))
                count = np.where(known[at] == codes, n[at], 0) if len(known) else np.zeros(len(codes), np.int64)
                is_best = (count > 0) & (count == top[codes % len(top)]) if len(codes) else np.zeros(0, bool)
                number = np.frombuffer(zstandard.decompress(batch.column(place["links"])[row].as_py()), dtype=np.int32)
                edges = np.concatenate([[0], np.cumsum(value("n_groups"))])
                for out, values, old in ((sums, count, "count_sum"), (best, is_best, "n_best")):
                    total = np.concatenate([[0], np.cumsum(values[number].astype(np.int64))])
                    out.append((total[edges[1:]] - total[edges[:-1]] + value(old)).tolist())
            columns = list(batch.columns)
            columns[place["count_sum"]] = pa.array(sums, pa.list_(pa.int64()))
            columns[place["n_best"]] = pa.array(best, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=names)
    return run


def pair_counts(packs: DataFrame) -> DataFrame:
    """``code, n``: links of each pair over all documents."""
    return (packs.select(F.explode(F.arrays_zip("codes", "weights")).alias("x"))
            .groupBy(F.col("x.codes").alias("code")).agg(F.sum("x.weights").alias("n")))


def counted(packs: DataFrame, width: int, slice_pairs: int) -> tuple[DataFrame, DataFrame]:
    """Packs with the sums of their texts, and the pair counts."""
    context = packs.sparkSession.sparkContext
    counts = cut_lineage(pair_counts(packs))
    top = np.zeros(width, dtype=np.int64)
    rows = counts.groupBy((F.col("code") % width).alias("b")).agg(F.max("n").alias("n")).toArrow()   # a row per B id
    top[rows.column("b").to_numpy()] = rows.column("n").to_numpy()
    highest = context.broadcast(top)
    passes = max(1, -(-2 * counts.count() // slice_pairs)) if counts.count() > slice_pairs else 1
    for k in range(passes):
        some = counts.where(F.pmod(F.xxhash64("code"), F.lit(passes)) == k).toArrow()
        code, n = (some.column(c).to_numpy() for c in ("code", "n"))
        order = np.argsort(code)
        packs = packs.mapInArrow(adding(context.broadcast((code[order], n[order])), highest), PACKS)
        if k + 1 < passes:
            packs = cut_lineage(packs)
    return packs, counts


def align(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text",
          slice_pairs: int = SLICE_PAIRS) -> tuple[DataFrame, DataFrame]:
    """``id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of
    every document, and the links of each pair of ids: ``a, b, n``."""
    spark = docs.sparkSession
    width = Pair(model).width
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    some = F.col("text").isNotNull() & (F.col("text") != "")
    text_hash = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    texts = rows.where(some).groupBy("text").agg(F.count("*").alias("copies"))
    packs = cut_lineage(texts.select("text", text_hash.alias("hash"), "copies").mapInArrow(packing(shared), PACKS))
    done, counts = counted(packs, width, slice_pairs)
    arrays = {"hash": "hashes", "copies": "copies", "groups_sha256": "digests", "n_a": "n_a", "n_b": "n_b", "n_groups": "n_groups",
              "n_best": "n_best", "count_sum": "count_sum"}
    measures = cut_lineage(done.select(F.explode(F.arrays_zip(*dict.fromkeys(arrays.values()))).alias("x"))
                           .select(*[F.col(f"x.{c}").alias(k) for k, c in arrays.items()]))
    total = measures.agg(F.sum("copies")).first()[0] or 0
    hot = F.col("copies") * HOT_SHARE > total
    values = [c for c in measures.columns if c not in ("hash", "copies")]
    keyed = cut_lineage(rows.select("id", F.when(some, text_hash).alias("hash")))
    few = F.broadcast(measures.where(hot).drop("copies"))
    joined = [keyed.join(few, "hash"),
              keyed.where("hash IS NOT NULL").join(few, "hash", "left_anti").join(measures.where(~hot).drop("copies"), "hash"),
              keyed.where("hash IS NULL").select("*", *[F.lit("" if c == "groups_sha256" else 0).alias(c) for c in values])]
    out = joined[0].select("id", *values)
    for part in joined[1:]:
        out = out.unionByName(part.select("id", *values))
    return (out.select("id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256"),
            counts.select(F.floor(F.col("code") / width).alias("a"), (F.col("code") % width).alias("b"), "n"))
