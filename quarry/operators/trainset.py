"""Training-set preparation without one big string.

The corpus is the ordered concatenation of documents.  Character positions come
from the corpus's layout (:mod:`quarry.operators.layout`): texts are shuffled and
written once, in order, and every cut is a projection over that.  Token positions
come from an exclusive prefix sum over the narrow ``(key, length)`` frame
(:mod:`quarry.operators.ordered`).  Texts are never gathered on one task or
collected.

Deviation (documented): tokens are cut per document, so a word is never split
across two documents' border as it would be in one concatenated string.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import TOKEN_PATTERN
from quarry.operators.batches import stretches
from quarry.operators.docs import normalized_layout
from quarry.operators.hooks import Hook, built
from quarry.operators.layout import between, text_layout
from quarry.operators.ordered import ordered_scan

# --- fixed values -----------------------------------------------------------
TRAIN_FRACTION = 0.8
BLOCK_SIZE = 128
VOCAB_SIZE = 50257          # ids 0..255 bytes, then corpus tokens, 50256 special
BYTE_IDS = 256
END_OF_TEXT_ID = 50256
# ----------------------------------------------------------------------------
TOKENS_AT_A_TIME = 1 << 18  # tokens whose ids are made together
IDS_AT_A_TIME = 1 << 20     # ids whose text is made together


def corpus_offsets(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """A4: ``key, n_chars, char_start, char_start_total`` (the corpus length)."""
    narrow = docs.select(key, F.length("text").cast("bigint").alias("n_chars"))
    return ordered_scan(narrow, key, sums={"char_start": "n_chars"}, totals=True)


def _split(placed: DataFrame, low: Column, high: Column, fraction: float, key: str) -> DataFrame:
    cut = low + F.floor(F.lit(float(fraction)) * (high - low).cast("double")).cast("bigint")
    parts = placed.select(key, F.explode(F.array(
        F.struct(F.lit("train").alias("split"), between("text", low, cut).alias("text")),
        F.struct(F.lit("val").alias("split"), between("text", cut, high).alias("text")))).alias("p"))
    return (parts.select(F.col("p.split").alias("split"), key, F.col("p.text").alias("text"))
            .where(F.length("text") > 0))


def char_split(docs: DataFrame, fraction: float = TRAIN_FRACTION, key: str = "doc_id") -> DataFrame:
    """Cut the corpus at ``int(fraction * length)`` characters; a
    document across the cut is sliced.  Returns ``split, key, text`` (no empty
    parts)."""
    placed = text_layout(docs.select(key, "text"), key, "text")
    total = placed.agg(F.sum("_n")).first()[0] or 0
    return _split(placed, F.lit(0).cast("bigint"), F.lit(total).cast("bigint"), fraction, key)


def normalized_split(docs: DataFrame, fraction: float = TRAIN_FRACTION, key: str = "doc_id") -> DataFrame:
    """F3 and W2 in one reading of the layout: what :func:`char_split` makes of the
    normalised corpus; texts are shuffled and written once."""
    placed, low, high = normalized_layout(docs, key)
    return _split(placed, F.lit(low).cast("bigint"), F.lit(high).cast("bigint"), fraction, key)


def with_tokens(parts: DataFrame, out_col: str = "tokens") -> DataFrame:
    """Add the token array once (e.g. before a checkpoint shared by the
    vocabulary and the ids)."""
    return parts.withColumn(out_col, F.regexp_extract_all("text", F.lit(TOKEN_PATTERN), 0))


def build_vocab(parts: DataFrame, size: int = VOCAB_SIZE - 1, tokens_col: str = "tokens") -> DataFrame:
    """M5 default vocabulary ``token, id``: ids below 256 are the byte values and
    not listed; the most frequent tokens, ties by token, get 256 to ``size`` - 1.
    Counting is a partial and a final aggregate, the choice a
    TakeOrderedAndProject, so at most ``size`` rows are ranked."""
    top = (parts.select(F.explode(tokens_col).alias("token")).groupBy("token").agg(F.count("*").alias("cnt"))
           .orderBy(F.desc("cnt"), "token").limit(max(0, size - BYTE_IDS)))
    w = Window.orderBy(F.desc("cnt"), "token")  # over <= size rows
    return top.select("token", (F.row_number().over(w) - 1 + BYTE_IDS).alias("id"))


def _vocab_table(vocab: DataFrame) -> list[tuple[str, int]]:
    """The vocabulary on the driver: at most ``VOCAB_SIZE`` rows by construction."""
    got = vocab.limit(VOCAB_SIZE + 1).toArrow()
    if got.num_rows > VOCAB_SIZE:
        raise ValueError(f"a vocabulary has at most {VOCAB_SIZE} tokens")
    return list(zip(got["token"].to_pylist(), got["id"].to_pylist(), strict=True))


def as_lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets and values of a list column; a null list is empty."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes)]), column.flatten()


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each stretch, one after the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _encoder(shared: Broadcast, place: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array([t for t, _ in shared.value], pa.string())
        number = np.array([i for _, i in shared.value], dtype=np.int32)
        for b in stretches(batches, place, TOKENS_AT_A_TIME):
            offsets, values = as_lists(b.column(place))
            coded = values.cast(pa.string()).dictionary_encode()
            kinds, of = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
            found = pc.fill_null(pc.index_in(kinds, value_set=known), -1).to_numpy(zero_copy_only=False)
            written = [t.encode("utf-8") for t in kinds.filter(pa.array(found < 0)).to_pylist()]     # tokens outside the vocabulary
            size = np.ones(len(kinds), dtype=np.int64)
            size[found < 0] = [len(t) for t in written]
            flat = np.empty(int(size.sum()), dtype=np.int32)     # the ids of each distinct token
            begin = np.cumsum(size) - size
            flat[begin[found >= 0]] = number[found[found >= 0]]
            flat[spread(begin[found < 0], size[found < 0])] = np.frombuffer(b"".join(written), dtype=np.uint8)
            ids = flat[spread(begin[of], size[of])]
            ends = np.concatenate([[0], np.cumsum(size[of])])[offsets]
            kept = [c for i, c in enumerate(b.columns) if i != place]
            yield pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))], names=names)
    return run


def tokenize(parts: DataFrame, vocab: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """M5: ``parts`` with ``input_ids`` in place of the token array.  A token
    outside the vocabulary becomes the ids of its bytes, so nothing is lost.
    The bounded vocabulary is broadcast to an Arrow map; no shuffle."""
    shared = parts.sparkSession.sparkContext.broadcast(_vocab_table(vocab))
    kept = [f for f in parts.schema.fields if f.name not in (tokens_col, "input_ids")]
    schema = T.StructType([*kept, T.StructField("input_ids", T.ArrayType(T.IntegerType()))])
    rows = parts.select(*[f.name for f in kept], tokens_col)
    return rows.mapInArrow(_encoder(shared, len(kept), schema.fieldNames()), schema)


def _decoder(shared: Broadcast, place: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = {i: t.encode("utf-8") for t, i in shared.value} | {i: bytes([i]) for i in range(BYTE_IDS)}
        table = pa.array([text.get(i, b"") for i in range(max(text) + 1)] + [b""], pa.large_binary())
        for b in stretches(batches, place, IDS_AT_A_TIME):
            offsets, values = as_lists(b.column(place))
            ids = pc.fill_null(values, -1).to_numpy(zero_copy_only=False)
            pieces = table.take(pa.array(np.where((ids >= 0) & (ids < len(table)), ids, len(table) - 1)))
            bounds = np.frombuffer(pieces.buffers()[1], dtype=np.int64, count=len(pieces) + 1)[offsets]
            whole = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(bounds), pieces.buffers()[2] or pa.py_buffer(b"")])
            try:
                texts = whole.cast(pa.string())
            except pa.ArrowInvalid:                          # cut characters
                texts = pa.array([t.decode("utf-8", "replace") for t in whole.to_pylist()], pa.string())
            kept = [c for i, c in enumerate(b.columns) if i != place]
            yield pa.RecordBatch.from_arrays([*kept, texts], names=names)
    return run


def detokenize(ids: DataFrame, vocab: DataFrame) -> DataFrame:
    """M6: ids → text; the special id is skipped."""
    shared = ids.sparkSession.sparkContext.broadcast(_vocab_table(vocab))
    kept = [f for f in ids.schema.fields if f.name not in ("input_ids", "text")]
    schema = T.StructType([*kept, T.StructField("text", T.StringType())])
    return ids.select(*[f.name for f in kept], "input_ids").mapInArrow(
        _decoder(shared, len(kept), schema.fieldNames()), schema)


def tokenize_with(parts: DataFrame, tokenizer: Hook) -> DataFrame:
    """M5 hook: a user tokenizer (e.g. a BPE model), built once per Python worker
    and fed Arrow batches of texts; returns ``parts`` with ``input_ids`` in place
    of ``text``.  Narrow, no shuffle."""
    kept = [f for f in parts.schema.fields if f.name not in ("text", "input_ids")]
    schema = T.StructType([*kept, T.StructField("input_ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(len(kept)).to_pylist()]
            ids = pa.array(built(tokenizer)(texts), type=pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], ids], names=schema.fieldNames())

    return parts.select(*[f.name for f in kept], "text").mapInArrow(run, schema)


def pack_blocks(ids: DataFrame, block_size: int = BLOCK_SIZE, key: str = "doc_id") -> DataFrame:
    """``split, block_id, input_ids`` — the ids of each split, in ``key``
    order, in blocks of ``block_size``; the last partial block is dropped.

    Each part learns the position of its first id from a prefix sum over the
    narrow lengths and cuts its own blocks; only the pieces at its two borders
    are grouped, so the shuffle carries about two short rows per part."""
    lengths = ids.select("split", F.col(key).alias("_key"), F.size("input_ids").cast("bigint").alias("_n"))
    placed = (ordered_scan(lengths, "_key", sums={"_off": "_n"}, group_cols=["split"])
              .select(F.col("split").alias("_split"), "_key", "_off"))
    rows = ids.join(placed, (F.col("split") == F.col("_split")) & (F.col(key) == F.col("_key")))
    first, last = F.floor(F.col("_off") / block_size), F.floor((F.col("_off") + F.size("input_ids") - 1) / block_size)
    # one row per block, and then the slice: a slice inside a lambda would copy the whole part for every block
    blocks = (rows.where(F.size("input_ids") > 0)
              .select("split", "_off", "input_ids", F.explode(F.sequence(first, last)).alias("block_id")))
    here = F.col("block_id") * block_size - F.col("_off")
    begin, end = F.greatest(here, F.lit(0)), F.least(here + block_size, F.size("input_ids"))
    ids_here = F.slice("input_ids", begin.cast("int") + 1, (end - begin).cast("int"))
    whole = blocks.where(end - begin == block_size).select("split", "block_id", ids_here.alias("input_ids"))
    border = (blocks.where(end - begin < block_size)
              .select("split", "block_id", (begin - here).cast("int").alias("slot"), ids_here.alias("ids")).groupBy("split", "block_id")
              .agg(F.array_sort(F.collect_list(F.struct("slot", "ids"))).alias("_p"))   # at most block_size ids
              .select("split", "block_id", F.flatten(F.transform("_p", lambda x: x["ids"])).alias("input_ids"))
              .where(F.size("input_ids") == block_size))
    return whole.unionByName(border)


def collate_blocks(blocks: DataFrame) -> DataFrame:
    """causal-LM collation: attention mask of ones, labels = input ids."""
    return (blocks.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))
            .withColumn("labels", F.col("input_ids")))


