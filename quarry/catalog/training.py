"""Queries for the training corpus."""
from __future__ import annotations

from pyspark.sql import functions as F

from quarry.catalog import register
from quarry.catalog import sqlfrag as Q
from quarry.catalog.files import FILES_SQL, _write_files
from quarry.catalog.text import normalize_corpus_sql
from quarry.operators import trainset as TS
from quarry.operators.docs import normalize_corpus
from quarry.plans.train import directory_blocks, split_parts, training_blocks
from quarry.session import cut_lineage, scratch_path
from quarry.sources.tables import table

SMALL_VOCAB = 1000       # so that the tables have tokens outside it


def _docs(spark, sf):
    return table(spark, sf, "documents", ["doc_id", "text"])


def _parts(spark, sf):
    return split_parts(_docs(spark, sf))


def _ids_vocab(spark, sf, vocab_size):
    parts = cut_lineage(TS.with_tokens(_parts(spark, sf)).drop("text"))
    vocab = TS.build_vocab(parts, vocab_size)
    return TS.tokenize(parts, vocab), vocab


def offsets_sql() -> str:
    return normalize_corpus_sql() + """,
offs AS (SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n_chars,
  CAST(coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    AS BIGINT) AS char_start FROM norm)"""


def split_sql(fraction: float = TS.TRAIN_FRACTION) -> str:
    return offsets_sql() + f""",
cut AS (SELECT CAST(floor(CAST({fraction} AS DOUBLE) * CAST(coalesce(sum(n_chars), 0) AS DOUBLE)) AS BIGINT) AS c FROM offs),
sp AS (SELECT doc_id, text, CAST(least(greatest(cut.c - char_start, 0), n_chars) AS BIGINT) AS k FROM offs, cut),
parts AS (SELECT * FROM (
  SELECT 'train' AS split, doc_id, substring(text, 1, k) AS text FROM sp
  UNION ALL SELECT 'val', doc_id, substring(text, k + 1) FROM sp) WHERE length(text) > 0)"""


def ids_sql(vocab_size: int = TS.VOCAB_SIZE - 1) -> str:
    """Token rows ``ids(split, doc_id, pos, sub, id)``: a token outside the
    vocabulary is its UTF-8 bytes, in order ``sub``."""
    return split_sql() + f""",
toks AS (SELECT split, doc_id, unnest({Q.token_list('text')}) AS token,
  generate_subscripts({Q.token_list('text')}, 1) - 1 AS pos FROM parts),
vocab AS (SELECT token, id FROM (SELECT token, row_number() OVER (ORDER BY cnt DESC, token) - 1 + {TS.BYTE_IDS} AS id
  FROM (SELECT token, count(*) AS cnt FROM toks GROUP BY token)) WHERE id < {vocab_size}),
named AS (SELECT t.*, v.id FROM toks t LEFT JOIN vocab v USING (token)),
ids AS (SELECT split, doc_id, pos, 0 AS sub, id FROM named WHERE id IS NOT NULL
  UNION ALL SELECT split, doc_id, pos, sub, ('0x' || substr(h, 2 * sub + 1, 2))::BIGINT AS id FROM (
    SELECT split, doc_id, pos, hex(encode(token)) AS h, unnest(range(0, octet_length(encode(token)))) AS sub
    FROM named WHERE id IS NULL))"""


def blocks_sql(vocab_size: int = TS.VOCAB_SIZE - 1) -> str:
    return ids_sql(vocab_size) + f""",
g AS (SELECT split, (n // {TS.BLOCK_SIZE})::BIGINT AS block_id, n, id FROM (
  SELECT split, id, row_number() OVER (PARTITION BY split ORDER BY doc_id, pos, sub) - 1 AS n FROM ids)),
blocks AS (SELECT split, block_id, list(id ORDER BY n) AS ids FROM g GROUP BY ALL HAVING count(*) = {TS.BLOCK_SIZE})"""


@register("corpus_offsets", "A4,W2", lambda: "WITH " + offsets_sql() + " SELECT doc_id, char_start, n_chars FROM offs")
def q_corpus_offsets(spark, sf):
    off = TS.corpus_offsets(cut_lineage(normalize_corpus(_docs(spark, sf))))
    return off.select("doc_id", F.col("char_start").cast("bigint").alias("char_start"), "n_chars")


@register("char_split", "W2,F13", lambda: "WITH " + split_sql() + " SELECT split, doc_id, text FROM parts")
def q_char_split(spark, sf):
    return _parts(spark, sf).select("split", "doc_id", "text")


@register("train_val_sink", "S10", lambda: "WITH " + split_sql() + " SELECT split, doc_id, text FROM parts")
def q_train_val_sink(spark, sf):
    """Write train/validation text partitioned by split, read it back."""
    path = scratch_path(spark, "trainval")
    _parts(spark, sf).select("split", "doc_id", "text").write.partitionBy("split").parquet(path)
    return spark.read.parquet(path).select("split", "doc_id", "text")


def _tokens_of(spark, sf, vocab_size):
    ids, _ = _ids_vocab(spark, sf, vocab_size)
    return ids.select("split", "doc_id", F.size("input_ids").cast("bigint").alias("n_tokens"),
                      F.array_join("input_ids", " ").alias("ids"))


TOKENS_SQL = """
SELECT split, doc_id, CAST(count(*) AS BIGINT) AS n_tokens, array_to_string(list(id ORDER BY pos, sub), ' ') AS ids
FROM ids GROUP BY ALL"""


@register("tokenize", "M5", lambda: "WITH " + ids_sql() + TOKENS_SQL)
def q_tokenize(spark, sf):
    return _tokens_of(spark, sf, TS.VOCAB_SIZE - 1)


@register("tokenize_small_vocab", "M5", lambda: "WITH " + ids_sql(SMALL_VOCAB) + TOKENS_SQL)
def q_tokenize_small_vocab(spark, sf):
    """A vocabulary smaller than the corpus's: rarer tokens become bytes."""
    return _tokens_of(spark, sf, SMALL_VOCAB)


@register("detokenize", "M6", lambda: "WITH " + split_sql() + " SELECT split, doc_id, text FROM parts")
def q_detokenize(spark, sf):
    """Ids back to text, with a vocabulary that lacks most tokens: nothing is lost."""
    return TS.detokenize(*_ids_vocab(spark, sf, SMALL_VOCAB)).select("split", "doc_id", "text")


@register("pack_blocks", "W3", lambda: "WITH " + blocks_sql(SMALL_VOCAB) + " SELECT split, block_id, array_to_string(ids, ' ') AS ids FROM blocks")
def q_pack_blocks(spark, sf):
    ids, _ = _ids_vocab(spark, sf, SMALL_VOCAB)
    return TS.pack_blocks(cut_lineage(ids)).select("split", "block_id", F.array_join("input_ids", " ").alias("ids"))


BLOCKS_SQL = f"""
SELECT split, block_id, CAST(len(ids) AS BIGINT) AS n_ids, CAST(len(ids) AS BIGINT) AS mask_ones,
  array_to_string(ids, ' ') AS labels,
  CAST(len([x FOR x IN ids IF x < {TS.BYTE_IDS}]) AS BIGINT) AS n_bytes FROM blocks"""


def _collated(blocks):
    return blocks.select("split", "block_id", F.size("input_ids").cast("bigint").alias("n_ids"),
                         F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("mask_ones"),
                         F.array_join("labels", " ").alias("labels"),
                         F.size(F.filter("input_ids", lambda x: x < TS.BYTE_IDS)).cast("bigint").alias("n_bytes"))


@register("training_blocks", "M11,F15", lambda: "WITH " + blocks_sql() + BLOCKS_SQL)
def q_training_blocks(spark, sf):
    """Composite: normalise → split → tokenise → pack → collate."""
    return _collated(training_blocks(_docs(spark, sf)))


def _directory_sql() -> str:
    files = "(SELECT '/file_no=' || file_no || '/' AS doc_id, text FROM files)"
    return "WITH " + FILES_SQL + ", " + blocks_sql().replace("FROM documents", "FROM " + files, 1) + BLOCKS_SQL


@register("directory_blocks", "M11,S6", _directory_sql)
def q_directory_blocks(spark, sf):
    """The composite from a directory of files, in order of their paths."""
    return _collated(directory_blocks(spark, _write_files(spark, sf) + "/file_no=*"))
