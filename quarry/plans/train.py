"""A corpus, or a directory of files, to training blocks."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import token_pieces
from quarry.operators.trainset import (BLOCK_SIZE, TRAIN_FRACTION, VOCAB_SIZE, build_vocab, collate_blocks,
                                       normalized_split, pack_blocks, tokenize, with_tokens)
from quarry.session import cut_lineage
from quarry.sources.files import directory_scan

PIECE = 8192                # characters of a file in a row, or to the end of the word


def split_parts(docs: DataFrame, key: str = "doc_id", fraction: float = TRAIN_FRACTION) -> DataFrame:
    """Normalised corpus cut into ``split, key, text``."""
    return normalized_split(docs, fraction, key)


def training_blocks(docs: DataFrame, key: str = "doc_id", fraction: float = TRAIN_FRACTION,
                    vocab_size: int = VOCAB_SIZE - 1, block_size: int = BLOCK_SIZE) -> DataFrame:
    """normalise → split → vocabulary → ids → blocks → collate.  The parts are
    written with their token arrays, so the tokenizer's regex runs once."""
    parts = cut_lineage(with_tokens(split_parts(docs, key, fraction)).drop("text"))
    ids = cut_lineage(tokenize(parts, build_vocab(parts, vocab_size)))
    return collate_blocks(pack_blocks(ids, block_size, key))


def directory_blocks(spark: SparkSession, directory: str,
                     pdf_extractor: Callable[[bytes], list[str]] | None = None, **sizes) -> DataFrame:
    """The same from the files of a directory, in order of their paths.  A file is
    cut between tokens into rows the size of a document, so that what a task holds at
    a time (a batch of rows of texts, tokens or ids) does not follow the files."""
    files = directory_scan(spark, directory, pdf_extractor)
    pieces = files.select("path", F.posexplode(token_pieces(F.coalesce("text", F.lit("")), PIECE)).alias("_n", "text"))
    # paths have no NUL, so pieces follow each other in the order of the paths
    place = F.concat("path", F.lit("\0"), F.lpad(F.col("_n").cast("string"), 10, "0"))
    return training_blocks(cut_lineage(pieces.select(place.alias("path"), "text")), key="path", **sizes)
