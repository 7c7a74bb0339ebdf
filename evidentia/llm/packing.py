"""Packing by power-of-two decomposition.

A document's token ids, with the end id, are cut into pieces of the sequence length and, for the rest, of the
powers of two that make up its length. Every piece is a sequence of its own, in the bucket of its length, so no sequence
crosses documents and none needs padding.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evidentia.llm.shared import small_batches

LENGTH = 2048
END_ID = 1
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: The same vocabulary as ranks, for the faster encoder.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
_SPECIAL = "<|endoftext|>"


@lru_cache(2)
def _fast(ranks: str) -> tiktoken.Encoding:
    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


@lru_cache(2)
def _slow(vocabulary: str) -> Tokenizer:
    return Tokenizer.from_file(vocabulary)


def ordinary(text: str, ranks: str = RANKS) -> list[int]:
    """The ids of a text in which the special token's spelling is ordinary text."""
    return _fast(ranks).encode_ordinary(text)


def encode(text: str, vocabulary: str = VOCABULARY, ranks: str = RANKS) -> list[int]:
    """The ids that the vocabulary file's tokenizer gives without added special tokens.

    Both libraries give the same ids; the slower one is asked only where the text spells its special token.
    """
    if _SPECIAL in text:
        return _slow(vocabulary).encode(text, add_special_tokens=False).ids
    return ordinary(text, ranks)


def cuts(tokens: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of so many tokens, in order."""
    full = tokens // length
    pieces = [(i * length, length) for i in range(full)]
    start, rest = full * length, tokens % length
    while rest:
        size = 1 << (rest.bit_length() - 1)
        pieces.append((start, size))
        start, rest = start + size, rest - size
    return pieces


_PIECE = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))]
_ROWS = 512


def _cutter(vocabulary: str, ranks: str, length: int, end_id: int, with_ids: bool):
    shape = pa.schema(_PIECE if with_ids else _PIECE[:-1])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, _ROWS):
                part = batch.slice(i, _ROWS)
                rows = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found = encode(text or "", vocabulary, ranks)
                    found.append(end_id)
                    ids = np.array(found, "<u4")
                    for start, size in cuts(len(ids), length):
                        piece = ids[start : start + size]
                        rows.append((doc, start, size, zlib.crc32(piece.tobytes()), len(ids), *([piece.astype(np.int32)] if with_ids else [])))
                columns = zip(*rows, strict=True) if rows else [[]] * len(shape)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, shape.types, strict=True)], schema=shape)

    return cut


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, vocabulary: str = VOCABULARY, ranks: str = RANKS, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, [ids,] bucket, sequence_id, offset.

    ``bucket`` is the power of two; the sequences of one bucket have equal lengths, so a batch is drawn from one bucket.
    A null text is empty and gives the end id alone. Repeated rows are packed each; no rows give no rows.
    ``length`` must be a power of two.
    """
    if length & (length - 1):
        raise ValueError("the sequence length must be a power of two")
    small_batches(docs.sparkSession)
    shape = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = rows.mapInArrow(_cutter(vocabulary, ranks, length, end_id, with_ids), shape)
    return pieces.select("*", F.log2("length").cast("int").alias("bucket"), F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
