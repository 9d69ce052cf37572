"""Packing by power-of-two decomposition.

A document of L tokens is cut into pieces whose lengths are the binary digits of
L (and as many pieces of the full length as fit above them), longest first. A
sequence is one piece, so no sequence crosses documents and none is padded:
every length is a power of two. Pieces of one length belong to one bucket, from
which batches of equal shape are drawn.

Ids are those of the ``tokenizers`` library as it stands, so an added token of the
vocabulary (``<|endoftext|>``) that a text holds is one id.

Defined results: a null text packs as the empty text, which is its end token
alone (one piece of length 1). Null or repeated doc_ids are packed row by row.
An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import blocks, column, runs, text_bytes

END_TOKEN = 1
#: Bytes of text encoded together in a task.
BLOCK = 6 << 20
PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"


def pieces_of(tokens: np.ndarray, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For documents of so many tokens: each piece's document, start and length (longest first)."""
    bits = largest.bit_length()
    full = tokens // largest
    counts = np.stack([full, *((tokens >> k) & 1 for k in range(bits - 2, -1, -1))], axis=1)
    sizes = np.array([largest, *(1 << k for k in range(bits - 2, -1, -1))])
    length = np.repeat(np.tile(sizes, len(tokens)), counts.ravel())
    per_document = counts.sum(axis=1)
    document, _ = runs(per_document)
    ends = np.cumsum(length)
    before = np.cumsum(tokens) - tokens
    return document, ends - length - before[document], length


def pack(docs: DataFrame, vocabulary: str, *, text: str = "text", doc_id: str = "doc_id", largest: int = 2048, end_token: int = END_TOKEN) -> DataFrame:
    """One row per piece: its document, ``start``, ``length``, bucket, token ids and sequence.

    ``ids`` holds little-endian unsigned 32-bit ids; ``unpack_ids`` turns it into
    an array. ``sequence_id`` is unique over the result; a sequence holds one
    piece, at ``offset`` 0. ``bucket`` is log2 of the length: write the result
    partitioned by it to read batches of equal length. No shuffle is needed.
    """
    if largest < 1 or largest & (largest - 1):
        raise ValueError("largest must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for block in blocks(batches, "text", BLOCK):
            ids, at = own.encode_texts(*text_bytes(column(block, "text")))
            tokens = np.diff(at) + 1
            whole = np.insert(ids, at[1:], end_token).astype("<u4")
            document, start, length = pieces_of(tokens, largest)
            bounds = np.append(0, np.cumsum(length)) * 4
            packed = pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(bounds), pa.py_buffer(whole)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [column(block, "doc_id").take(pa.array(document)), pa.array(start), pa.array(length), pa.array(tokens[document]), packed],
                ["doc_id", "start", "length", "doc_tokens", "ids"],
            )

    pieces = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, PIECES)
    return pieces.select(
        "*",
        F.log2("length").cast("int").alias("bucket"),
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )


def unpack_ids(ids: bytes) -> list[int]:
    """The ids of a piece as a list."""
    return np.frombuffer(ids, "<u4").tolist()
