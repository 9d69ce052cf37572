"""Byte-level BPE encoding and decoding by overlapping chunks.

A long text is cut into chunks that overlap. The chunks are pre-tokenised in
parallel, each from its own first code point; two neighbours are stitched at the
first pre-token boundary of the overlap that both have found, for from a common
boundary on the pattern goes on alike. The stitched pieces hold whole pre-tokens
and are encoded in parallel. Where an overlap has no common boundary (one
pre-token covers it), the right chunk's boundaries are found again from the last
sure boundary on the left, so the result is always that of the whole text.
Texts of one chunk take none of these shuffles. Only boundaries within overlaps
and ids travel beside the text; the bytes are decoded where a text's ids are
joined. Decoding concatenates raw bytes.

Defined results: a null text encodes as the empty text: no ids, hashes of the
empty string. Null or repeated doc_ids are encoded row by row; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Encoder, encoder, pre_tokens
from .common import blocks, column, text_bytes

BLOCK = 6 << 20
#: Characters of a chunk, and of the overlap with the next.
CHUNK, OVERLAP = 16_384, 1_024
ENCODED = "doc_id long, n_tokens long, ids binary, decoded binary"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _decoded(own: Encoder, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the ids, and the offsets of each text's bytes."""
    data, bounds = text_bytes(own.token_bytes.take(pa.array(ids)))
    return data, bounds[at]


def _rows(key: pa.Array, own: Encoder, ids: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([key, pa.array(np.diff(at)), _packed(ids.astype("<u4"), at * 4), _packed(*_decoded(own, ids, at))], ["doc_id", "n_tokens", "ids", "decoded"])


def _digest_rows(key: pa.Array, own: Encoder, ids: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    decimals, bounds = text_bytes(own.decimals.take(pa.array(ids)))
    hashes = []
    for data, ends, cut in ((decimals, bounds[at], 1), (*_decoded(own, ids, at), 0)):
        view = memoryview(np.ascontiguousarray(data))
        hashes.append(pa.array([hashlib.sha256(view[a : max(a, b - cut)]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.string()))
    return pa.RecordBatch.from_arrays([key, pa.array(np.diff(at)), *hashes], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def sure_boundaries(chunk: bytes, last: bool) -> np.ndarray:
    """Boundaries that hold whatever follows the chunk: not the match that reaches its end, nor the one before.

    The pattern looks one character ahead, so a match is sure once another has
    started after it and that one is not cut off.
    """
    found = pre_tokens(np.frombuffer(chunk, np.uint8), np.array([0, len(chunk)]))
    return np.append(found, len(chunk)) if last else found[:-2]


def in_overlaps(bounds: np.ndarray, head: int, tail: int) -> np.ndarray:
    """The boundaries that stitching asks for: in the first ``head`` bytes and from byte ``tail`` on."""
    return bounds[(bounds <= head) | (bounds >= tail)]


def stitch(chunks: list[bytes], bounds: list[np.ndarray], steps: list[int]) -> list[bytes]:
    """Cut the text that overlapping chunks cover into pieces of whole pre-tokens.

    ``steps[k]`` is the length in bytes of chunk k without its overlap. A pre-token
    over many chunks is scanned again only when what is open has doubled, so the
    work is in proportion to the text.
    """
    pieces: list[bytes] = []
    carry, sure, base = bytearray(chunks[0]), np.asarray(bounds[0]), 0  # text from the last cut on, its boundaries, bytes of it before chunk k's start
    scanned = len(carry)
    for k in range(1, len(chunks)):
        base += steps[k - 1]
        common = np.intersect1d(sure[np.searchsorted(sure, base) :] - base, bounds[k])
        if len(common):
            cut = base + int(common[0])
            pieces.append(bytes(carry[:cut]))
            carry, sure, base = bytearray(chunks[k][common[0] :]), bounds[k][bounds[k] >= common[0]] - common[0], -int(common[0])
            scanned = len(carry)
        else:
            del carry[base:]
            carry += chunks[k]
            if len(carry) >= 2 * scanned:
                sure, scanned = sure_boundaries(bytes(carry), k == len(chunks) - 1), len(carry)
    return [*pieces, bytes(carry)]


def encode(docs: DataFrame, vocabulary: str, *, text: str = "text", doc_id: str = "doc_id", chunk: int = CHUNK, overlap: int = OVERLAP, digest: bool = False) -> DataFrame:
    """One row per document: ``doc_id``, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit) and the ``decoded`` bytes.

    With ``digest``, SHA-256 of the comma-joined decimal ids and of the decoded
    bytes stand in place of the two.
    """
    if not 0 < overlap < chunk:
        raise ValueError("the overlap must be shorter than a chunk")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for block in blocks(batches, "text", BLOCK):
            yield (_digest_rows if digest else _rows)(column(block, "doc_id"), own, *own.encode_texts(*text_bytes(column(block, "text"))))

    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["bounds"] = [
                in_overlaps(sure_boundaries(t.encode(), last), len(t[:overlap].encode()), len(t[:chunk].encode())).astype(np.int32) for t, last in zip(batch.text, batch["last"])
            ]
            yield batch

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("k")
        raw = [t.encode() for t in group.text]
        steps = [len(t[:chunk].encode()) for t in group.text]
        parts = stitch(raw, list(group.bounds), steps)
        return pd.DataFrame({"row": group["row"].iloc[0], "doc_id": group.doc_id.iloc[0], "k": range(len(parts)), "text": [p.decode() for p in parts]})

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for block in blocks(batches, "text", BLOCK):
            ids, at = own.encode_texts(*text_bytes(column(block, "text")))
            yield pa.RecordBatch.from_arrays([*(column(block, k) for k in ("row", "doc_id", "k")), _packed(ids.astype("<u4"), at * 4)], ["row", "doc_id", "k", "ids"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    long = F.coalesce(F.length("text"), F.lit(0)) > chunk + overlap
    short = rows.filter(~long).mapInArrow(whole, DIGESTS if digest else ENCODED)
    chunks = (
        rows.filter(long)
        .withColumn("row", F.monotonically_increasing_id())
        .select("row", "doc_id", "text", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1 - overlap) / chunk).cast("int"))).alias("k"))
        .select("row", "doc_id", "k", F.substring("text", F.col("k") * chunk + 1, F.lit(chunk + overlap)).alias("text"), (F.length("text") <= (F.col("k") + 1) * chunk + overlap).alias("last"))
        .repartition("row", "k")
        .mapInPandas(bound, "row long, doc_id long, k int, text string, last boolean, bounds array<int>")
    )
    pieces = chunks.groupBy("row").applyInPandas(joined, "row long, doc_id long, k int, text string").repartition("row", "k").mapInArrow(part, "row long, doc_id long, k int, ids binary")
    glued = pieces.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("p")).select("doc_id", _glue("ids"))
    return short.unionByName(digests(glued, vocabulary) if digest else decoded(glued, vocabulary))


def _glue(name: str):
    """The pieces' bytes, one after the other."""
    return F.unhex(F.array_join(F.transform(F.col(f"p.{name}"), F.hex), "")).alias(name)


def _of_ids(encoded: DataFrame, vocabulary: str, rows: Callable[..., pa.RecordBatch], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for block in blocks(batches, "ids", BLOCK):
            raw, at = text_bytes(column(block, "ids"))
            yield rows(column(block, "doc_id"), own, np.frombuffer(raw, "<u4").astype(np.int32), at // 4)

    return encoded.select("doc_id", "ids").mapInArrow(run, schema)


def digests(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and SHA-256 of the comma-joined decimal ids and of the decoded bytes."""
    return _of_ids(encoded, vocabulary, _digest_rows, DIGESTS)


def decoded(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` and the bytes that the ids stand for."""
    return _of_ids(encoded, vocabulary, _rows, ENCODED)
