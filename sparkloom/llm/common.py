"""Small helpers shared by the text operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a Python task expands into arrays at once.
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    Only a local session (tests) gets a folder of its own where none is set: on a
    cluster each executor would write to its own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_PLACES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def stored(df: DataFrame, *, keep: str = "t") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    It cuts the lineage so that an expensive step runs once, and a lost
    executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparkloom/{keep}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _PLACES[back] = path
    return back


def discard(*frames: DataFrame) -> None:
    """Delete tables that ``stored`` has written, once all that reads them has been stored itself."""
    for df in frames:
        path = _PLACES.pop(df, None)
        if path is not None:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    found = batch.column(name)
    return found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow array as one run of UTF-8 bytes, and their offsets in it. Null: empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most`` bytes of text each (a longer text makes a slice alone)."""
    for batch in batches:
        _, offsets = text_bytes(column(batch, text))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def runs(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of these lengths laid end to end: each element's group, and its place within it."""
    group = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.cumsum(lengths) - lengths
    return group, np.arange(len(group)) - starts[group]
