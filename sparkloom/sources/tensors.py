"""Named tensors in files of the public safetensors layout, as a Spark data source.

A file is the length of a JSON header (8 bytes, little-endian), the header (each
tensor's type, shape and byte range) and the tensors' bytes. A set of weights is a
folder of such files with an index that says which file holds which tensor.

Reading: the driver reads headers only, skips files that the index says hold
nothing of interest, and plans partitions of about ``split_bytes`` each: small
neighbours together, a large tensor in several pieces. A task reads its byte ranges
and nothing else. Names are pruned by the options ``names`` (a JSON list) and ``prefix``,
and by filters on ``name`` where the session pushes them to Python sources.

Writing commits in two phases. A task streams its tensors to a file in a temporary
folder of the job; the commit refuses names that come twice, moves the files of the
successful attempts in, and then replaces the index, so that a reader sees the old
set or the new one. Leftovers of failed and speculative attempts go with the
temporary folder. A row is a whole tensor, so memory holds one tensor at a time.

Defined results: a scalar has the empty shape and one value; a tensor may have no
values. Values are doubles; integers beyond 2**53, values that do not fit the type,
counts that differ from the shape, null names and damaged files are errors. An empty
table makes an empty set, which reads as no rows.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from .shared import opened

VALUES = "file string, name string, dtype string, shape array<bigint>, first bigint, values array<double>"
HEADERS = "file string, name string, dtype string, shape array<bigint>, bytes bigint"
INDEX = "model.safetensors.index.json"
#: Types of the layout and how numpy reads them; bf16 is the upper half of a 32-bit float.
KINDS = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "BF16": "<u2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "i1", "U64": "<u8", "U32": "<u4", "U16": "<u2", "U8": "u1", "BOOL": "?"}
SPLIT_BYTES = 64 << 20
#: Bytes copied, and bytes of values handed to Spark, at once.
CHUNK = 8 << 20


def decoded(raw: bytes, dtype: str) -> np.ndarray:
    """Values as doubles."""
    found = np.frombuffer(raw, KINDS[dtype])
    if dtype == "BF16":
        return (found.astype("<u4") << 16).view("<f4").astype(np.float64)
    if dtype in ("I64", "U64") and len(found) and max(abs(int(found.min())), abs(int(found.max()))) > 1 << 53:
        raise ValueError("integers beyond 2**53 are not doubles")
    return found.astype(np.float64)


def encoded(values: np.ndarray, dtype: str) -> bytes:
    """Bytes of doubles as a type: floats are rounded to the nearest even, anything else must fit."""
    if dtype not in KINDS:
        raise ValueError(f"no such type: {dtype}")
    if dtype == "BF16":
        bits = values.astype("<f4").view("<u4")
        rounded = (bits + 0x7FFF + ((bits >> 16) & 1)) >> 16
        return np.where(np.isnan(values), 0x7FC0, rounded).astype("<u2").tobytes()
    if dtype[0] == "F":
        with np.errstate(over="ignore"):
            return values.astype(KINDS[dtype]).tobytes()
    with np.errstate(invalid="ignore"):
        made = values.astype(KINDS[dtype])
    if not np.array_equal(made.astype(np.float64), values):
        raise ValueError(f"values do not fit {dtype}")
    return made.tobytes()


@dataclass(frozen=True)
class Tensor:
    name: str
    dtype: str
    shape: tuple[int, ...]
    begin: int  # of its bytes in the file
    end: int

    @property
    def width(self) -> int:
        return np.dtype(KINDS[self.dtype]).itemsize


def header(files: fs.FileSystem, path: str) -> list[Tensor]:
    """The tensors of a file in the order of their bytes; only the header is read."""

    def wrong(why: str) -> ValueError:
        return ValueError(f"{path}: {why}")

    size = files.get_file_info(path).size
    with files.open_input_file(path) as f:
        if size < 8:
            raise wrong("no header")
        (length,) = struct.unpack("<Q", f.read_at(8, 0))
        if length > size - 8:
            raise wrong("the header is longer than the file")
        try:
            found = json.loads(f.read_at(length, 8))
            entries = sorted((*e["data_offsets"], name, e["dtype"], tuple(e["shape"])) for name, e in found.items() if name != "__metadata__")
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            raise wrong(f"no header of tensors ({e})") from e
    out, at = [], 0
    for begin, end, name, dtype, shape in entries:
        if dtype not in KINDS:
            raise wrong(f"{name} has the unknown type {dtype}")
        if begin != at or end - begin != prod(shape) * np.dtype(KINDS[dtype]).itemsize:
            raise wrong(f"the bytes of {name} do not fit its shape or its neighbours")
        out.append(Tensor(name, dtype, shape, 8 + length + begin, 8 + length + end))
        at = end
    if 8 + length + at != size:
        raise wrong("bytes after the last tensor, or too few")
    return out


@dataclass
class Pieces(InputPartition):
    """Byte ranges of one file: each a tensor's name, type, shape, first value and range."""

    file: str
    pieces: list[tuple[str, str, tuple[int, ...], int, int, int]]


def planned(file: str, tensors: list[Tensor], split: int) -> Iterator[Pieces]:
    """Partitions of about ``split`` bytes: neighbours together, a longer tensor in pieces of whole values."""
    now: list[tuple] = []
    held = 0
    for t in tensors:
        step = max(1, split // t.width) * t.width
        for a in range(t.begin, max(t.end, t.begin + 1), step):
            b = min(a + step, t.end)
            if now and held + b - a > split:
                yield Pieces(file, now)
                now, held = [], 0
            now.append((t.name, t.dtype, t.shape, (a - t.begin) // t.width, a, b))
            held += b - a
    if now:
        yield Pieces(file, now)


class TensorReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.only_headers = options.get("headers", "false").lower() == "true"
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.names: set[str] | None = set(json.loads(options["names"])) if "names" in options else None
        self.prefixes = [options["prefix"]] if "prefix" in options else []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("name",):
                self._only({f.value})
            elif isinstance(f, In) and f.attribute == ("name",):
                self._only(set(f.value))
            elif isinstance(f, StringStartsWith) and f.attribute == ("name",):
                self.prefixes.append(f.value)
            else:
                yield f

    def _only(self, names: set[str]) -> None:
        self.names = names if self.names is None else self.names & names

    def _wanted(self, name: str) -> bool:
        return (self.names is None or name in self.names) and all(name.startswith(p) for p in self.prefixes)

    def _files(self) -> list[str]:
        files, root = opened(self.path)
        info = files.get_file_info(root)
        if info.type == fs.FileType.File:
            return [root]
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if files.get_file_info(f"{root}/{INDEX}").type == fs.FileType.File:
            with files.open_input_file(f"{root}/{INDEX}") as f:
                places = json.loads(f.read())["weight_map"]
            return sorted({f"{root}/{file}" for name, file in places.items() if self._wanted(name)})
        return sorted(x.path for x in files.get_file_info(fs.FileSelector(root)) if x.type == fs.FileType.File and x.path.endswith(".safetensors"))

    def partitions(self) -> list[InputPartition]:
        files, _ = opened(self.path)
        found = self._files()
        with ThreadPoolExecutor(16) as pool:
            headers = list(pool.map(lambda p: header(files, p), found))
        split = 1 << 60 if self.only_headers else self.split
        parts = [x for path, tensors in zip(found, headers) for x in planned(path, [t for t in tensors if self._wanted(t.name)], split)]
        return parts or [Pieces("", [])]  # Spark wants a partition

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        if not partition.pieces:
            return
        files, _ = opened(self.path)
        file = partition.file.rsplit("/", 1)[-1]
        if self.only_headers:
            rows = [(file, name, dtype, list(shape), b - a) for name, dtype, shape, _, a, b in partition.pieces]
            yield self._batch(rows, (pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64()), HEADERS)
            return
        with files.open_input_file(partition.file) as f:
            rows, held = [], 0
            for name, dtype, shape, first, a, b in partition.pieces:
                rows.append((file, name, dtype, list(shape), first, decoded(f.read_at(b - a, a), dtype)))
                held += b - a
                if held >= CHUNK:
                    yield self._batch(rows, (pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.float64())), VALUES)
                    rows, held = [], 0
            if rows:
                yield self._batch(rows, (pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.float64())), VALUES)

    @staticmethod
    def _batch(rows: list[tuple], kinds: tuple, schema: str) -> pa.RecordBatch:
        names = [c.split()[0] for c in schema.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


@dataclass
class Written(WriterCommitMessage):
    """A task's file in the temporary folder, its tensors' names and bytes."""

    file: str | None
    names: list[str]
    size: int


class TensorWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.job = uuid.uuid4().hex[:12]
        files, root = opened(self.path)
        if not overwrite and files.get_file_info(root).type == fs.FileType.Directory and any(x.path.endswith((".safetensors", INDEX)) for x in files.get_file_info(fs.FileSelector(root))):
            raise FileExistsError(f"{self.path} holds weights already; write with mode overwrite")
        # only here: a task that runs on after the job was given up finds no folder to write to
        files.create_dir(self._temporary(root), recursive=True)

    def _temporary(self, root: str) -> str:
        return f"{root}/_temporary-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = opened(self.path)
        own = f"{self._temporary(root)}/{uuid.uuid4().hex}"
        entries: dict[str, dict] = {}
        at = 0
        with files.open_output_stream(f"{own}.bytes") as out:
            for batch in iterator:
                for row in range(batch.num_rows):
                    name, dtype, shape = (batch.column(batch.schema.get_field_index(c))[row].as_py() for c in ("name", "dtype", "shape"))
                    values = batch.column(batch.schema.get_field_index("values"))[row].values
                    values = np.zeros(0) if values is None else values.to_numpy(zero_copy_only=False).astype(np.float64)
                    if name is None or name in entries or name == "__metadata__":
                        raise ValueError(f"a tensor needs a name of its own: {name}")
                    if prod(shape or []) != len(values):
                        raise ValueError(f"{name} has {len(values)} values and the shape {shape}")
                    raw = encoded(values, dtype)
                    out.write(raw)
                    entries[name] = {"dtype": dtype, "shape": shape or [], "data_offsets": [at, at + len(raw)]}
                    at += len(raw)
        if entries:
            head = json.dumps({"__metadata__": {"format": "pt"}} | entries).encode()
            head += b" " * (-len(head) % 8)
            with files.open_output_stream(f"{own}.safetensors") as out, files.open_input_file(f"{own}.bytes") as data:
                out.write(struct.pack("<Q", len(head)) + head)
                while chunk := data.read(CHUNK):
                    out.write(chunk)
        files.delete_file(f"{own}.bytes")
        return Written(f"{own}.safetensors" if entries else None, list(entries), at)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = opened(self.path)
        made = sorted((m for m in messages if m and m.file), key=lambda m: min(m.names))
        names = [n for m in made for n in m.names]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two tasks have written a tensor of one name")
        old = [x.path for x in files.get_file_info(fs.FileSelector(root)) if x.path.endswith(".safetensors")]
        places = {}
        for k, m in enumerate(made):
            file = f"model-{self.job}-{k + 1:05d}-of-{len(made):05d}.safetensors"
            files.move(m.file, f"{root}/{file}")
            places |= dict.fromkeys(m.names, file)
        index = {"metadata": {"total_size": sum(m.size for m in made)}, "weight_map": dict(sorted(places.items()))}
        with files.open_output_stream(f"{self._temporary(root)}/{INDEX}") as f:
            f.write(json.dumps(index, indent=1).encode())
        files.move(f"{self._temporary(root)}/{INDEX}", f"{root}/{INDEX}")  # from here on the new set is the one that readers see
        for path in old:
            files.delete_file(path)
        files.delete_dir(self._temporary(root))

    def abort(self, messages: list[Written | None]) -> None:
        files, root = opened(self.path)
        if files.get_file_info(self._temporary(root)).type == fs.FileType.Directory:
            files.delete_dir(self._temporary(root))


class Tensors(DataSource):
    """``spark.read.format("tensors").load(path)``; rows of ``file, name, dtype, shape, first, values``, or of headers with the option ``headers``.

    A tensor's pieces have ``first``, the place of their first value. Writing takes
    the columns ``name``, ``dtype``, ``shape`` and ``values``; others are ignored.
    """

    @classmethod
    def name(cls) -> str:
        return "tensors"

    def schema(self) -> str:
        return HEADERS if self.options.get("headers", "false").lower() == "true" else VALUES

    def reader(self, schema: StructType) -> TensorReader:
        return TensorReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> TensorWriter:
        lacking = {"name", "dtype", "shape", "values"} - set(schema.names)
        if lacking:
            raise ValueError(f"tensors need the columns {', '.join(sorted(lacking))}")
        return TensorWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let it push filters on ``name`` to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Tensors)
