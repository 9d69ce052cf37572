"""Metadata of video files from their boxes (public ISO base media file format).

Only the headers of boxes are read, and the few small boxes that hold the track's
type, time scale and sample times; the media data are skipped, wherever they
stand. Files are dealt to tasks by name, so one task opens a bounded share of them.

Defined results: ``total_frames`` and ``fps`` are those of the first video track;
the rate is frames by the sum of sample times. A file that can't be read (cut off, no
track, a box that reaches beyond its parent, ...) is a row with a ``reason`` and no
figures, so that a job can report and skip it. A track without sample times has the
rate 0, and so the duration 0. A file of no bytes gives no row: Spark's readers skip it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import opened

METADATA = "video_path string, total_frames bigint, fps double, reason string"
#: Entries of the time-to-sample box that are read at once.
ENTRIES = 1 << 16


class Unreadable(ValueError):
    """The file is no container that gives a video track's figures."""


def _boxes(f, begin: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Type, first byte of the content and end of each box between two places."""
    at = begin
    while at < end:
        head = f.read_at(min(16, end - at), at)
        if len(head) < 8:
            raise Unreadable("a box is cut off")
        size, kind = struct.unpack(">I4s", head[:8])
        content = at + 8
        if size == 1:
            if len(head) < 16:
                raise Unreadable("a box is cut off")
            (size,) = struct.unpack(">Q", head[8:])
            content = at + 16
        elif size == 0:  # to the end
            size = end - at
        if size < content - at or at + size > end:
            raise Unreadable(f"the box {kind.decode('latin-1')} reaches beyond its parent")
        yield kind, content, at + size
        at += size


def _only(f, begin: int, end: int, *path: bytes) -> tuple[int, int] | None:
    """The content of the first box at a path of types."""
    for kind, a, b in _boxes(f, begin, end):
        if kind == path[0]:
            return (a, b) if len(path) == 1 else _only(f, a, b, *path[1:])
    return None


def _number(f, at: int, end: int, code: str = ">I") -> int:
    raw = f.read_at(struct.calcsize(code), at)
    if at + struct.calcsize(code) > end or len(raw) < struct.calcsize(code):
        raise Unreadable("a box is too short")
    return struct.unpack(code, raw)[0]


def video_figures(f, size: int) -> tuple[int, float]:
    """Frames and rate of the first video track of an opened file."""
    movie = _only(f, 0, size, b"moov")
    if movie is None:
        raise Unreadable("no movie box")
    for kind, a, b in _boxes(f, *movie):
        if kind != b"trak":
            continue
        handler = _only(f, a, b, b"mdia", b"hdlr")
        if handler is None or f.read_at(4, handler[0] + 8) != b"vide":
            continue
        header, times = _only(f, a, b, b"mdia", b"mdhd"), _only(f, a, b, b"mdia", b"minf", b"stbl", b"stts")
        if header is None or times is None:
            raise Unreadable("the video track has no times")
        version = _number(f, header[0], header[1], ">B")
        scale = _number(f, header[0] + (20 if version else 12), header[1])
        count = _number(f, times[0] + 4, times[1])
        if times[0] + 8 + 8 * count > times[1]:
            raise Unreadable("the sample times are cut off")
        frames = ticks = 0
        for k in range(0, count, ENTRIES):
            n = min(ENTRIES, count - k)
            entries = struct.unpack(f">{2 * n}I", f.read_at(8 * n, times[0] + 8 + 8 * k))
            frames += sum(entries[::2])
            ticks += sum(c * d for c, d in zip(entries[::2], entries[1::2]))
        return frames, frames * scale / ticks if ticks else 0.0
    raise Unreadable("no video track")


def video_metadata(spark: SparkSession, root: str, pattern: str = "*.mp4") -> DataFrame:
    """``video_path, total_frames, fps, reason`` of every file below ``root``; contents aren't loaded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                files, own = opened(path)
                try:
                    with files.open_input_file(own) as f:
                        out.append((path, *video_figures(f, size), None))
                except (Unreadable, OSError, struct.error, RecursionError) as e:
                    out.append((path, None, None, str(e)))
            kinds = (pa.string(), pa.int64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["video_path", "total_frames", "fps", "reason"])

    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "length")
    return found.repartition("path").mapInArrow(run, METADATA)


def box(kind: bytes, *content: bytes, wide: bool = False) -> bytes:
    """A box of the format, with a 64-bit size if ``wide``."""
    body = b"".join(content)
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body if wide else struct.pack(">I4s", len(body) + 8, kind) + body


def video_file(times: list[tuple[int, int]], scale: int, media: bytes = b"", late: bool = True) -> bytes:
    """A minimal file with one sound and one video track: runs of (frames, ticks a frame), ticks a second, and media data before the movie box if ``late``."""
    ticks = sum(c * d for c, d in times)

    def track(handler: bytes, entries: list[tuple[int, int]]) -> bytes:
        header = box(b"mdhd", struct.pack(">IIIIIHH", 0, 0, 0, scale, min(ticks, 0xFFFFFFFF), 0, 0))
        kind = box(b"hdlr", struct.pack(">II4s12s", 0, 0, handler, b""), b"\0")
        samples = box(b"stts", struct.pack(">II", 0, len(entries)), *(struct.pack(">II", *e) for e in entries))
        return box(b"trak", box(b"mdia", header, kind, box(b"minf", box(b"stbl", samples))))

    movie = box(b"moov", box(b"mvhd", struct.pack(">IIIII", 0, 0, 0, scale, 0)), track(b"soun", [(7, 1024)]), track(b"vide", times))
    data = box(b"mdat", media, wide=True)
    return box(b"ftyp", b"isom\0\0\2\0isom") + (data + movie if late else movie + data)
