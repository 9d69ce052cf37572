"""Full windows of every part, from the part's own start, over a stream of its events (an extension; the batch form is ``sliding_windows``).

State for each part is its first and last time and how many windows have gone out. The
start of a part is certain once the watermark has passed it, since earlier events
would be late; from then on a window goes out as soon as an event lies at or beyond
its end. A timer wakes a part whose start became certain without further events. A
part shorter than a window has none here: that it has ended cannot be known from a
stream.

The sink writes each batch to a folder of its own, anew if a batch is replayed, so a
restart neither loses nor doubles windows.

Defined results: an event later than the watermark is dropped before it gets here and
changes nothing; rows without key or time are ignored. Times are microseconds.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

STATE = "first long, last long, sent long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class PartWindows(StatefulProcessor):
    """One part's windows of ``size``, one every ``step`` microseconds."""

    def __init__(self, size: int, step: int):
        if size <= 0 or step <= 0:
            raise ValueError("size and step must be positive")
        self.size, self.step = size, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("part", STATE)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        known = self.state.get() if self.state.exists() else None
        first, last, sent = known or (None, None, 0)
        before = first
        for row in rows:  # a part's rows are read as a stream
            # the start of a part that has sent windows is certain
            first = row.us if first is None or (row.us < first and not sent) else first
            last = row.us if last is None or row.us > last else last
        if first != before:
            if before is not None:
                self.handle.deleteTimer(self._timer(before))
            self.handle.registerTimer(self._timer(first))
        yield from self._due(key, first, last, sent, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        first, last, sent = self.state.get()
        yield from self._due(key, first, last, sent, timerValues.getCurrentWatermarkInMs())

    @staticmethod
    def _timer(us: int) -> int:
        """The first millisecond that is certainly after a time."""
        return us // 1000 + 1

    def _due(self, key: Any, first: int, last: int, sent: int, watermark: int) -> Iterator[Row]:
        full = max(0, (last - first - self.size) // self.step + 1) if last - first >= self.size else 0
        due = full if watermark >= self._timer(first) else sent
        self.state.update((first, last, max(due, sent)))
        for k in range(sent, due):
            yield Row(key=key[0], t_start=k * self.step, t_end=k * self.step + self.size)

    def close(self) -> None:
        pass


def full_windows(events: DataFrame, key: str, time: str, size: int, step: int, late: str = "1 hour") -> DataFrame:
    """``key, t_start, t_end``: the windows of each part, in microseconds from its first event. Needs the RocksDB state store."""
    rows = events.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).alias("key"), F.col(time).cast("timestamp").alias("at"), F.unix_micros(F.col(time).cast("timestamp")).alias("us"))
    kind = events.schema[key].dataType.simpleString()
    return rows.withWatermark("at", late).groupBy("key").transformWithState(PartWindows(size, step), f"key {kind}, t_start long, t_end long", "Append", "EventTime")


def write_replay_safe(stream: DataFrame, path: str, checkpoint: str):
    """Start a query over what is there now; each batch is a folder below ``path``, written anew if the batch comes again."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows that the sink has written."""
    return spark.read.schema(schema + ", batch long").parquet(path).drop("batch")
