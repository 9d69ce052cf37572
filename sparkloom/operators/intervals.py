"""Sliding windows over time lines, and their joins with labelled intervals.

Times are any numeric column (seconds as double, or microseconds as long).
Intervals are half-open. Joins are equi joins on the timeline's keys with the
overlap as a residual, so they are hash or merge joins that AQE can split;
``bucket`` deals a long time line out in time as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.vocab import MIN_OVERLAP, OUTSIDE_TASK


def sliding_windows(parts: DataFrame, size: float, step: float, duration: str = "duration") -> DataFrame:
    """One row for each full window of a part (``t_start``, ``t_end``); a shorter part is one window, an empty one none."""
    if step <= 0 or size <= 0:
        raise ValueError("size and step must be positive")
    d = F.col(duration)
    last = F.greatest(F.floor((d - size) / step), F.lit(0)).cast("long")
    starts = F.when(d >= size, F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: i * F.lit(step))).when(d > 0, F.array(F.lit(step) * 0))
    return parts.withColumn("t_start", F.explode(starts)).withColumn("t_end", F.when(d >= size, F.col("t_start") + size).otherwise(d))


def local_interval(part: Column, duration: Column, start_part: Column, start: Column, stop_part: Column, stop: Column) -> tuple[Column, Column]:
    """The stretch of a cross-part interval in one part, clamped to it; null where it is not in the part or empty."""
    inside = (start_part <= part) & (part <= stop_part)
    first, last = F.when(part == start_part, start).otherwise(duration * 0), F.when(part == stop_part, stop).otherwise(duration)
    clamped = lambda x: F.when(x.isNotNull(), F.least(F.greatest(x, duration * 0), duration))
    begin, end = clamped(first), clamped(last)
    ok = inside & (end > begin)
    return F.when(ok, begin), F.when(ok, end)


def repaired(begin: Column, end: Column, duration: Column) -> Column:
    """End of an installation: a zero end runs to the part's end, another end before the begin rejects it (null)."""
    return F.when(end > begin, end).when((end == 0) & (duration > begin), duration)


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.least(a1, b1) - F.greatest(a0, b0)


def overlap_join(windows: DataFrame, intervals: DataFrame, keys: list[str], *, start: str = "i_start", end: str = "i_end", bucket: float | None = None) -> DataFrame:
    """Every window with every interval of its keys that it overlaps, and ``overlap``.

    With ``bucket``, both sides are also dealt to the stretches of time that they
    touch; a pair is kept only where its overlap begins, so it comes once.
    """
    hit = (F.col("t_start") < F.col(end)) & (F.col(start) < F.col("t_end"))
    size = overlap(F.col("t_start"), F.col("t_end"), F.col(start), F.col(end))
    if bucket is None:
        return windows.join(intervals, keys).filter(hit).withColumn("overlap", size)
    cell = lambda x: F.floor(x / bucket)
    left = windows.withColumn("_cell", F.explode(F.sequence(cell(F.col("t_start")), cell(F.col("t_end")))))
    right = intervals.filter(F.col(end) > F.col(start)).withColumn("_cell", F.explode(F.sequence(cell(F.col(start)), cell(F.col(end)))))
    met = left.join(right, [*keys, "_cell"]).filter(hit & (F.col("_cell") == cell(F.greatest("t_start", start))))
    return met.drop("_cell").withColumn("overlap", size)


def majority_label(windows: DataFrame, intervals: DataFrame, keys: list[str], label: str, order: str, *, least: float = MIN_OVERLAP, default: str = OUTSIDE_TASK, start: str = "i_start", end: str = "i_end", bucket: float | None = None) -> DataFrame:
    """Windows with the label of the interval that overlaps most (ties: the first by ``order``) if it covers the share ``least``, else ``default``."""
    own = [*keys, "t_start", "t_end"]
    met = overlap_join(windows.select(*own), intervals, keys, start=start, end=end, bucket=bucket)
    best = met.groupBy(*own).agg(F.max_by(F.struct(label, "overlap"), F.struct(F.col("overlap"), -F.col(order))).alias("_best"))
    out = windows.join(best, own, "left")
    enough = F.col("_best.overlap") >= least * (F.col("t_end") - F.col("t_start"))
    return out.withColumn(label, F.when(enough, F.coalesce(F.nullif(F.trim(F.col(f"_best.{label}")), F.lit("")), F.lit(default))).otherwise(default)).withColumn("best_overlap", F.coalesce(F.col("_best.overlap"), F.lit(0) * F.col("t_end"))).drop("_best")


def active_sets(windows: DataFrame, intervals: DataFrame, keys: list[str], values: dict[str, str], *, start: str = "i_start", end: str = "i_end", bucket: float | None = None) -> DataFrame:
    """Windows with the sorted sets of ``values`` (result name to column) that are active in them."""
    own = [*keys, "t_start", "t_end"]
    met = overlap_join(windows.select(*own), intervals, keys, start=start, end=end, bucket=bucket)
    sets = met.groupBy(*own).agg(*(F.array_sort(F.collect_set(c)).alias(n) for n, c in values.items()))
    out = windows.join(sets, own, "left")
    return out.withColumns({n: F.coalesce(F.col(n), F.array().cast("array<string>")) for n in values})


def enrich_first(rows: DataFrame, lookup: DataFrame, keys: list[str], value: str, order: str, default: str = "") -> DataFrame:
    """Left join on keys in which null meets null; of equal lookup keys the first by ``order`` with a usable value wins."""
    usable = lookup.filter(F.coalesce(F.trim(F.lower(value)), F.lit("")).isin("", "nan") == F.lit(False))
    first = usable.groupBy(*keys).agg(F.min_by(value, order).alias("_value"))
    right = first.select(*(F.col(k).alias(f"_{k}") for k in keys), "_value")
    condition = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"_{k}"))
        condition = one if condition is None else condition & one
    return rows.join(right, condition, "left").withColumn(value, F.coalesce("_value", F.lit(default))).drop("_value", *(f"_{k}" for k in keys))


def timeline(events: DataFrame, key: str, time: str, order: str, label: str) -> DataFrame:
    """Consecutive events of a key as labelled intervals up to the next event (the last has none)."""
    w = Window.partitionBy(key).orderBy(time, order)
    return events.select(key, F.col(time).alias("i_start"), F.lead(time).over(w).alias("i_end"), F.col(label).alias(label), F.col(order).alias("ord")).filter("i_end > i_start")
