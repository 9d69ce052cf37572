"""Checks over train, validation and test splits: ranges of cases, shared and repeated ids, order, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.curate import KEY

#: First and last case of each split (fixed values).
CASES = {"train": (0, 139), "val": (140, 146), "test": (147, 154)}


def by_case(rows: DataFrame, case: Column, first_test: int) -> dict[str, DataFrame]:
    """Held-out rows as ``val`` (cases below ``first_test``) and ``test``; an empty one is an error. Rows without a case are in neither."""
    if first_test <= 0:
        raise ValueError("the first test case must be positive")
    out = {"val": rows.filter(case < first_test), "test": rows.filter(case >= first_test)}
    for name, part in out.items():
        if part.isEmpty():
            raise ValueError(f"split {name} is empty")
    return out


def outside_cases(split: Column, case: Column, ranges: dict[str, tuple[int, int]] = CASES) -> Column:
    """Whether a row's case lies outside its split's range (also: no case, unknown split)."""
    inside = F.lit(False)
    for name, (first, last) in ranges.items():
        inside = inside | ((split == name) & case.between(first, last))
    return ~F.coalesce(inside, F.lit(False))


def shared_ids(rows: DataFrame, split: str, identifier: str) -> DataFrame:
    """``left``, ``right``, ``ids``: how many ids two splits share, of pairs that share any.

    An id is grouped with the splits that have it (a few names), so a split never
    meets another row by row.
    """
    held = rows.groupBy(identifier).agg(F.array_sort(F.collect_set(split)).alias("s")).filter(F.size("s") > 1)
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("left"), b.alias("right")))))
    return held.select(F.explode(pairs).alias("p")).groupBy("p.left", "p.right").agg(F.count("*").alias("ids"))


def id_counts(rows: DataFrame, identifier: str) -> DataFrame:
    """One row: ``rows``, ``ids`` (different), ``unique``."""
    each = rows.groupBy(identifier).agg(F.count("*").alias("n"))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("ids")).withColumn("unique", F.col("rows") == F.col("ids"))


def concatenated(parts: list[DataFrame], place: str) -> DataFrame:
    """The parts one after the other: ``place`` (from 1 in each part) goes on from the end of the part before."""
    out, before = None, 0
    for k, part in enumerate(parts):
        moved = part.withColumn(place, F.col(place) + before)
        out = moved if out is None else out.unionByName(moved)
        before += part.count() if k + 1 < len(parts) else 0
    return out


def misplaced(expected: DataFrame, whole: DataFrame, place: str, identifier: str) -> DataFrame:
    """Places at which two numbered tables differ: ``place``, ``expected``, ``found`` (null: none there)."""
    a = expected.select(place, F.col(identifier).alias("expected"))
    b = whole.select(place, F.col(identifier).alias("found"))
    return a.join(b, place, "full").filter(~F.col("expected").eqNullSafe(F.col("found")))


def with_segment(rows: DataFrame, segments: DataFrame, values: list[str], order: str, keys: list[str] = KEY) -> DataFrame:
    """Rows with their segment's values (of several, the last by ``order``) and ``found``."""
    last = segments.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("_s")).select(*keys, *(f"_s.{v}" for v in values), F.lit(True).alias("found"))
    return rows.join(last, keys, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def require_segments(rows: DataFrame, segments: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """``rows``, of which none may be without a segment (an error when they are read)."""
    known = segments.select(*keys).distinct().withColumn("_known", F.lit(True))
    missing = F.concat(F.lit("no segment for "), F.concat_ws(" ", *(F.col(k).cast("string") for k in keys)))
    ok = F.when(F.col("_known").isNull(), F.raise_error(missing)).otherwise(F.col("_known"))
    return rows.join(known, keys, "left").filter(ok).drop("_known")


def summary(rows: DataFrame, split: str, case: str, kind: str) -> DataFrame:
    """For each split: ``examples``, its ``cases`` in order, and ``types`` (type to count)."""
    each = rows.groupBy(split, F.coalesce(F.col(kind), F.lit("missing")).alias("_k")).agg(F.count("*").alias("n"), F.collect_set(case).alias("c"))  # cases, not rows
    return each.groupBy(split).agg(
        F.sum("n").alias("examples"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("c")))).alias("cases"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "n")))).alias("types"),
    )
