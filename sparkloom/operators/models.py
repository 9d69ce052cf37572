"""Seams for models: rows go through a function that is loaded once for each Python worker.

No model is part of the library; a job hands in ``load``, which returns a function
from a pandas frame to the new columns. Rows come in Arrow batches; ``group`` keeps
the rows of one key (such as a video) together and in order, so that a source is
opened once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

Scorer = Callable[[pd.DataFrame], pd.DataFrame]


@lru_cache(4)
def _loaded(load: Callable[[], Scorer]) -> Scorer:
    """One scorer for each worker and loader."""
    return load()


def scored(rows: DataFrame, load: Callable[[], Scorer], columns: list[str], added: str, *, group: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """``rows`` with the columns ``added`` (a DDL list) that the scorer makes of ``columns``.

    The scorer returns as many rows as it gets, in their order. Only ``columns`` go
    to Python. An empty table loads nothing and gives no rows.
    """
    new = _parse_datatype_string(added)
    clash = set(new.names) & set(rows.columns)
    if clash:
        raise ValueError(f"columns are there already: {', '.join(sorted(clash))}")

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            frame = pd.concat(batch, axis=1, keys=columns) if isinstance(batch, tuple) else batch.to_frame(columns[0])
            made = _loaded(load)(frame)
            if len(made) != len(frame):
                raise ValueError("the scorer must return one row for each of its rows")
            yield made[new.names]

    score = F.pandas_udf(run, new).asNondeterministic()  # one call for each row, however its result is used
    dealt = rows.repartition(*group).sortWithinPartitions(*group, *(order or [])) if group else rows
    return dealt.withColumn("_scored", score(*columns)).select(*rows.columns, "_scored.*")


def config(given: Column, defaults: dict[str, object]) -> Column:
    """A struct of parameters from a JSON text, each with its default where the text has none."""
    kinds = {bool: "boolean", int: "bigint", float: "double", str: "string"}
    read = F.from_json(given, ", ".join(f"{k} {kinds[type(v)]}" for k, v in defaults.items()))
    return F.struct(*(F.coalesce(read[k], F.lit(v)).alias(k) for k, v in defaults.items()))


def key_check(expected: Column, found: Column) -> Column:
    """Keys that a stored set of weights lacks (``missing``) or has besides (``unexpected``), both sorted, and ``ok``."""
    missing, unexpected = F.array_sort(F.array_except(expected, found)), F.array_sort(F.array_except(found, expected))
    return F.struct(missing.alias("missing"), unexpected.alias("unexpected"), ((F.size(missing) == 0) & (F.size(unexpected) == 0)).alias("ok"))


def clean_keys(weights: Column, wrappers: tuple[str, ...] = ("module.", "backbone.")) -> Column:
    """A map's keys without the names of wrappers; keys that become equal are an error."""

    def bare(key: Column) -> Column:
        for w in wrappers:
            key = F.replace(key, F.lit(w), F.lit(""))
        return key

    return F.transform_keys(weights, lambda k, _: bare(k))


def positions_after(base: Column, count: Column) -> Column:
    """``count`` positions that go on after the largest of ``base``."""
    top = F.array_max(base)
    return F.when(count > 0, F.sequence(top + 1, top + count)).otherwise(F.array().cast("array<long>"))


def in_read_order(requests: DataFrame, source: str, index: str) -> DataFrame:
    """Requests dealt by their source, each source's in ascending order, so that it is read once and forwards."""
    return requests.repartition(source).sortWithinPartitions(source, index)


def key_states(expected: DataFrame, found: DataFrame, name: str = "name", shape: str = "shape", optional: tuple[str, ...] = ()) -> DataFrame:
    """Every key of either side with ``state``: ``ok``, ``missing``, ``unexpected``, ``shape`` (of another shape), or ``optional`` if it may be missing.

    A join, so that weights of any number of tensors are checked where they are.
    """
    one = expected.select(F.col(name).alias("name"), F.struct(shape).alias("_e"))
    two = found.select(F.col(name).alias("name"), F.struct(shape).alias("_f"))
    absent = F.when(F.col("name").isin(*optional), "optional").otherwise("missing") if optional else F.lit("missing")
    state = F.when(F.col("_f").isNull(), absent).when(F.col("_e").isNull(), "unexpected").when(F.col("_e") == F.col("_f"), "ok").otherwise("shape")
    return one.join(two, "name", "full").select("name", state.alias("state"))


def demand_keys(states: DataFrame) -> DataFrame:
    """The states, if all are ``ok`` or ``optional``; otherwise an error that names a key and its state."""
    fine = F.col("state").isin("ok", "optional")
    return states.filter(F.when(fine, F.lit(True)).otherwise(F.raise_error(F.concat("state", F.lit(": "), "name")).cast("boolean")))


def delta(trained: DataFrame, base: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """The tensors of ``trained`` whose values or shape differ from ``base`` or that it lacks, and those named in ``keys`` (earlier deltas)."""
    was = base.select("name", F.col("shape").alias("_s"), F.col("values").alias("_v"))
    joined = trained.join(was, "name", "left")
    changed = F.col("_v").isNull() | (F.col("shape") != F.col("_s")) | (F.col("values") != F.col("_v"))
    if keys is not None:
        joined = joined.join(keys.select("name").distinct().withColumn("_k", F.lit(True)), "name", "left")
        changed = changed | F.col("_k").isNotNull()
    return joined.filter(changed).select(*trained.columns)


def with_delta(base: DataFrame, changes: DataFrame) -> DataFrame:
    """``base`` with the tensors of ``changes`` in place of its own; a key that the base lacks is an error."""
    new = changes.select("name", F.struct("dtype", "shape", "values").alias("_n"), F.lit(True).alias("_d"))
    both = base.withColumn("_b", F.lit(True)).join(new, "name", "full")
    known = F.when(F.col("_b").isNotNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unexpected: "), "name")).cast("boolean"))
    own = [F.when(F.col("_d").isNotNull(), F.col(f"_n.{c}")).otherwise(F.col(c)).alias(c) if c in ("dtype", "shape", "values") else F.col(c) for c in base.columns]
    return both.filter(known).select(*own)


def whole_tensors(pieces: DataFrame) -> DataFrame:
    """Tensors of one row each from their pieces, in the order of ``first``."""
    parts = pieces.groupBy("name").agg(F.first("dtype").alias("dtype"), F.first("shape").alias("shape"), F.sort_array(F.collect_list(F.struct("first", "values"))).alias("p"))  # of one tensor
    return parts.select("name", "dtype", "shape", F.flatten(F.col("p.values")).alias("values"))
