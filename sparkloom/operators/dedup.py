"""First-wins dedup, repair of ids, and balancing of answers. ``ord`` columns carry the order that lists would have."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.operators.epochs import placed
from sparkloom.operators.sampling import draw
from sparkloom.sources.shared import dealt, kept


def _place(order: str) -> Column:
    """A value to take the first row by: a row without an order comes first."""
    return F.struct(F.col(order))


def _named(keys: list[Column | str]) -> list[Column]:
    return [(F.col(k) if isinstance(k, str) else k).alias(f"_k{i}") for i, k in enumerate(keys)]


def first_of(rows: DataFrame, keys: list[Column | str], order: str) -> DataFrame:
    """The first row of each key by ``order``, which differs between a key's rows. No key's rows are gathered."""
    first = rows.groupBy(*_named(keys)).agg(F.min_by(F.struct(*rows.columns), _place(order)).alias("_r"))
    return first.select("_r.*")


def first_signature(rows: DataFrame, keys: list[Column | str], order: str, signature: Column) -> DataFrame:
    """Every row with ``first_in_key`` and ``conflict``: its signature differs from that of the key's first row.

    ``order`` differs between a key's rows. The first rows are aggregated and kept
    apart, so that the join can split a key with very many rows.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    marked = rows.withColumn("_s", signature).select("*", *_named(keys))
    first = kept(marked.groupBy(*names).agg(F.min_by(F.struct(F.col(order).alias("o"), F.col("_s").alias("s")), _place(order)).alias("_f")), "firsts")
    first = first.select(*(F.col(n).alias(f"{n}_") for n in names), "_f")
    same = reduce(lambda a, b: a & b, (F.col(n).eqNullSafe(F.col(f"{n}_")) for n in names))
    met = marked.join(first, same)
    return met.select(*rows.columns, F.col(order).eqNullSafe(F.col("_f.o")).alias("first_in_key"), (F.col("_s") != F.col("_f.s")).alias("conflict"))


def dedup_or_fail(rows: DataFrame, keys: list[Column | str], order: str, signature: Column) -> DataFrame:
    """The first row of each key; rows of one key whose signatures differ from the first one's are an error. Null signatures differ from nothing."""
    marked = rows.withColumn("_s", signature)
    first = marked.groupBy(*_named(keys)).agg(F.min_by(F.struct(*marked.columns), _place(order)).alias("_r"), F.min("_s").alias("_a"), F.max("_s").alias("_b"))
    conflict = F.coalesce((F.col("_a") != F.col("_r._s")) | (F.col("_b") != F.col("_r._s")), F.lit(False))
    ok = F.when(conflict, F.raise_error(F.lit("conflicting supervision for one key")).cast("boolean")).otherwise(F.lit(True))
    return first.filter(ok).select("_r.*").select(*rows.columns)


def numbered(rows: DataFrame, order: str, name: str, cells: int | None = None, within: str | None = None) -> DataFrame:
    """Rows with a gapless number from 1 in the order of the column ``order``, whose values should differ; with ``within`` in each of its values.

    Rows are sorted in ranges (``cells`` of them, or as many as the session shuffles
    into) and written once; what lies before a range is a sum over that many counts.
    """
    there = placed(rows, [within, order] if within else [order], name, within, cells)
    return there.withColumn(name, F.col(name) + 1)


def unique_ids(rows: DataFrame, identifier: str, order: str, start: int = 1000) -> DataFrame:
    """Ids made unique: the second and later rows of an id get a running number, in order, from ``start``.

    Only the repeated rows are numbered. Ids must not end in numbers from
    ``start`` on themselves.
    """
    marked = first_signature(rows, [identifier], order, F.lit(0)).withColumn("_dup", ~F.col("first_in_key")).drop("first_in_key", "conflict")
    again = numbered(marked.filter("_dup"), order, "_number")
    base = F.regexp_replace(F.col(identifier), r"_\d+$", "")
    fresh = again.withColumn(identifier, F.concat(base, F.lit("_"), (F.col("_number") + (start - 1)).cast("string")))
    return marked.filter("NOT _dup").select(*rows.columns).unionByName(fresh.select(*rows.columns))


def answer_needs(rows: DataFrame, key: str, is_yes: Column, *, target: float = 0.5, tolerance: float = 0.1, cap: int | None = 600) -> DataFrame:
    """For each key: counts of yes and no, and how many rows (at most ``cap``, if there is one) of which answer would bring it to the target."""
    counts = rows.groupBy(key).agg(F.count_if(is_yes).alias("yes"), F.count_if(~is_yes).alias("no"))
    total, ratio = F.col("yes") + F.col("no"), F.col("yes") / (F.col("yes") + F.col("no"))
    whole = lambda side, share: F.floor(F.col(side) / share) - total
    missing = whole if cap is None else lambda side, share: F.least(whole(side, share), F.lit(cap))
    need = F.when(ratio > target + tolerance, missing("yes", target)).when(ratio < target - tolerance, missing("no", 1 - target)).otherwise(0)
    return counts.withColumn("need", F.greatest(need, F.lit(0)).cast("long")).withColumn("wanted", F.when(ratio > target + tolerance, "no").when(ratio < target - tolerance, "yes"))


def top_up(needs: DataFrame, pool: DataFrame, key: str, is_yes: str, identifier: str, seed: str, cap: int | None = 600, few_keys: bool = False) -> DataFrame:
    """Rows of the pool, drawn for each key that needs rows (at most ``cap``, if there is one) of the other answer.

    ``few_keys``: keys are a fixed vocabulary, so the needs go to every task and the pool,
    whose size Spark can't tell behind an explode, to none. Without a cap the rows of smallest
    draws are found by counts of their first digits, and no key's rows are sorted whole.
    """
    wanting = needs.filter("need > 0").select(key, "need", "wanted")
    sent = F.broadcast if few_keys else lambda rows: rows
    fit = pool.join(sent(wanting), key).filter(F.when(F.col(is_yes), "yes").otherwise("no") == F.col("wanted"))
    if cap is None:
        return _smallest(fit, key, identifier, seed, sent).select(*pool.columns)
    w = Window.partitionBy(key).orderBy(draw(F.col(identifier), seed), identifier)
    ranked = fit.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= cap)  # a literal bound limits each task's groups
    return ranked.filter(F.col("_r") <= F.col("need")).drop("_r", "need", "wanted")


def _smallest(rows: DataFrame, key: str, identifier: str, seed: str, sent: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """For each key its ``need`` rows of smallest draws (null identifiers last); all, if it has no more. Only the stretch of draws with the last one is ranked."""
    drawn = rows.withColumn("_d", draw(F.col(identifier), seed)).withColumn("_s", F.coalesce(F.conv(F.substring("_d", 1, 4), 16, 10).cast("int"), F.lit(1 << 16)))
    cells = drawn.groupBy(key, "need", "_s").agg(F.count("*").alias("_m"))  # at most 65,537 a key
    until = cells.withColumn("_until", F.sum("_m").over(Window.partitionBy(key).orderBy("_s")))
    met = until.filter((F.col("_until") - F.col("_m") < F.col("need")) & (F.col("need") <= F.col("_until")))
    last = kept(met.select(key, F.col("_s").alias("_last"), (F.col("need") - F.col("_until") + F.col("_m")).alias("_left")), "last")
    dealt_ = drawn.join(sent(last), key, "left")
    sure = dealt_.filter(F.col("_last").isNull() | (F.col("_s") < F.col("_last")))
    edge = dealt_.filter(F.col("_s") == F.col("_last"))
    w = Window.partitionBy(key).orderBy(F.asc_nulls_last("_d"), F.asc_nulls_last(identifier))
    edge = edge.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= F.col("_left"))
    return sure.select(*rows.columns).unionByName(edge.select(*rows.columns))


def cap_dominant(rows: DataFrame, group: str, answer: str, order: str, identifier: str, most: float, seed: str) -> DataFrame:
    """Drops rows of a group's most frequent answer (ties: the one seen first) so that its share is at most ``most``; without other answers all go.

    The rows kept are those of smallest draws. Counts by the first digits of the
    draws tell in which stretch the last one lies; only that stretch is ranked.
    """
    drawn = rows.withColumn("_d", draw(F.col(identifier), seed)).withColumn("_s", F.conv(F.substring("_d", 1, 4), 16, 10).cast("int"))
    # one pass over the rows: at most 65,536 stretches for each answer of a group
    cells = kept(drawn.groupBy(group, answer, "_s").agg(F.count("*").alias("_m"), F.min(order).alias("_first")), "cells")
    counts = cells.groupBy(group, answer).agg(F.sum("_m").alias("_n"), F.min("_first").alias("_first"))
    top = counts.groupBy(group).agg(F.max_by(answer, F.struct("_n", -F.col("_first"))).alias("_top"), F.max("_n").alias("_dom"), F.sum("_n").alias("_all"))
    keep = F.least(F.greatest(F.floor(F.lit(most) * (F.col("_all") - F.col("_dom")) / (1 - most)), F.lit(0)), F.col("_dom"))
    plan = top.withColumn("_keep", F.when(F.col("_dom") > most * F.col("_all"), keep)).select(group, "_top", "_keep")  # null: within bounds
    drawn = drawn.join(plan, group, "left").withColumn("_capped", F.col("_keep").isNotNull() & F.col(answer).eqNullSafe(F.col("_top")))
    stretch = cells.join(plan, group).filter(F.col("_keep").isNotNull() & F.col(answer).eqNullSafe(F.col("_top"))).select(group, "_s", "_keep", "_m")
    until = stretch.withColumn("_until", F.sum("_m").over(Window.partitionBy(group).orderBy("_s")))  # at most 65,536 a group
    last = until.filter((F.col("_until") - F.col("_m") < F.col("_keep")) & (F.col("_keep") <= F.col("_until"))).select(group, F.col("_s").alias("_last"), (F.col("_keep") - F.col("_until") + F.col("_m")).alias("_left"))
    dealt = drawn.join(last, group, "left")
    sure = dealt.filter(~F.col("_capped") | (F.col("_s") < F.col("_last")))
    edge = dealt.filter(F.col("_capped") & (F.col("_s") == F.col("_last")))
    edge = edge.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy("_d", identifier))).filter(F.col("_r") <= F.col("_left"))
    return sure.select(*rows.columns).unionByName(edge.select(*rows.columns))


def presence_pool(segments: DataFrame, key: str, targets: dict[str, Column]) -> DataFrame:
    """Every segment once for every key, with ``present``: the pool from which balances are topped up. The keys are a fixed vocabulary."""
    each = [F.struct(F.lit(k).alias(key), F.coalesce(c, F.lit(False)).alias("present")) for k, c in targets.items()]
    return dealt(segments).withColumn("_k", F.explode(F.array(*each))).select(*segments.columns, "_k.*")


def answer_stats(rows: DataFrame, key: str, is_yes: Column) -> DataFrame:
    """For each key, most rows first: ``yes``, ``no``, ``total``, ``share`` of yes."""
    counts = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count_if(is_yes).alias("yes"), F.count_if(~is_yes).alias("no"))
    total = F.col("yes") + F.col("no")
    return counts.withColumn("total", total).withColumn("share", F.col("yes") / total).orderBy(F.desc("total"), key)


def split_by_rank(rows: DataFrame, key: str, first: int) -> DataFrame:
    """``train`` for rows of the first ``first`` keys in order, ``val`` for the others; one of them without keys is an error."""
    keys = kept(rows.select(key).distinct(), "keys")
    n = keys.count()
    if not 0 < first < n:
        raise ValueError(f"the number of training keys must be between 1 and {n - 1}")
    smallest = keys.orderBy(key).limit(first).withColumn("split", F.lit("train"))
    return rows.join(smallest, key, "left").withColumn("split", F.coalesce("split", F.lit("val")))
