"""Reproducible sampling: ranks and choices come from a hash of the row's key, not from the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions.text import stable_fraction


def draw(key: Column, seed: str) -> Column:
    """A digest to order rows by at random."""
    return F.sha2(F.concat(F.lit(seed + "|"), key.cast("string")), 256)


def take_per_group(rows: DataFrame, group: list[str], key: str, n: int | Column, seed: str) -> DataFrame:
    """At most ``n`` rows of each group, drawn by their key."""
    w = Window.partitionBy(*group).orderBy(draw(F.col(key), seed), key)
    return rows.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def first_per_group(rows: DataFrame, group: list[str], order: str, n: int) -> DataFrame:
    """At most the first ``n`` rows of each group by ``order``."""
    w = Window.partitionBy(*group).orderBy(order)
    return rows.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def stratified(rows: DataFrame, group: str, key: str, interesting: Column, most: int, share: float, seed: str) -> DataFrame:
    """Up to ``most`` rows of each group: interesting ones up to their share, others fill what these leave."""
    flagged = rows.withColumn("_i", interesting)
    quota = flagged.groupBy(group).agg(F.least(F.count_if("_i"), F.lit(int(most * share))).alias("_n"))
    w = Window.partitionBy(group, "_i").orderBy(draw(F.col(key), seed), key)
    ranked = flagged.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= most).join(quota, group)  # a literal bound limits each task's groups
    return ranked.filter(F.col("_rank") <= F.when(F.col("_i"), F.col("_n")).otherwise(most - F.col("_n"))).drop("_i", "_n", "_rank")


def keep_fraction(rows: DataFrame, key: str, fraction: float) -> DataFrame:
    return rows.filter(stable_fraction(F.col(key).cast("string")) < fraction)


def choose(options: list[str], key: Column) -> Column:
    """One of the options, evenly by the key's hash."""
    place = F.least(F.floor(stable_fraction(key.cast("string")) * len(options)), F.lit(len(options) - 1)).cast("int")
    return F.get(F.array(*map(F.lit, options)), place)


def weighted_choice(first: Column, others: Column, key: Column, weight: float = 0.55) -> Column:
    """``first`` with the given weight, else one of ``others`` evenly."""
    f = stable_fraction(key.cast("string"))
    n = F.size(others)
    place = F.least(F.floor((f - weight) / (1 - weight) * n), n - 1).cast("int")
    return F.when((f < weight) | (n == 0), first).otherwise(F.get(others, place))


def slots(rows: DataFrame, key: str, weights: dict[str, int], k: int, seed: str) -> DataFrame:
    """``k`` of the weighted slots for each row, drawn without putting back (a type with several slots may come more than once)."""
    listed = [F.struct(F.lit(t).alias("slot_type"), F.lit(i).alias("slot")) for t, n in weights.items() for i in range(n)]
    drawn = F.transform(F.array(*listed), lambda s: F.struct(draw(F.concat_ws("|", F.col(key).cast("string"), s.slot_type, s.slot.cast("string")), seed).alias("d"), s.slot_type, s.slot))
    return rows.withColumn("_s", F.explode(F.slice(F.array_sort(drawn), 1, k))).select(*rows.columns, "_s.slot_type", "_s.slot")
