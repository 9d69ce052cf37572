"""Frame statistics and flags, answer metrics, and calibration of thresholds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions.arrays import bleu4, let
from sparkloom.functions.text import forceps_named, normalize, polarity


#: Values are cut into multiples of this and a remainder for an exact sum.
GRAIN = 2.0**-20


def exact_mean(x: Column) -> Column:
    """The mean by the exact sum, whatever the order of rows: multiples of ``GRAIN`` add without error while their sums stay below 2 ** 33, and the remainders are too small to err in the result."""
    whole = F.rint(x / GRAIN) * GRAIN
    rest = F.when(F.abs(x) < 2.0**32, x - whole).when(x.isNotNull(), 0.0)  # larger values have none
    return F.try_divide(F.sum(F.when(F.abs(x) < 2.0**32, whole).otherwise(x)) + F.sum(rest), F.count(x))


def frame_stats(pixels: DataFrame, keys: list[str], value: str, order: str | None = None, exact: bool = False) -> DataFrame:
    """Mean, population deviation, 99th percentile, maximum and share above 3.

    A threshold may hang on the mean's last digit, which changes with the order of the sum.
    With ``exact`` it is that of the exact sum; with ``order`` (never null, different within
    a key) the sum is taken in that order.
    """
    x = F.col(value)
    mean = exact_mean(x.cast("double")) if exact else F.avg(x)
    if order is not None:
        before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)  # a running sum: no rows are gathered
        pixels = pixels.withColumn("_sum", F.sum(x).over(before))
        mean = F.try_divide(F.max_by("_sum", order), F.count(x))
    return pixels.groupBy(*keys).agg(mean.alias("mean"), F.stddev_pop(x).alias("std"), F.percentile(x, 0.99).alias("p99"), F.max(x).alias("max"), F.avg((x > 3).cast("double")).alias("nonzero"))


def darkness(frames: Column) -> dict[str, Column]:
    """Counts and flags over an array of frame statistics. A frame without values counts for nothing; the flags are null without any other."""
    tests = {
        "exact_black": lambda f: f["max"] <= 1,
        "near_black": lambda f: (f["mean"] <= 3) & (f["p99"] <= 10),
        "severely_dark": lambda f: (f["mean"] <= 8) & (f["p99"] <= 25),
    }
    counts = {f"n_{n}": F.size(F.filter(frames, t)) for n, t in tests.items()}
    told = {n: F.filter(F.transform(frames, t), lambda b: b.isNotNull()) for n, t in tests.items()}
    some = lambda b, f: F.when(F.size(b) > 0, f(b, lambda x: x))
    return counts | {f"all_{n}": some(b, F.forall) for n, b in told.items()} | {f"any_{n}": some(b, F.exists) for n, b in told.items()}


def flag_summary(rows: DataFrame, flags: list[str], weight: str, case: str) -> DataFrame:
    """For each flag: rows, summed weight and distinct cases that have it."""
    named = F.explode(F.array_compact(F.array(*(F.when(F.col(f), F.lit(f)) for f in flags)))).alias("flag")
    return rows.select(named, weight, case).groupBy("flag").agg(F.count("*").alias("segments"), F.sum(weight).alias("questions"), F.countDistinct(case).alias("cases"))


def complete_sets(files: DataFrame, key: str, exists: str, expected: int) -> DataFrame:
    """For each key how many of the expected files exist, and whether all do."""
    return files.groupBy(key).agg(F.count_if(exists).alias("present")).withColumn("complete", F.col("present") == expected)


def first_hit(rows: DataFrame, lookups: list[tuple[str, DataFrame]], key: str, value: str) -> DataFrame:
    """Rows with ``value`` of the first lookup that has the key, and ``found_in`` (null: none)."""
    out, hits = rows, []
    for k, (name, table) in enumerate(lookups):
        out = out.join(table.select(key, F.struct(F.lit(name).alias("found_in"), F.col(value)).alias(f"_h{k}")), key, "left")
        hits.append(F.col(f"_h{k}"))
    return out.withColumn("_h", F.coalesce(*hits)).select(*rows.columns, "_h.found_in", f"_h.{value}")


def best_reference(references: Column, prediction: Column) -> Column:
    """The best BLEU-4 over the references, on white-space tokens in lower case."""
    words = lambda text: F.split(normalize(text), " ")
    return let(words(prediction), lambda said: best_of(references, lambda r: let(words(r), lambda own: bleu4(own, said))))


def best_of(references: Column, score: Callable[[Column], Column]) -> Column:
    """The best score over the references; 0 without any."""
    return F.coalesce(F.array_max(F.transform(references, score)), F.lit(0.0))


def aligned(items: DataFrame, predictions: DataFrame, place: str, values: list[str]) -> DataFrame:
    """Items with the predictions' values at the same ``place`` (an ordinal); a place on one side only is an error."""
    one = items.withColumn("_item", F.lit(True))
    two = predictions.select(place, *values, F.lit(True).alias("_prediction"))
    both = F.col("_item").isNotNull() & F.col("_prediction").isNotNull()
    ok = F.when(both, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("items and predictions differ at place "), F.col(place).cast("string"))).cast("boolean"))
    return one.join(two, place, "full").filter(ok).drop("_item", "_prediction")


def binary_records(rows: DataFrame, kind: str, references: str, kinds: list[str]) -> DataFrame:
    """Rows of the binary types whose first reference says yes or no, with ``truth``."""
    return rows.filter(F.col(kind).isin(*kinds)).withColumn("truth", polarity(F.get(references, F.lit(0)))).filter("truth IS NOT NULL")


def score_rollup(rows: DataFrame, kind: str, scores: list[str]) -> DataFrame:
    """Mean scores for each type and over all (type null, ``is_total``)."""
    typed = rows.withColumn("_k", F.coalesce(kind, F.lit("unknown")))
    out = typed.rollup("_k").agg(F.grouping("_k").cast("int").alias("is_total"), F.count("*").alias("n"), *(F.avg(s).alias(s) for s in scores))
    return out.withColumnRenamed("_k", kind)


def presence_metrics(rows: DataFrame, prediction: str, reference: str) -> DataFrame:
    """Accuracy (null polarity equals null polarity), negatives and false positives of yes/no answers."""
    p, t = polarity(F.col(prediction)), polarity(F.col(reference))
    out = rows.agg(F.count("*").alias("examples"), F.count_if(p.eqNullSafe(t)).alias("correct"), F.count_if(t == F.lit(False)).alias("negatives"), F.count_if((t == F.lit(False)) & p).alias("false_positives"))
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return out.withColumn("accuracy", rate("correct", "examples")).withColumn("false_positive_rate", rate("false_positives", "negatives"))


def set_f1(rows: DataFrame, predicted: Column, expected: Column) -> DataFrame:
    """Exact matches and micro F1 of predicted against expected sets (F1 is 1 if both are empty everywhere)."""
    sets = rows.select(F.array_sort(predicted).alias("p"), F.array_sort(expected).alias("e"))
    total = sets.agg(
        F.count("*").alias("examples"),
        F.count_if(F.col("p") == F.col("e")).alias("exact"),
        F.coalesce(F.sum(F.size(F.array_intersect("p", "e"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.size(F.array_except("p", "e"))), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.size(F.array_except("e", "p"))), F.lit(0)).alias("fn"),
    )
    low = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return total.withColumn("micro_f1", F.when(F.col("examples") > 0, F.when(low > 0, 2 * F.col("tp") / low).otherwise(1.0)))


def forceps_metrics(rows: DataFrame, prediction: str, references: str) -> DataFrame:
    return set_f1(rows, forceps_named(F.col(prediction)), forceps_named(F.array_join(references, " ")))


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.greatest(F.sum(weight), F.lit(1e-6))


def sweep(records: DataFrame, kind: str, margin: str, truth: str, grid: list[float]) -> DataFrame:
    """Accuracy of ``margin >= threshold`` for each type and threshold.

    The grid is a constant of the job: each record goes to one row a threshold
    inside a partial aggregation, so what is shuffled is types times thresholds.
    """
    usable = records.filter(F.col(margin).isNotNull() & ~F.isnan(margin) & F.col(truth).isNotNull())
    tried = usable.select(kind, margin, truth, F.explode(F.array(*map(F.lit, grid))).alias("threshold"))
    hit = (F.col(margin) >= F.col("threshold")) == F.col(truth)
    return tried.groupBy(kind, "threshold").agg(F.count("*").alias("n"), F.avg(hit.cast("double")).alias("accuracy"))


def calibrated(records: DataFrame, kind: str, margin: str, truth: str, grid: list[float]) -> DataFrame:
    """For each type the best threshold (ties: the lowest) with its accuracy, and that at 0."""
    s = sweep(records, kind, margin, truth, grid)
    return s.groupBy(kind).agg(F.max("n").alias("n"), F.max_by("threshold", F.struct("accuracy", -F.col("threshold"))).alias("best_threshold"), F.max("accuracy").alias("best_accuracy"), F.max(F.when(F.col("threshold") == 0, F.col("accuracy"))).alias("accuracy_at_0"))


def calibration_report(records: DataFrame, kind: str, margin: str, truth: str, greedy: str, grid: list[float]) -> DataFrame:
    """For each type: ``n``, ``yes_rate``, accuracy of the free answer (``greedy``) and of the margin at 0, the best threshold and its accuracy.

    All but the threshold's columns count every record with a truth; a margin that
    is missing or no number leaves only its record's answer.
    """
    known = records.filter(F.col(truth).isNotNull())
    free = known.groupBy(kind).agg(F.count("*").alias("n"), F.avg(F.col(truth).cast("double")).alias("yes_rate"), F.avg(polarity(F.col(greedy)).eqNullSafe(F.col(truth)).cast("double")).alias("greedy_accuracy"))
    return free.join(calibrated(records, kind, margin, truth, grid).drop("n"), kind, "left")


GRID = [(i - 30) / 10 for i in range(61)]
