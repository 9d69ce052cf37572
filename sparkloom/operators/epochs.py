"""Training rows in an order of their own for every epoch, in shards and batches.

Orders come from hashes of epoch and key, so they can be made again anywhere. Places
are gapless: rows are sorted in ranges, what precedes a range is a sum over as many
counts as there are ranges, and no task sorts everything.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, pairwise

import pyarrow as pa
from pyarrow import parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from sparkloom.functions import arrays as A
from sparkloom.operators.sampling import draw, weighted_choice
from sparkloom.sources.frames import read_files, write_once
from sparkloom.sources.shared import dealt, opened, scratch


def placed(rows: DataFrame, order: list[str], name: str = "place", within: str | None = None, ranges: int | None = None) -> DataFrame:
    """Rows with their gapless place from 0 in ``order``, or, with ``within`` (first of the order), in each of its values.

    The sorted ranges are written once, since a range's rows must be those that were
    counted. Rows that are alike in ``order`` may swap places.
    """
    if within is not None and order[0] != within:
        raise ValueError("the order begins with the column that places are counted within")
    spark = rows.sparkSession
    group = [within] if within else []
    sorted_ = rows.repartitionByRange(*([ranges] if ranges else []), *order).sortWithinPartitions(*order).withColumn("_i", F.monotonically_increasing_id())
    path = scratch(spark, "placed")
    sorted_.write.parquet(path)
    kept = spark.read.schema(sorted_.schema).parquet(path)
    part = F.shiftright("_i", 33)
    counts = kept.groupBy(*group, part.alias("_p")).agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    # one row for each range (and value in it)
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*group, "_p", "_first", before.alias("_before"))
    met = kept.withColumn("_p", part).join(starts, [*group, "_p"])
    return met.withColumn(name, F.col("_before") + F.col("_i") - F.col("_first")).select(*rows.columns, name)


def in_epochs(rows: DataFrame, key: str, epochs: int, shard_rows: int, seed: str = "epoch", first: int = 0) -> DataFrame:
    """Each row once an epoch, with ``epoch``, ``shard`` and ``row`` (its place in the shard).

    Every shard of an epoch but the last has exactly ``shard_rows`` rows. Null keys
    have one draw each and come in any order among themselves.
    """
    every = rows.withColumn("epoch", F.explode(F.array(*(F.lit(e).cast("long") for e in range(first, first + epochs)))))
    drawn = every.withColumn("_draw", draw(F.concat_ws("|", F.col("epoch").cast("string"), F.col(key).cast("string")), seed))
    there = placed(drawn, ["epoch", "_draw", key], "_place", within="epoch")
    return there.withColumns({"shard": F.floor(F.col("_place") / shard_rows), "row": F.col("_place") % shard_rows}).drop("_draw", "_place")


def epoch_answer(answers: Column, key: Column, epoch: Column, weight: float = 0.55) -> Column:
    """The answer that a row trains on in an epoch: the first with ``weight``, else one of the others evenly; null without answers."""
    drawn = F.concat_ws("|", F.lit("answer"), epoch.cast("string"), key.cast("string"))
    return weighted_choice(F.get(answers, F.lit(0)), F.slice(answers, 2, F.greatest(F.size(answers) - 1, F.lit(0))), drawn, weight)


def write_shards(rows: DataFrame, path: str) -> DataFrame:
    """Rows of ``in_epochs`` as one Parquet file for each shard, in order; returns the manifest ``epoch, shard, n`` of what tasks wrote.

    A shard has a bounded number of rows, so a task writes whole shards, each moved to
    its final name once it is whole: the driver neither moves nor lists files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = opened(path)
        for (epoch, shard), own in groupby(_pieces(batches), lambda p: p[0]):
            table = pa.Table.from_batches([b for _, b in own]).drop_columns(["epoch", "shard"])
            data = pa.BufferOutputStream()
            pq.write_table(table, data)
            folder, name = f"{base}/{_shard_file(epoch, shard)}".rsplit("/", 1)
            files.create_dir(folder, recursive=True)
            write_once(files, f"{folder}/{name}", data.getvalue())
            yield pa.RecordBatch.from_pydict({"epoch": [epoch], "shard": [shard], "n": [table.num_rows]})

    spark = rows.sparkSession
    report, schema = scratch(spark, "manifest"), "epoch bigint, shard bigint, n bigint"
    sorted_ = dealt(rows.withColumns({c: F.col(c).cast("long") for c in ("epoch", "shard")}), "epoch", "shard").sortWithinPartitions("epoch", "shard", "row")
    sorted_.mapInArrow(run, schema).write.parquet(report)
    return spark.read.schema(schema).parquet(report)


def _shard_file(epoch: int, shard: int) -> str:
    return f"epoch={epoch}/shard={shard}/part-0.parquet"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """Sorted batches cut where the shard changes."""
    for batch in batches:
        keys = list(zip(batch.column("epoch").to_pylist(), batch.column("shard").to_pylist()))
        start = 0
        for key, same in groupby(keys):
            n = sum(1 for _ in same)
            yield key, batch.slice(start, n)
            start += n


def read_shards(manifest: DataFrame, path: str, schema: str, epoch: int = 0, shard: int = 0, row: int = 0) -> DataFrame:
    """Rows (``schema``) of the manifest's shards from a position on, with ``epoch``, ``shard`` and ``n``. Tasks open the files by name; earlier ones are not opened."""
    columns = StructType.fromDDL(schema)
    wanted = to_arrow_schema(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held in batch.to_pylist():
                table = pq.read_table(pa.BufferReader(held["content"]), columns=wanted.names).cast(wanted)
                for c in ("epoch", "shard", "n"):
                    table = table.append_column(c, pa.array([held[c]] * table.num_rows, pa.int64()))
                yield from table.combine_chunks().to_batches()

    ahead = manifest.filter((F.col("epoch") > epoch) | ((F.col("epoch") == epoch) & (F.col("shard") >= shard)))
    name = F.concat(F.lit("epoch="), "epoch", F.lit("/shard="), "shard", F.lit("/part-0.parquet"))
    found = read_files(ahead.select("epoch", "shard", "n", name.alias("path")), path, "path")
    out = StructType([*columns.fields, *StructType.fromDDL("epoch bigint, shard bigint, n bigint").fields])
    return resumed(found.mapInArrow(run, out), epoch, shard, row)


def resumed(path_rows: DataFrame, epoch: int, shard: int, row: int) -> DataFrame:
    """Rows from a position on; folders of earlier epochs and shards are not opened."""
    later = (F.col("epoch") > epoch) | ((F.col("epoch") == epoch) & ((F.col("shard") > shard) | ((F.col("shard") == shard) & (F.col("row") >= row))))
    return path_rows.filter((F.col("epoch") >= epoch) & later)


def length_bounds(most: int, spread: float) -> list[int]:
    """The least lengths of classes in which the longest is at most ``spread`` times the shortest, up to ``most``."""
    if not spread > 1 or most < 1:
        raise ValueError("spread is above 1, and most is 1 at least")
    bounds = [1]
    while bounds[-1] <= most:
        bounds.append(int(bounds[-1] * spread) + 1)
    return bounds[:-1]


def length_batches(rows: DataFrame, length: str, key: str, size: int, most: int, spread: float = 1.25, seed: str = "batch", group: str | None = None) -> DataFrame:
    """Rows with ``batch`` (gapless from 0), ``slot`` in it, and ``width``, the batch's own greatest length.

    A batch holds ``size`` rows of one length class (the last of a class maybe fewer),
    so at most 1 - 1 / spread of it is padding. Within a class rows are in the order
    of a draw. With ``group`` (whole numbers from 0, as epochs are) a batch is of one
    group, and a group's batches follow those of smaller ones. A null length or one outside 1 to ``most`` is an error, since nothing
    is cut off.
    """
    bounds = length_bounds(most, spread)
    ok = F.col(length).between(1, most)
    told = F.concat(F.lit("a row has "), F.coalesce(F.col(length).cast("string"), F.lit("no")), F.lit(f" tokens, not 1 to {most}"))
    fit = rows.filter(F.when(ok, F.lit(True)).otherwise(F.raise_error(told).cast("boolean")))
    classes = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(length))).cast("long")
    if group is not None:
        classes = classes + F.col(group) * (len(bounds) + 1)
    there = placed(fit.withColumns({"_class": classes, "_draw": draw(F.col(key), seed)}), ["_class", "_draw", key], "_place", within="_class")
    counts = there.groupBy("_class").agg(F.ceil(F.count("*") / size).alias("_b"))
    before = counts.select("_class", (F.sum("_b").over(Window.orderBy("_class")) - F.col("_b")).alias("_before"))  # one row a class
    numbered = there.join(F.broadcast(before), "_class").withColumns({"batch": F.col("_before") + F.floor(F.col("_place") / size), "slot": F.col("_place") % size})
    width = F.max(length).over(Window.partitionBy("batch"))  # of one batch
    return numbered.withColumn("width", width).select(*rows.columns, "batch", "slot", "width")


def shuffled_batches(rows: DataFrame, epoch: str, seed: str = "order") -> DataFrame:
    """Rows of ``length_batches`` (grouped by ``epoch``) with ``batch`` counted anew in each epoch, in the order of a draw, so that lengths come mixed."""
    batches = rows.select(epoch, "batch").distinct()
    drawn = batches.withColumn("_draw", draw(F.concat_ws("|", F.col(epoch).cast("string"), F.col("batch").cast("string")), seed))
    order = placed(drawn, [epoch, "_draw", "batch"], "_new", within=epoch).select("batch", "_new")
    return rows.join(order, "batch").withColumn("batch", F.col("_new")).select(*rows.columns)


def collated(rows: DataFrame, ids: str, labels: str, pad: int, ignore: int = -100) -> DataFrame:
    """Rows of ``length_batches`` with ``ids``, ``labels`` and ``attention_mask`` at their batch's width."""
    width = F.col("width").cast("int")
    return rows.withColumns({"attention_mask": A.attention(F.col(ids), width), ids: A.padded(F.col(ids), width, pad), labels: A.padded(F.col(labels), width, ignore)})


def spread_of(bounds: list[int], most: int) -> float:
    """The greatest share of padding that classes with these bounds allow."""
    return max(1 - a / (b - 1) for a, b in pairwise([*bounds, most + 1]))
