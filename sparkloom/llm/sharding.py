"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``nodes`` places on a ring of 2**60; a row goes clockwise from its
own place to the first shard that is not full, so balance is guaranteed and only
what overflows moves on. Shards hold ``floor(n / shards)`` rows, the first
``n mod shards`` one more, so they fill exactly: counts are at most one apart.

Rows between two neighbouring places of the ring (an arc) have the same order of
shards before them. Filling therefore works on counts of arcs, a table whose size
the ring fixes: in step d every arc offers what is left of it to its d-th shard,
which takes arcs in ring order up to its room. A row finds its shard and its slot
from its rank in the arc: counts of fixed cells of the ring, and its rank in its
cell; rows are shuffled once by cell. Rows that agree in all
that the result shows are counted together and spread out again at the end, so
many copies of a row make no large group.

Defined results: a null text has size 1 and the CRC of no bytes; a null doc_id is
a key of its own; rows that repeat are each placed. An empty table gives no rows.
Extra columns are ignored. Everything is DataFrame operations; nothing is
collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHARDS, NODES = 8, 256
#: Digits of an MD5 that make a place on the ring.
DIGITS = 15
#: The ring is cut into so many (a power of two) equal cells, in each of which rows are ranked by one task.
CELL_BITS = 16
#: Copies of one row that are spread out by one row of the last step.
BLOCK = 4096


def _place(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long")


def _places(spark: SparkSession, shards: int, nodes: int) -> DataFrame:
    """``shard``, ``at`` of all virtual nodes."""
    own = spark.range(shards * nodes).select((F.col("id") % shards).alias("shard"), F.floor(F.col("id") / shards).alias("node"))
    return own.select("shard", _place(F.concat(F.lit("shard "), F.col("shard").cast("string"), F.lit(" node "), F.col("node").cast("string"))).alias("at"))


def ring(spark: SparkSession, shards: int, nodes: int) -> DataFrame:
    """``arc`` (that many places of the ring lie before it), ``step``, ``shard``: whom an arc's rows ask in turn."""
    listed = _places(spark, shards, nodes).groupBy().agg(F.array_sort(F.collect_list(F.struct("at", "shard"))).alias("places"))  # shards * nodes
    arcs = listed.select("places", F.explode(F.sequence(F.lit(0), F.lit(shards * nodes))).alias("arc"))
    ahead = F.concat(F.slice("places.shard", F.col("arc") + 1, F.lit(shards * nodes)), F.slice("places.shard", F.lit(1), F.col("arc")))
    return arcs.select("arc", F.posexplode(F.array_distinct(ahead)).alias("step", "shard"))


def with_arc(rows: DataFrame, shards: int, nodes: int) -> DataFrame:
    """``rows`` with the arc of their ``place``.

    The ring is cut into as many equal slices as it has places; a slice lists the
    few places within it and counts those before it.
    """
    spark, slices = rows.sparkSession, shards * nodes
    width = -(-(16**DIGITS) // slices)
    found = _places(spark, shards, nodes).groupBy(F.floor(F.col("at") / width).alias("slice")).agg(F.array_sort(F.collect_list("at")).alias("within"))
    every = spark.range(slices).select(F.col("id").alias("slice")).join(found, "slice", "left").withColumn("within", F.coalesce("within", F.array().cast("array<long>")))
    table = every.withColumn("before", F.sum(F.size("within")).over(Window.orderBy("slice")) - F.size("within"))
    # broadcast: one row a slice, whatever the data
    joined = rows.withColumn("slice", F.floor(F.col("place") / width)).join(F.broadcast(table), "slice")
    return joined.withColumn("arc", (F.col("before") + F.size(F.filter("within", lambda p: p < F.col("place")))).cast("int")).drop("slice", "within", "before")


def fill(asked: DataFrame, shards: int) -> DataFrame:
    """From ``arc, step, shard, n`` (rows of the arc), ``room``: what each step deals.

    Adds ``taken`` and ``slot``, the place in its shard of the first row taken. A
    row of the table is one arc asking one shard; step after step, an arc's rest
    and a shard's room are sums of what was taken before.
    """
    of_arc, of_shard = Window.partitionBy("arc"), Window.partitionBy("shard")
    in_turn = of_shard.orderBy("arc").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = asked.withColumn("taken", F.lit(0).cast("long")).withColumn("slot", F.lit(0).cast("long"))
    for step in range(shards):
        now = F.col("step") == step
        state = state.withColumn("offer", F.when(now, F.col("n") - F.sum("taken").over(of_arc)).otherwise(0))
        state = state.withColumn("used", F.sum("taken").over(of_shard)).withColumn("ahead", F.sum("offer").over(in_turn) - F.col("offer"))
        state = state.withColumn("slot", F.when(now, F.col("used") + F.col("ahead")).otherwise(F.col("slot"))).withColumn("taken", F.when(now, F.greatest(F.least(F.col("room") - F.col("slot"), F.col("offer")), F.lit(0))).otherwise(F.col("taken")))
    return state.drop("offer", "used", "ahead")


def assign(docs: DataFrame, *, shards: int = SHARDS, nodes: int = NODES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, ``size`` (bytes of the text plus 1), ``text_crc32``, ``shard`` and ``slot`` (gapless in the shard) of every row."""
    spark = docs.sparkSession
    raw = F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "utf-8")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    name = F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "size", "text_crc32")
    rows = with_arc(rows.withColumn("place", _place(name)), shards, nodes)

    rows = rows.withColumn("cell", F.shiftright("place", 4 * DIGITS - CELL_BITS).cast("int"))
    cells = rows.groupBy("arc", "cell").agg(F.sum("copies").alias("n"))
    counts = cells.groupBy("arc").agg(F.sum("n").alias("n"))
    asked = ring(spark, shards, nodes).join(counts, "arc").withColumn("total", F.sum(F.when(F.col("step") == 0, F.col("n"))).over(Window.partitionBy()))
    asked = asked.withColumn("room", F.floor(F.col("total") / shards) + (F.col("shard") < F.col("total") % shards).cast("long"))
    quotas = fill(asked, shards).filter("taken > 0")
    earlier = Window.partitionBy("arc").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    quotas = quotas.withColumn("high", F.sum("taken").over(earlier)).select("arc", F.col("shard").cast("int").alias("shard"), (F.col("high") - F.col("taken")).alias("low"), "high", "slot")

    # broadcast: at most 2**CELL_BITS rows and one more for each place of the ring
    start = F.broadcast(cells.select("arc", "cell", (F.sum("n").over(Window.partitionBy("arc").orderBy("cell")) - F.col("n")).alias("before")))
    order = Window.partitionBy("arc", "cell").orderBy("place", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = rows.withColumn("own", F.sum("copies").over(order)).join(start, ["arc", "cell"])
    ranked = ranked.withColumn("until", F.col("before") + F.col("own")).withColumn("from", F.col("until") - F.col("copies"))
    # broadcast: a row for each place of the ring and shard at most
    met = ranked.join(F.broadcast(quotas), "arc").withColumn("a", F.greatest("low", "from")).withColumn("b", F.least("high", "until")).filter("a < b")
    met = met.select("doc_id", "size", "text_crc32", "shard", (F.col("slot") + F.col("a") - F.col("low")).alias("slot"), (F.col("b") - F.col("a")).alias("many"))
    parts = met.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1, F.lit(BLOCK).cast("long"))))
    spread = parts.withColumn("k", F.explode(F.sequence(F.col("start"), F.least(F.col("start") + BLOCK - 1, F.col("many") - 1))))
    return spread.select("doc_id", "size", "text_crc32", "shard", (F.col("slot") + F.col("k")).alias("slot"))
