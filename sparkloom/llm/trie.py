"""Prefix trie of conversations by truncation peeling.

Every distinct sequence of a conversation's first d turns is a node. The trie is
peeled from its deepest turns: at each depth, the sequences that end there merge
with what is left of longer ones, a group is a node with all it needs to know of
its subtree, and its last turn is stripped, so that the groups meet again one turn
shorter. Nodes are found and summed up in the same pass; only the nodes of one depth
take part in a round.

Rounds run only down from the greatest depth that two different sequences share.
Below it a sequence is alone: its nodes are a chain, peeled at once by sums from
its end. Conversations with equal turns are one sequence with a count, so a
conversation with very many copies is one row. A turn's role and text are two
64-bit hashes once its place is known, and a sequence's name is the XOR of its
turns' hashes with their places, so no text and no list of turns is shuffled again;
only the part of a sequence that others share is carried as a list.

Sums are aggregated before they are shuffled, so a first turn that very many
conversations have is no hot key. The turns of one conversation are put in order by
one task, which spills. The members that end at a node are hashed in their order by
one task that reads them as a stream: SHA-256 has no parallel form.

Defined results: a null role or text is empty, a null turn comes first; turns of
equal number are in order of role and text; repeated rows are repeated turns. Rows
without a conv_id belong to no conversation. A conversation whose rebuilt form has no
turns is a member of the root. An empty table gives no rows. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, discard, partitions, stored

WORD = r"[^\x20\x09-\x0D]+"
#: Conversations that share their opening turns, and the most turns they share.
FAMILY, OPENING = 20, 3
#: Range of conv_ids that are joined to one piece of a node's member list.
PIECE = 4096
NOTHING = hashlib.sha256().hexdigest()


def numbered_turns(conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``c, pos, h1, h2, words``: the place, name and word count of every turn."""
    said = [F.coalesce(F.col(x).cast("string"), F.lit("")).alias(y) for x, y in ((role, "role"), (text, "text"))]
    rows = conversations.select(F.col(conv_id).cast("long").alias("c"), F.col(turn).alias("turn"), *said).filter("c is not null")
    order = Window.partitionBy("c").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = rows.withColumn("pos", F.row_number().over(order))
    return placed.select("c", "pos", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(7), "text", "role").alias("h2"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))


def rebuilt(turns: DataFrame, *, family: int = FAMILY, opening: int = OPENING) -> DataFrame:
    """``c, d, h1, h2, words``: every conversation with its first turns taken from the first of its family.

    A conversation without turns after that has no rows.
    """
    taken = F.crc32(F.col("c").cast("string")) % (opening + 1)
    bases = turns.filter(F.col("pos") <= opening).select(F.col("c").alias("base"), *(x for x in turns.columns if x != "c"))
    ids = turns.filter("pos = 1").select("c", (F.col("c") - F.col("c") % family).alias("base"))
    opened = ids.join(bases, "base").filter(F.col("pos") <= taken).select("c", F.lit(0).alias("part"), "pos", "h1", "h2", "words")
    own = turns.filter(F.col("pos") > taken).select("c", F.lit(1).alias("part"), "pos", "h1", "h2", "words")
    place = F.row_number().over(Window.partitionBy("c").orderBy("part", "pos"))
    return opened.unionByName(own).select("c", place.alias("d"), "h1", "h2", "words")


def _prefixes(turns: DataFrame) -> DataFrame:
    """``c, d, k1, k2, p1, p2, words, last``: each prefix by name, with its parent's name."""
    order = Window.partitionBy("c").orderBy("d")
    to_here = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    names = turns.select("c", "d", "words", F.bit_xor(F.xxhash64("h1", "d")).over(to_here).alias("k1"), F.bit_xor(F.xxhash64("h2", "d")).over(to_here).alias("k2"), F.lead("d").over(order).isNull().alias("last"))
    return names.select("*", *(F.lag(f"k{i}", 1, 0).over(order).alias(f"p{i}") for i in (1, 2)))


def _ends(members: DataFrame) -> DataFrame:
    """``k1, k2, ends_sha256`` of the nodes at which conversations end.

    Pieces of the sorted list, each of a bounded range of conv_ids, are made where
    the rows are, and hashed one after the other.
    """
    piece = F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda c: c.cast("string")), ",")
    pieces = members.groupBy("k1", "k2", F.floor(F.col("c") / PIECE).alias("at")).agg(piece.alias("piece"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, hashlib.sha256()
        for batch in batches:
            out = []
            for *now, piece in zip(*(column(batch, x).to_pylist() for x in ("k1", "k2", "piece"))):
                if now == key:
                    state.update(b",")
                else:
                    if key:
                        out.append((*key, state.hexdigest()))
                    key, state = now, hashlib.sha256()
                state.update(piece.encode())
            yield _batch(out)
        if key:
            yield _batch([(*key, state.hexdigest())])

    ordered = pieces.repartition(partitions(members.sparkSession), "k1", "k2").sortWithinPartitions("k1", "k2", "at")
    return ordered.select("k1", "k2", "piece").mapInArrow(run, "k1 long, k2 long, ends_sha256 string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string()))], ["k1", "k2", "ends_sha256"])


def _peeled(entries: DataFrame, deepest: int) -> list[DataFrame]:
    """Nodes of each depth from ``deepest`` to the root, from rows that say what a sequence brings to the node at the end of its ``path``."""
    levels: list[DataFrame] = []
    up: DataFrame | None = None
    top = F.element_at("path", -1)
    for d in range(deepest, -1, -1):
        alive = entries.filter(F.col("depth") == d).drop("depth")
        alive = alive if up is None else alive.unionByName(up)
        key: list[Column] = [top[f"k{i}"] if d else F.lit(0).cast("long") for i in (1, 2)]
        group = alive.groupBy(key[0].alias("k1"), key[1].alias("k2")).agg(F.first("path").alias("path"), *(F.sum(x).alias(x) for x in ("n_children", "n_convs", "n_leaves", "saved_tokens")), F.min("conv_id").alias("conv_id"))
        own = (F.col("n_convs") - 1) * (top["words"] if d else F.lit(0))
        node = group.withColumns({"n_leaves": F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")).cast("long"), "saved_tokens": F.col("saved_tokens") + own, "depth": F.lit(d).cast("long")})
        levels.append(stored(node, keep="level"))
        up = levels[-1].select(F.slice("path", 1, d - 1).alias("path"), F.lit(1).cast("long").alias("n_children"), "n_convs", "n_leaves", "saved_tokens", "conv_id") if d else None
    return levels


def nodes(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per node of the trie of ``turns(c, d, h1, h2, words)``; ``ids(c)`` names all conversations, those without turns too."""
    steps = stored(_prefixes(turns), keep="prefixes")
    zero = F.lit(0).cast("long")
    last = steps.filter("last").select("k1", "k2", "c", "d")
    turnless = ids.join(steps.filter("d = 1").select("c"), "c", "left_anti").select(zero.alias("k1"), zero.alias("k2"), "c", F.lit(0).alias("d"))
    members = stored(last.unionByName(turnless), keep="members")
    # conversations with equal turns are one sequence, named by the smallest of them
    sequences = stored(members.groupBy("k1", "k2").agg(F.min("c").alias("c"), F.count("*").alias("m"), F.first("d").alias("n")).drop("k1", "k2"), keep="sequences")
    paths = stored(steps.join(sequences.select("c"), "c", "left_semi"), keep="paths")
    discard(steps)
    shared = stored(paths.groupBy("k1", "k2").agg(F.min("c").alias("a"), F.max("c").alias("b")).filter("a <> b").select("k1", "k2"), keep="shared")
    depths = paths.join(shared, ["k1", "k2"]).groupBy("c").agg(F.max("d").alias("s"))
    sequences = stored(sequences.join(depths, "c", "left").withColumn("s", F.coalesce("s", F.lit(0))), keep="depths")

    from_end = Window.partitionBy("c").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    alone = paths.join(sequences, "c").filter("d > s")
    saved = F.sum((F.col("m") - 1) * F.col("words")).over(from_end)
    tails = stored(alone.select("c", F.col("d").cast("long").alias("depth"), "k1", "k2", "p1", "p2", F.col("m").alias("n_convs"), F.when(F.col("d") < F.col("n"), 1).otherwise(0).cast("long").alias("n_children"), saved.alias("saved_tokens"), (F.col("d") == F.col("s") + 1).alias("top")), keep="tails")

    step = F.struct("d", "k1", "k2", "words")
    carried = paths.join(sequences, "c").filter("d <= s").groupBy("c").agg(F.sort_array(F.collect_list(step)).alias("path"))
    tops = tails.filter("top").select("c", "saved_tokens")
    goes_on = F.col("n") > F.col("s")
    none = F.array().cast("array<struct<d:int,k1:bigint,k2:bigint,words:bigint>>")
    entries = sequences.join(carried, "c", "left").join(tops, "c", "left").select(
        F.col("s").alias("depth"), F.coalesce("path", none).alias("path"), goes_on.cast("long").alias("n_children"), F.col("m").alias("n_convs"), goes_on.cast("long").alias("n_leaves"), F.coalesce("saved_tokens", zero).alias("saved_tokens"), F.col("c").alias("conv_id")
    )
    entries = stored(entries, keep="entries")
    deepest = entries.agg(F.max("depth")).first()[0]
    levels = _peeled(entries, deepest) if deepest is not None else []
    discard(paths, shared, sequences, entries)

    # below a tail's top, parent and child are nodes of one sequence
    inner = tails.filter("not top").withColumns({"conv_id": F.col("c"), "parent_conv_id": F.col("c")})
    tail_tops = tails.filter("top").withColumn("conv_id", F.col("c"))
    figures = ["k1", "k2", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    one = F.lit(1).cast("long")
    above = F.try_element_at("path", F.lit(-2))
    children = [x.select(*figures, *(F.coalesce(above[f"k{i}"], zero).alias(f"p{i}") for i in (1, 2))) for x in levels]
    children.append(tail_tops.withColumn("n_leaves", one).select(*figures, "p1", "p2"))
    parents = reduce(DataFrame.unionByName, (x.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent")) for x in levels)) if levels else None
    if parents is None:  # no conversations
        return tails.select(*(F.col("c").alias(x) for x in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), F.lit("").alias("ends_sha256"))
    named = reduce(DataFrame.unionByName, children).join(parents, ["p1", "p2"], "left").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("parent")))
    every = named.select(*figures, "parent_conv_id").unionByName(inner.withColumn("n_leaves", one).select(*figures, "parent_conv_id"))
    found = every.join(_ends(members.select("k1", "k2", "c")), ["k1", "k2"], "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, *, family: int = FAMILY, opening: int = OPENING, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of all rebuilt conversations: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``."""
    turns = stored(numbered_turns(conversations, conv_id=conv_id, turn=turn, role=role, text=text), keep="turns")
    return nodes(rebuilt(turns, family=family, opening=opening), turns.filter("pos = 1").select("c"))


_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295)"
#: The result of ``op13`` in DuckDB's SQL. CRC-32 is written out bit by bit.
ORACLE = rf"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, c - c % {FAMILY} AS base, {_CRC} % {OPENING + 1} AS h FROM (SELECT DISTINCT c FROM t)),
b AS (SELECT ids.c, 0 AS part, t.pos, t.role, t.text FROM ids JOIN t ON t.c = ids.base AND t.pos <= ids.h UNION ALL SELECT ids.c, 1, t.pos, t.role, t.text FROM ids JOIN t ON t.c = ids.c AND t.pos > ids.h),
seqs AS (SELECT c, list(md5(role || chr(0) || text) ORDER BY part, pos) AS s, list(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) ORDER BY part, pos) AS w FROM b GROUP BY c),
every AS (SELECT ids.c, coalesce(s, []) AS s, coalesce(w, []) AS w FROM ids LEFT JOIN seqs USING (c)),
pre AS (SELECT c, d, s[1:d] AS k, CASE WHEN d > 0 THEN w[d] ELSE 0 END AS words, d = len(s) AS ended FROM (SELECT *, unnest(range(len(s) + 1)) AS d FROM every)),
node AS (SELECT k, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ended), '') AS ends FROM pre GROUP BY k),
kids AS (SELECT p.k, count(q.k) AS n_children FROM node p LEFT JOIN node q ON q.depth > 0 AND q.k[1:q.depth - 1] = p.k GROUP BY p.k),
full_ AS (SELECT * FROM node JOIN kids USING (k)),
up AS (SELECT k[1:a] AS k, n_children, (n_convs - 1) * words AS saved FROM (SELECT *, unnest(range(depth + 1)) AS a FROM full_)),
sub AS (SELECT k, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM up GROUP BY k)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, sub.n_leaves, CAST(sub.saved_tokens AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_ f JOIN sub USING (k) LEFT JOIN full_ p ON f.depth > 0 AND f.k[1:f.depth - 1] = p.k
"""
