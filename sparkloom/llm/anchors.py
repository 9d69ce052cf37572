"""Removal of repeated word sequences by fixed-block anchors.

A window is ``length`` consecutive words of one document; every word covered by a
window that also starts earlier (in a smaller doc_id, or earlier in the same
document) is removed. Windows are judged on the input.

Every document is cut into non-overlapping reference blocks of ``length // 2`` words.
A window, wherever it starts, holds one of them whole, so an index of the blocks,
probed with every rolling run of as many words, finds at least one hit in all places
of a repeated window. A hit is then extended: the windows that hold it are named by
the runs at their two ends, the smallest place of each name is found, and windows
that follow each other there form the maximal repeats, whose union is removed.

Both steps exchange packed arrays of hashes, one row for each stretch of text and
range of hashes, not a row for each word. What a stretch of about a megabyte already
shows to be repeated is settled there and sent once as evidence, so a passage in very
many documents is a few entries. Texts are never shuffled: they are written once to
a table bucketed by the task that wrote them, and the answers to both steps are
joined to it bucket by bucket.

A text longer than a stretch is cut between words; each part also carries the
``length - 1`` words before and after it, so no window is lost and memory has a bound
(except for a single word longer than a stretch, which stays whole).

Defined results: a null text is empty. A null doc_id counts as 2**63 - 1; documents of
one doc_id are ordered by a hash of their text. Rows that repeat both doc_id and text
are one document and all come back. Texts of fewer than ``length`` words keep all.
Extra columns are ignored. An empty table gives no rows. Blocks are compared by a
hash of 31 bits and its range, which only makes candidates; windows by 96 bits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, column, discard, partitions, shared_dir, stored, text_bytes
from .words import _BREAK, mix, words

LENGTH = 20
#: Bytes of text that are worked on together.
STRETCH = 1 << 20
#: Bytes of text whose hashes make one range, and repeated hashes a task remembers to have sent.
RANGE, SENT = 12 << 20, 1 << 20
LAST = (1 << 63) - 1
TABLE = "g int, b int, long boolean, size long, doc_id array<long>, o array<long>, t1 array<long>, t2 array<long>, number array<long>, base array<long>, lead array<int>, own array<int>, part array<binary>"
RESULT = "g int, number long, base long, doc_id long, n_words long, n_removed long, kept string"
U = np.uint64
PACKED = np.dtype([("w", "<u8"), ("x", "<u4"), ("r", "<i8"), ("p", "<i4")])


def _cuts(raw: bytes, length: int, stretch: int) -> Iterator[tuple[int, int, int, bytes]]:
    """Parts of a long text: words before it, words of its context before, own words, and the bytes with both contexts."""
    edges = [0]
    while len(raw) - edges[-1] > stretch:
        at = edges[-1] + stretch
        while at < len(raw) and not _BREAK[raw[at]]:
            at += 1
        edges.append(at)
    edges.append(len(raw))
    spans = [(a, b) for a, b in zip(edges, edges[1:]) if a < b]
    before, lead = 0, b""
    for k, (a, b) in enumerate(spans):
        own, after, reach = raw[a:b].split(), [], k + 1
        while reach < len(spans) and len(after) < length - 1:  # a part may have few words
            x, y = spans[reach]
            after += raw[x:y].split(None, length)[: length - 1 - len(after)]
            reach += 1
        yield before, len(lead.split()), len(own), b" ".join([lead, *own, *after])
        before += len(own)
        lead = b" ".join([*lead.split(), *own][-(length - 1) :])


def _table(docs: DataFrame, text: str, doc_id: str, length: int, stretch: int) -> tuple[DataFrame, str]:
    """The texts in stretches, bucketed by the task that wrote them, and the table's name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, b, number = TaskContext.get().partitionId(), 0, 0

        def row(long: bool, size: int, cols: list[pa.Array]) -> pa.RecordBatch:
            nonlocal b
            b += 1
            lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in cols]
            return pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([b], pa.int32()), pa.array([long]), pa.array([size]), *lists], ["g", "b", "long", "size", "doc_id", "o", "t1", "t2", "number", "base", "lead", "own", "part"])

        for block in blocks(batches, "part", stretch):
            keys, size = [column(block, k) for k in ("doc_id", "o", "t1", "t2")], len(text_bytes(column(block, "part"))[0])
            if size <= stretch or block.num_rows > 1:
                n = block.num_rows
                numbers = pa.array(np.arange(number, number + n))
                yield row(False, size, [*keys, numbers, pa.array(np.zeros(n, np.int64)), pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, -1, np.int32)), column(block, "part")])
                number += n
                continue
            for before, lead, own, part in _cuts(column(block, "part")[0].as_py(), length, stretch):
                yield row(True, len(part), [*keys, *(pa.array([v], k) for v, k in ((number, pa.int64()), (before, pa.int64()), (lead, pa.int32()), (own, pa.int32()), (part, pa.binary())))])
            number += 1

    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    key = F.col(doc_id).cast("long")
    rows = docs.select(key.alias("doc_id"), F.coalesce(key, F.lit(LAST)).alias("o"), F.xxhash64(t).alias("t1"), F.xxhash64(F.lit(7), t).alias("t2"), t.cast("binary").alias("part"))
    spark = docs.sparkSession
    name = f"sparkloom_stretches_{uuid.uuid4().hex}"
    made = rows.mapInArrow(run, TABLE)
    made.write.format("parquet").option("compression", "zstd").option("path", f"{shared_dir(spark)}/sparkloom/{name}").bucketBy(partitions(spark), "g").saveAsTable(name)
    return spark.table(name), name


def _facts(table: DataFrame) -> DataFrame:
    """``g, b, facts``: for every document of a stretch its place in the order of documents, null for later copies of a text."""
    keys = table.select("g", "b", F.posexplode(F.arrays_zip("o", "t1", "t2")).alias("i", "k")).select("g", "b", "i", "k.*")
    first = keys.groupBy("t1", "t2").agg(F.min("o").alias("first"))
    # numbers rise from range to range; written once, so they stay
    placed = stored(first.repartitionByRange("first", "t1", "t2").sortWithinPartitions("first", "t1", "t2").withColumn("r", F.monotonically_increasing_id()), keep="order")
    found = keys.join(placed, ["t1", "t2"]).select("g", "b", F.struct("i", F.when(F.col("o") == F.col("first"), F.col("r")).alias("r")).alias("f"))
    facts = stored(found.groupBy("g", "b").agg(F.sort_array(F.collect_list("f")).alias("facts")).select("g", "b", "facts.r"), keep="facts")
    discard(placed)
    return facts


def _answered(table: DataFrame, answers: DataFrame, facts: DataFrame) -> DataFrame:
    """The stretches with their facts and the answers ``(range, hits)`` to them; only the answers move."""
    n = partitions(table.sparkSession)
    at = [F.col("g").alias("g_"), F.col("b").alias("b_")]
    both = answers.select(*at, F.struct("range", "hits").alias("a"), F.lit(None).cast("array<bigint>").alias("r")).unionByName(facts.select(*at, F.lit(None).cast("struct<range:int,hits:binary>").alias("a"), "r"))
    packed = both.repartition(n, "g_").groupBy("g_", "b_").agg(F.collect_list("a").alias("answers"), F.max("r").alias("r"))  # of one stretch
    # one equality, on what both are dealt by; the other is left to a filter of the join
    return table.join(packed, (F.col("g") == F.col("g_")) & (F.col("b") - F.col("b_") == 0))


class _Stretch:
    """The words of a stretch, as hashes of runs."""

    def __init__(self, row: dict[str, pa.Array], length: int):
        self.block = length // 2
        data, offsets = text_bytes(row["part"])
        hashes, _, self.at = words(data, offsets, lower=False)
        self.count = np.diff(self.at)
        self.document = np.repeat(np.arange(len(self.count)), self.count)
        self.place = np.arange(len(hashes)) - self.at[self.document]
        self.left = self.count[self.document] - self.place
        self.runs, self.second = (self._runs(hashes, self.block, U(k)) for k in (0xD6E8FEB86659FD93, 0x9FB21C651E98DF25))

    @staticmethod
    def _runs(hashes: np.ndarray, size: int, k: np.uint64) -> np.ndarray:
        padded = np.append(hashes, np.zeros(size, U))
        total = np.zeros(len(hashes), U)
        for j in range(size):
            total = total * k + padded[j : j + len(hashes)]
        return mix(total)

    def probes(self, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of all runs of a block's length, their names (range and 31 bits), and which are reference blocks."""
        at = np.flatnonzero(self.left >= self.block)
        name = (self.runs[at] >> U(32)) % U(ranges) << U(32) | self.runs[at] & U(0xFFFFFFFE)
        return at, name, self.place[at] % self.block == 0

    def windows(self, length: int, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of windows (of all, or those of a mask), and two hashes of each from the runs at its ends."""
        fits = self.left >= length
        at = np.flatnonzero(fits if among is None else fits & among)
        far = at + length - self.block
        return at, mix(self.runs[at] * U(0xA0761D6478BD642F) + self.runs[far]), mix(self.second[at] * U(0xE7037ED1A0B428DB) + self.second[far])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Stretches one by one: numbers as values, lists as the arrays in them."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {}
            for name in batch.schema.names:
                c = column(batch, name)
                row[name] = c[i].values if pa.types.is_list(c.type) else c[i].as_py()
            yield row


def _packs(g: int, b: int, name: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """One row for each range that occurs in ``name`` (sorted), with its share of ``values`` as bytes."""
    starts = np.flatnonzero(np.append(True, name[1:] != name[:-1])[: len(name)])
    edges = (np.append(starts, len(name)) * values.dtype.itemsize).astype(np.int32)
    packed = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(values))])
    n = len(starts)
    return pa.RecordBatch.from_arrays([pa.array(name[starts].astype(np.int32)), pa.array(np.full(n, g, np.int32)), pa.array(np.full(n, b, np.int32)), packed], ["range", "g", "b", "packed"])


def _grouped(sorted_values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1])[: len(sorted_values)])


def _sent(table: DataFrame, length: int, ranges: int) -> DataFrame:
    """``range, g, b, packed``: names of the runs of each stretch, each once, with its lowest bit set for reference blocks and for runs that the stretch repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = np.zeros(0, U)
        for row in _rows(batches):
            _, name, index = _Stretch(row, length).probes(ranges)
            order = np.argsort(name, kind="stable")
            name, index = name[order], index[order]
            heads = _grouped(name)
            if not len(heads):
                continue
            again = np.diff(np.append(heads, len(name))) > 1
            name, index = name[heads], np.logical_or.reduceat(index, heads) | again
            # repeats are settled here; they are evidence for other stretches, and one of them is enough
            known = again & np.isin(name, told)
            told = np.append(told if len(told) < SENT else told[:0], name[again & ~known])
            name, index = name[~known], index[~known]
            if len(name):
                yield _packs(row["g"], row["b"], (name >> U(32)).astype(np.int64), (name.astype(np.uint32) | index).astype("<u4"))

    return table.select("g", "b", "part").mapInArrow(run, "range int, g int, b int, packed binary")


def _hits(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """Probes of the index of one range: the names that an index entry and another stretch's entry share."""
    sizes = group.packed.map(len).to_numpy() // 4
    values = np.frombuffer(b"".join(group.packed), "<u4")
    source = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(values >> 1, kind="stable")
    values, source = values[order], source[order]
    heads = _grouped(values >> 1)
    hit = np.logical_or.reduceat(values & 1, heads) & (np.diff(np.append(heads, len(values))) > 1)
    keep = np.repeat(hit, np.diff(np.append(heads, len(values))))
    values, source = values[keep] & np.uint32(0xFFFFFFFE), source[keep]
    order = np.argsort(source, kind="stable")
    parts = np.split(values[order], np.flatnonzero(np.diff(source[order])) + 1) if len(values) else []
    rows = source[order][np.cumsum([0, *map(len, parts)])[:-1]] if len(values) else []
    return pd.DataFrame({"range": group["range"].to_numpy()[rows], "g": group.g.to_numpy()[rows], "b": group.b.to_numpy()[rows], "hits": [p.tobytes() for p in parts]})


def _ranks(row: dict) -> np.ndarray:
    """Each document's place in the order of documents; -1 for later copies of a text."""
    return row["r"].fill_null(-1).to_numpy(zero_copy_only=False)


def _extended(answered: DataFrame, length: int, ranges: int) -> DataFrame:
    """``range, g, b, packed``: the smallest place of each window that holds a hit, for each stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            stretch, rank = _Stretch(row, length), _ranks(row)
            at, name, _ = stretch.probes(ranges)
            _, inverse, number = np.unique(name, return_inverse=True, return_counts=True)
            hit = number[inverse] > 1
            answers = row["answers"]
            if len(answers):
                shared = [np.frombuffer(h, "<u4").astype(U) | U(r) << U(32) for r, h in zip(answers.field("range").to_pylist(), answers.field("hits").to_pylist())]
                hit |= np.isin(name, np.concatenate(shared))
            upto = np.zeros(len(stretch.runs) + stretch.block + 1, np.int64)
            upto[at[hit] + 1] = 1
            upto = np.cumsum(upto)
            near = upto[stretch.block :][: len(stretch.runs)] > upto[: len(stretch.runs)]  # a hit starts within a block's length; those of the next document only add candidates
            at, w, x = stretch.windows(length, near & (rank >= 0)[stretch.document])
            if not len(at):
                continue
            r = rank[stretch.document[at]]
            p = stretch.place[at] + (row["base"].to_numpy() - row["lead"].to_numpy())[stretch.document[at]]
            to = (w >> U(32)) % U(ranges)
            order = np.lexsort((p, r, x, w, to))
            w, x, r, p, to = w[order], x[order], r[order], p[order], to[order]
            first = np.append(True, (w[1:] != w[:-1]) | (x[1:] != x[:-1]))
            out = np.empty(int(first.sum()), PACKED)
            out["w"], out["x"], out["r"], out["p"] = w[first], x[first].astype(np.uint32), r[first], p[first]
            yield _packs(row["g"], row["b"], to[first].astype(np.int64), out)

    return answered.select("g", "b", "part", "base", "lead", "answers", "r").mapInArrow(run, "range int, g int, b int, packed binary")


def _later(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """Windows of one range that start earlier in another stretch."""
    sizes = group.packed.map(len).to_numpy() // PACKED.itemsize
    values = np.frombuffer(b"".join(group.packed), PACKED)
    source = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((values["p"], values["r"], values["x"], values["w"]))
    values, source = values[order], source[order]
    head = np.append(True, (values["w"][1:] != values["w"][:-1]) | (values["x"][1:] != values["x"][:-1]))
    least = np.flatnonzero(head)[np.cumsum(head) - 1]
    later = (values["r"] != values["r"][least]) | (values["p"] != values["p"][least])
    values, source = values["w"][later], source[later]
    order = np.argsort(source, kind="stable")
    parts = np.split(values[order], np.flatnonzero(np.diff(source[order])) + 1) if len(values) else []
    rows = source[order][np.cumsum([0, *map(len, parts)])[:-1]] if len(values) else []
    return pd.DataFrame({"range": group["range"].to_numpy()[rows], "g": group.g.to_numpy()[rows], "b": group.b.to_numpy()[rows], "hits": [p.tobytes() for p in parts]})


ANSWER = "range int, g int, b int, hits binary"


def _removed(answered: DataFrame, length: int) -> DataFrame:
    """The words that stay of every document or part of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            stretch, rank = _Stretch(row, length), _ranks(row)
            copy = (rank < 0)[stretch.document]
            at, w, x = stretch.windows(length, ~copy)
            order = np.lexsort((at, rank[stretch.document[at]], x, w))  # places of a document rise
            head = np.append(True, (w[order][1:] != w[order][:-1]) | (x[order][1:] != x[order][:-1]))[: len(at)]
            least = order[np.flatnonzero(head)[np.cumsum(head) - 1]] if len(at) else order
            again = np.zeros(len(at), bool)
            # rows that repeat a document have equal windows at equal places
            again[order] = (rank[stretch.document[at[order]]] != rank[stretch.document[at[least]]]) | (stretch.place[at[order]] != stretch.place[at[least]])
            hits = row["answers"].field("hits").to_pylist() if len(row["answers"]) else []
            if hits:
                again |= np.isin(w, np.frombuffer(b"".join(hits), "<u8"))
            edge = np.bincount(at[again], minlength=len(copy) + 1) - np.bincount(at[again] + length, minlength=len(copy) + 1)
            keep = (np.cumsum(edge[:-1]) == 0) & ~(copy & (stretch.count[stretch.document] >= length))
            lead, own = row["lead"].to_numpy(), row["own"].to_numpy()
            begin = stretch.at[:-1] + lead
            end = np.where(own < 0, stretch.at[1:], begin + own)
            kept = np.append(0, np.cumsum(keep))
            number = kept[end] - kept[begin]
            texts = []
            for raw, a, b, m, first in zip(row["part"].to_pylist(), begin.tolist(), end.tolist(), number.tolist(), lead.tolist()):
                said = raw.split()[first : first + b - a] if m else []
                texts.append(b" ".join(said if m == b - a else compress(said, keep[a:b].tolist())))
            n = len(texts)
            cols = [pa.array(np.full(n, row["g"], np.int32)), row["number"], row["base"], row["doc_id"], pa.array(end - begin), pa.array(end - begin - number), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["g", "number", "base", "doc_id", "n_words", "n_removed", "kept"])

    return answered.select("g", "number", "base", "lead", "own", "doc_id", "part", "answers", "r").mapInArrow(run, RESULT)


def remove_repeats(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, stretch: int = STRETCH, range_bytes: int = RANGE) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept`` (the remaining words, joined by a space) for every row."""
    if length < 2:
        raise ValueError("a window has two words at least")
    spark = docs.sparkSession
    table, name = _table(docs, text, doc_id, length, stretch)
    total = table.agg(F.sum("size")).first()[0] or 0
    ranges = max(1, -(-total // range_bytes))
    facts = _facts(table)
    hits = _sent(table, length, ranges).groupBy("range").applyInPandas(_hits, ANSWER)
    windows = _extended(_answered(table, hits, facts), length, ranges)
    later = stored(windows.groupBy("range").applyInPandas(_later, ANSWER), keep="later")
    short, long = (_removed(_answered(table.filter(f), later, facts), length) for f in ("not long", "long"))
    whole = long.groupBy("g", "number").agg(F.first("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in ("n_words", "n_removed")), F.sort_array(F.collect_list(F.struct("base", "kept"))).alias("parts"))  # of one text
    pieces = F.filter(F.transform("parts", lambda p: p.kept), lambda p: p != "")
    out = short.select("doc_id", "n_words", "n_removed", "kept").unionByName(whole.select("doc_id", "n_words", "n_removed", F.array_join(pieces, " ").alias("kept")))
    return out


#: The result of ``op12`` in DuckDB's SQL.
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(doc_id, {LAST}) AS o, coalesce(text, '') AS text, md5(coalesce(text, '')) AS m FROM documents),
one AS (SELECT o, m, regexp_extract_all(any_value(text), '[^\x20\x09-\x0D]+') AS w FROM d GROUP BY o, m),
win AS (SELECT o, m, p, md5(array_to_string(w[p:p + {LENGTH - 1}], ' ')) AS h FROM (SELECT *, unnest(range(1, greatest(len(w) - {LENGTH - 2}, 1))) AS p FROM one)),
late AS (SELECT o, m, p FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY o, m, p) AS k FROM win) WHERE k > 1),
gone AS (SELECT o, m, list(DISTINCT q) AS g FROM (SELECT o, m, unnest(range(p, p + {LENGTH})) AS q FROM late) GROUP BY o, m),
res AS (SELECT one.o, one.m, len(w) AS n_words, coalesce(len(g), 0) AS n_removed, array_to_string(CASE WHEN g IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(g, i)), lambda i: w[i]) END, ' ') AS kept FROM one LEFT JOIN gone USING (o, m))
SELECT d.doc_id, n_words, n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d JOIN res USING (o, m)
"""
