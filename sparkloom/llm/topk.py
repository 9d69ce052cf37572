"""Exact top-k inner products with an impact-ordered, score-at-a-time index.

A component c of a vector in dimension d has the impact q * c for a query with
weight q there. The index of a shard keeps, for each dimension, postings in
segments of equal quantised value, so all of a segment has one quantised impact.
For a query, each dimension's least impact is the floor that every vector gets
from the start, and segments are processed by descending gain over it (for a
block of queries, the largest gain that any of them has): a segment adds its gain
to the scores of its vectors. What no segment has added yet is
bounded by the next gain of each dimension.

After every stretch of segments, the vectors that look best are scored exactly;
the k-th best of these sure scores is a threshold. Processing stops only where
the bounds prove that all but a few possible members stay below it. Those are
then scored exactly.

Vectors are dealt to shards of bounded size, each of which is indexed once; the
queries then stream through it in blocks. A shard is dealt to several tasks only
where there are very many queries. At most k rows for each query come from a
shard, and the best of them are the result.

Defined results: vectors that are null or empty, or hold null or non-finite
components, take no part, neither do rows with a null vec_id. Vectors with a large
component (``NARROW``) or very many are left out of the index and scored apart
with exact integers. A score outside the range of a long is the nearest long, and
ranks as such; ``scale`` times a component beyond the doubles is the largest
double. Vectors score only with vectors of their length. Ties go to the smaller
vec_id. Rows that repeat a vec_id are candidates of their own, but not of the
queries of that id; each different vector of a query's id has its own ranks, and
rows alike in both are one query. An empty table gives no rows. Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, stored

K = 20
#: Vectors of a shard (fewer, if they have more than ``VALUES`` components in all), queries of a block, and queries for which a shard is dealt once.
SHARD, VALUES, BLOCK, DEAL = 8192, 1 << 19, 256, 1 << 16
#: Components of indexed vectors are smaller, so that sums of up to ``LENGTHS`` products fit a long.
NARROW, LENGTHS = 2.0**24, 8192
LARGEST = float(np.finfo(np.float64).max)
LOW, HIGH = -(1 << 63), (1 << 63) - 1
#: Values that share a segment.
LEVEL = 4
#: Parts of the segments after which it is tried to stop, for possible members of at most one FEW-th of the shard.
CHECKS, FEW = (0.4, 0.6, 0.8, 0.9, 1.0), 16


class Shard:
    """Postings of a shard's vectors, by dimension and quantised value."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, level: int = LEVEL):
        self.vectors, self.ids, self.level = vectors, ids, level
        codes = np.floor_divide(vectors, level)
        self.postings: list[np.ndarray] = []
        starts, code = [], []
        for d in range(vectors.shape[1]):
            order = np.argsort(codes[:, d], kind="stable")
            own = codes[order, d]
            cuts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            starts.append(len(self.postings))
            self.postings += np.split(order, cuts[1:])
            code += own[cuts].tolist()
        self.starts, self.code = np.array(starts), np.array(code, np.int64)
        self.dimension = np.repeat(np.arange(len(starts)), np.diff([*starts, len(code)]))

    def best(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (a row of weights): ids and exact scores of its k best vectors (ties: smaller id) without those of its ``own`` id.

        The queries share one order of segments, by the largest gain that any of
        them has, so that a segment's postings are read once for all.
        """
        low, n = self.code * self.level, len(self.vectors)
        q = queries[:, self.dimension].T
        impact = np.maximum(q * low[:, None], q * (low + self.level - 1)[:, None])  # the most that a value of the segment gives
        floor = np.minimum.reduceat(impact, self.starts, axis=0)
        gain = impact - floor[self.dimension]
        most = np.abs(floor).sum(0).max(initial=0) + np.maximum.reduceat(gain, self.starts, axis=0).sum(0).max(initial=0)
        gain = gain.astype(np.int32 if most < 2**29 else np.int64)
        order = np.argsort(-gain.max(axis=1), kind="stable")
        score = np.repeat(floor.sum(0)[None, :].astype(gain.dtype), n, axis=0)
        mine = self.ids[:, None] == own
        score[mine] = np.iinfo(score.dtype).min // 2
        number = n - mine.sum(0)
        need = np.full(len(queries), np.iinfo(np.int64).min // 4)
        done = 0
        for part in CHECKS:
            for s in order[done : int(len(order) * part)].tolist():
                score[self.postings[s]] += gain[s]
            done = int(len(order) * part)
            left = gain.copy()
            left[order[:done]] = 0
            still = np.maximum.reduceat(left, self.starts, axis=0).sum(0)
            if n > k:
                ahead = np.argpartition(score, n - k, axis=0)[n - k :]  # k vectors: the least of their exact scores is sure
                sure = np.einsum("kqd,qd->kq", self.vectors[ahead], queries).min(0)
                need = np.where(number > k, np.maximum(need, sure), need)
            possible = score + still >= need
            if possible.sum(0).max(initial=0) <= max(4 * k, n // FEW):
                break
        out = []
        for j, weight in enumerate(queries):
            rows = np.flatnonzero(possible[:, j] & ~mine[:, j])
            exact = self.vectors[rows] @ weight
            take = np.lexsort((self.ids[rows], -exact))[:k]
            out.append((self.ids[rows][take], exact[take]))
        return out


class Held:
    """A shard's vectors, and the queries' best among them."""

    def __init__(self, size: int):
        self.size = size
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.wide: list[tuple[int, list[int]]] = []
        self.index: Shard | None = None
        self.exact: tuple[np.ndarray, np.ndarray] | None = None

    def add(self, rows: pa.RecordBatch) -> None:
        ids, narrow, wide = _split(rows, self.size)
        self.parts.append((ids[: len(narrow)], narrow))
        self.wide += zip(ids[len(narrow) :].tolist(), wide)

    def best(self, rows: pa.RecordBatch, k: int) -> list[tuple[int, list[tuple[int, int]]]]:
        """For each query of ``rows``: its number, and (score, id) of its k best."""
        if self.index is None and any(len(i) for i, _ in self.parts):
            self.index = Shard(np.concatenate([v for _, v in self.parts]), np.concatenate([i for i, _ in self.parts]))
        _, narrow, wide = _split(rows, self.size)
        valid = np.asarray(rows.column("v").is_valid())
        own, number = (np.concatenate([np.asarray(rows.column(c))[valid], np.asarray(rows.column(c))[~valid]]) for c in ("vec_id", "number"))
        out = []
        indexed = self.index.best(narrow, own[: len(narrow)], k) if self.index is not None and len(narrow) else [(np.zeros(0, np.int64),) * 2] * len(narrow)
        for j, (found, score) in enumerate(indexed):
            got = list(zip(score.tolist(), found.tolist()))
            if self.wide:
                query = narrow[j].tolist()
                got = _top([*got, *((_inner(query, v), i) for i, v in self.wide if i != own[j])], k)
            out.append((int(number[j]), got))
        if wide and self.exact is None:
            ids = np.concatenate([np.zeros(0, np.int64), *(i for i, _ in self.parts)])
            self.exact = ids, np.concatenate([np.zeros((0, self.size), np.int64), *(v for _, v in self.parts)]).astype(object)
        for j, query in enumerate(wide, len(narrow)):
            ids, vectors = self.exact
            scored = zip(map(_long, vectors.dot(np.array(query, object)).tolist() if len(ids) else []), ids.tolist())
            out.append((int(number[j]), _top([x for x in [*scored, *((_inner(query, v), i) for i, v in self.wide)] if x[1] != own[j]], k)))
        return out


def _split(rows: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """Ids (those of narrow vectors first), narrow vectors as rows, and wide ones as exact integers."""
    valid = np.asarray(rows.column("v").is_valid())
    ids = np.asarray(rows.column("vec_id"))
    narrow = np.asarray(rows.column("v").drop_null().flatten()).reshape(-1, size).astype(np.int64)
    wide = [[int(x) for x in v] for v in rows.column("w").drop_null().to_pylist()]
    return np.concatenate([ids[valid], ids[~valid]]), narrow, wide


def _long(score: int) -> int:
    return min(max(score, LOW), HIGH)


def _inner(a: list[int], b: list[int]) -> int:
    return _long(sum(x * y for x, y in zip(a, b)))


def _top(found: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
    return sorted(found, key=lambda x: (-x[0], x[1]))[:k]


def quantised(vectors: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """``vec_id``, ``size``, and floor(scale * x) of every vector that takes part, in ``v`` if it is narrow, else as whole doubles in ``w``."""
    finite = F.forall(F.col(embedding), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.filter(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & (F.size(embedding) > 0)).filter(F.coalesce(finite, F.lit(False)))
    scaled = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.size(embedding).alias("size"), F.transform(embedding, lambda x: x.cast("double") * scale).alias("x"))
    narrow = F.forall("x", lambda x: F.abs(x) < NARROW) & (F.col("size") <= LENGTHS)
    whole = F.transform("x", lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(F.greatest(F.least(x, F.lit(LARGEST)), F.lit(-LARGEST))))
    return scaled.select("vec_id", "size", F.when(narrow, F.transform("x", lambda x: F.floor(x).cast("int"))).alias("v"), F.when(~narrow, whole).alias("w"))


def search(vectors: DataFrame, is_query: Column, *, k: int = K, scale: int = 64, vec_id: str = "vec_id", embedding: str = "embedding", shard: int = SHARD, block: int = BLOCK, deal: int = DEAL) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``; ``is_query`` is a condition on ``vec_id``."""
    # rows alike are one with a count before they are dealt; more than k of them show in no result
    rows = quantised(vectors, vec_id, embedding, scale).groupBy("vec_id", "size", "v", "w").agg(F.count("*").alias("copies"))
    rows = stored(rows, keep="vectors")  # read for the counts, as candidates and as queries
    asked = rows.filter(is_query)
    counts = rows.agg(F.sum("copies").alias("n"), F.count_if(is_query).alias("q"), F.max("size").alias("size")).first()
    shards = max(1, -(-(counts.n or 0) // max(1, min(shard, VALUES // (counts.size or 1)))))
    deals = max(1, -(-counts.q // deal))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    copy = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)).cast("int"))))
    near = copy.select("vec_id", "size", "v", "w", F.pmod(F.xxhash64("vec_id", "v", "w", "copy"), F.lit(shards)).cast("int").alias("shard"), every(deals).alias("deal"), F.lit(None).cast("long").alias("number"))
    number = F.xxhash64("vec_id", "v", "w")
    far = asked.select("vec_id", "size", "v", "w", every(shards).alias("shard"), F.pmod(number, F.lit(deals)).cast("int").alias("deal"), number.alias("number"))
    place = ["size", "shard", "deal"]
    tasks = max(partitions(vectors.sparkSession), min(4 * shards * deals, 1 << 14))
    dealt = near.unionByName(far).repartition(tasks, *place).sortWithinPartitions(*place, F.col("number").isNotNull(), "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = None, None
        for batch in batches:
            facts = np.stack([*(np.asarray(batch.column(c)).astype(np.int64) for c in place), np.asarray(batch.column("number").is_valid()).astype(np.int64)])
            cuts = [0, *(np.flatnonzero((facts[:, 1:] != facts[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if at != (now := tuple(facts[:3, a].tolist())):
                    held, at = Held(now[0]), now
                if not facts[3, a]:
                    held.add(batch.slice(a, b - a))
                    continue
                for x in range(a, b, block):
                    rows = batch.slice(x, min(block, b - x))
                    own = dict(zip(rows.column("number").to_pylist(), rows.column("vec_id").to_pylist()))
                    found = [(own[q], q, i, score) for q, got in held.best(rows, k) for score, i in got]
                    columns = zip(*found) if found else [[]] * 4
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "number", "vec_id", "score"])

    met = dealt.select("vec_id", "size", "v", "w", "shard", "deal", "number").mapInArrow(run, "query_id long, number long, vec_id long, score long")
    order = Window.partitionBy("query_id", "number").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The result of ``op5`` in DuckDB's SQL.
ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 20 = 0),
s AS (SELECT q.vec_id AS query_id, q.v, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM q JOIN v c ON c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, v ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
