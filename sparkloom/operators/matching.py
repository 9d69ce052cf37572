"""Greedy matching of token vectors (Zhang et al. 2020): precision, recall and F1 of a candidate against references.

Every token of a text is paired with the most similar token of the other (cosine);
precision is the weighted mean over the candidate's tokens, recall that over the
reference's. Weights are inverse document frequencies over the references. The
network that makes the vectors is not part of it: an embedder runs over texts in
Arrow batches, loaded once for each worker (``embedded``), or vectors come from a
table by token (``from_table``).

Defined results: a text without tokens, or whose tokens all weigh nothing, scores
0.0 (after rescaling too). A vector of length 0 is like no other. Repeated tokens
count as often as they stand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: From a list of token lists to a matrix for each, with a row for each token.
Embedder = Callable[[list[list[str]]], list[np.ndarray]]
VECTORS = "array<struct<w:double,v:array<float>>>"


@lru_cache(4)
def _loaded(load: Callable[[], Embedder]) -> Embedder:
    return load()


def frequencies(texts: DataFrame, tokens: str) -> DataFrame:
    """``token``, ``df`` (texts that hold it) and ``idf``, log((N + 1) / (df + 1)) over ``N`` texts."""
    n = texts.agg(F.count("*")).first()[0]
    counts = texts.select(F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return counts.withColumn("idf", F.log(F.lit(n + 1) / (F.col("df") + 1)))


def counted(texts: DataFrame, key: list[str], tokens: str) -> DataFrame:
    """``key``, ``token``, ``n``: how often each token stands in a text."""
    return texts.select(*key, F.explode(tokens).alias("token")).groupBy(*key, "token").agg(F.count("*").alias("n"))


def from_table(texts: DataFrame, key: list[str], tokens: str, idf: DataFrame, unseen: float, vectors: DataFrame) -> DataFrame:
    """``key`` and ``m``: the weighted vectors of each text's tokens, each token once, from ``vectors(token, v)``.

    The weight of a token is its idf (``unseen`` if no reference has it) times its
    number. Tokens without a vector are left out; a text without any has no row.
    The texts' side of the joins may hold a hot token; the other side has each token once.
    """
    rows = counted(texts, key, tokens).join(idf.select("token", "idf"), "token", "left").join(vectors.select("token", "v"), "token")
    weight = F.coalesce("idf", F.lit(unseen)) * F.col("n")
    return rows.groupBy(*key).agg(F.collect_list(F.struct(weight.alias("w"), F.col("v").cast("array<float>").alias("v"))).alias("m"))  # of one text


def embedded(texts: DataFrame, tokens: str, weights: str, load: Callable[[], Embedder], added: str = "m") -> DataFrame:
    """``texts`` with the weighted vectors of their tokens, in context, made by an embedder.

    ``tokens`` and ``weights`` are arrays of equal length. Only these two columns go to Python.
    """

    @F.pandas_udf(VECTORS)
    def vectors(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for tokens, weights in batches:
            made = _loaded(load)([list(t) if t is not None else [] for t in tokens])
            out = []
            for t, w, matrix in zip(tokens, weights, made):
                n = 0 if t is None else len(t)
                if n != len(matrix) or n != (0 if w is None else len(w)):
                    raise ValueError("an embedder returns one vector for each token, and each has a weight")
                out.append([{"w": float(a), "v": v} for a, v in zip(w if n else [], matrix)])
            yield pd.Series(out, dtype=object)

    return texts.withColumn(added, vectors(tokens, weights))


def _matrix(m: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    """Weights and unit vectors."""
    values = m.values
    if values is None or not len(values):
        return np.zeros(0), np.zeros((0, 1))
    w = values.field("w").to_numpy(zero_copy_only=False)
    v = values.field("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return w, np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def matched(candidate: tuple[np.ndarray, np.ndarray], reference: tuple[np.ndarray, np.ndarray], block: int = 1024) -> tuple[float, float, float] | None:
    """Precision, recall and F1; similarities are made for ``block`` tokens of the candidate at a time. None for a text that weighs nothing."""
    (wc, c), (wr, r) = candidate, reference
    if wc.sum() <= 0 or wr.sum() <= 0:
        return None
    best_c, best_r = np.empty(len(c)), np.full(len(r), -np.inf)
    for a in range(0, len(c), block):
        alike = c[a : a + block] @ r.T
        best_c[a : a + block] = alike.max(axis=1)
        np.maximum(best_r, alike.max(axis=0), out=best_r)
    p, q = float(wc @ best_c / wc.sum()), float(wr @ best_r / wr.sum())
    return p, q, 2 * p * q / (p + q) if p + q else 0.0


def greedy_scores(pairs: DataFrame, candidate: str, reference: str, baseline: float = 0.0) -> DataFrame:
    """``pairs`` with ``precision``, ``recall`` and ``f1`` of two columns of weighted vectors, each rescaled as (x - baseline) / (1 - baseline)."""
    if not baseline < 1:
        raise ValueError("the baseline is below 1")

    @F.arrow_udf("struct<precision:double,recall:double,f1:double>")
    def scores(one: pa.Array, two: pa.Array) -> pa.Array:
        found = [matched(_matrix(x), _matrix(y)) for x, y in zip(one, two)]
        figures = [[0.0 if f is None else (f[k] - baseline) / (1 - baseline) for f in found] for k in range(3)]
        return pa.StructArray.from_arrays([pa.array(x, pa.float64()) for x in figures], ["precision", "recall", "f1"])

    return pairs.withColumn("_s", scores(candidate, reference)).select(*pairs.columns, "_s.*")


def best_matches(items: DataFrame, item: list[str], candidates: DataFrame, references: DataFrame, place: str, baseline: float = 0.0) -> DataFrame:
    """For each of ``items`` the best F1 over its references, and the ``place`` of the first best; 0.0 and null without any.

    ``candidates(item, m)`` has one row an item, ``references(item, place, m)`` one for
    each reference that has vectors.
    """
    pairs = references.select(*item, place, F.col("m").alias("_r")).join(candidates.select(*item, F.col("m").alias("_c")), item)
    scored = greedy_scores(pairs, "_c", "_r", baseline).drop("_c", "_r")
    best = scored.groupBy(*item).agg(F.max("f1").alias("f1"), F.min_by(place, F.struct(-F.col("f1"), F.col(place))).alias(place))
    return items.select(*item).join(best, item, "left").withColumn("f1", F.coalesce("f1", F.lit(0.0)))


def mean_score(scored: DataFrame, score: str = "f1") -> Column:
    """The mean over items; 0.0 without items."""
    return F.coalesce(F.avg(score), F.lit(0.0))
