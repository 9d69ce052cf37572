"""Connected components of a graph of links, as joins over the links only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _roots(parents: DataFrame) -> DataFrame:
    """Follow ``parent`` (always smaller than ``node``) to its end, doubling the step each time."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        before, parents = parents, stored(parents.select("node", "parent").join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")))
        discard(before)
        if parents.filter("moved").isEmpty():
            return parents


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node of ``links(u, v)``: root is the smallest node that it reaches.

    Each round lets every node that has a smaller neighbour point to the smallest
    one, follows the pointers to their ends, and goes on with the links between
    different ends. A round at least halves the groups that still have links.
    Nodes that no link names are not in the result.
    """
    edges = links.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    found: DataFrame | None = None
    dead: list[DataFrame] = []
    while True:
        edges = stored(edges)
        if edges.isEmpty():
            break
        discard(*dead)
        tops = _roots(edges.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("parent")))
        u, v = (tops.select(F.col("node").alias(x), F.col("parent").alias(f"{x}_top")) for x in "uv")
        step = edges.join(u, "u", "left").join(v, "v").select(F.coalesce("u_top", "u").alias("a"), F.col("v_top").alias("b"))
        dead = [edges, tops]
        if found is None:
            found = stored(tops.select("node", F.col("parent").alias("root")))
        else:
            over = tops.select(F.col("node").alias("root"), F.col("parent").alias("above"))
            moved = found.join(over, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
            fresh = tops.join(found, "node", "left_anti").select("node", F.col("parent").alias("root"))
            dead.append(found)
            found = stored(moved.unionByName(fresh))
        edges = step.filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
    discard(*dead)
    if found is None:
        found = edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
    ends = found.select(F.col("root").alias("node"), "root").distinct().join(found, "node", "left_anti")
    return found.unionByName(ends)


def with_links(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (as of ``components``, stored) with further links: only the roots that these connect are followed again."""
    one, two = (roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "uv")
    ends = stored(links.join(one, "u", "left").join(two, "v", "left").select("u", "v", F.coalesce("ru", "u").alias("a"), F.coalesce("rv", "v").alias("b")), keep="ends")
    apart = ends.filter("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    if apart.isEmpty():  # a link within a component has both ends in ``roots`` already
        discard(ends)
        return roots
    joined = stored(components(apart), keep="joined")
    over = joined.select(F.col("node").alias("root"), F.col("root").alias("above"))
    moved = roots.join(over, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
    # an end that no link named before is its own root so far, so it is a node of ``joined``
    fresh = joined.join(roots.select("node"), "node", "left_anti")
    made = stored(moved.unionByName(fresh.select("node", "root")), keep="roots")
    discard(ends, joined, roots)
    return made
