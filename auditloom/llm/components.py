"""Connected components by alternating stars, without collecting links or components anywhere.

A star's centre may have a third of all edges, so joins on a node are split by degree: nodes with more than ``2 * edges / HUBS`` edges, of
which there are fewer than ``HUBS``, are broadcast with their smallest neighbour; the edges of all others are shuffled, no node having more than its
share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.support import discard, materialize

HUBS = 100_000  # nodes broadcast at most; degrees sum to twice the edges
LIGHT = 64  # edges of a node that no split is worth


def _with_least(ends: DataFrame, least: DataFrame, edges: int) -> DataFrame:
    """``ends`` (u, v) with the m of ``least`` (u, m, degree), a written table, for each u."""
    limit = max(LIGHT, 2 * edges // HUBS)
    hubs = F.broadcast(least.where(F.col("degree") > limit).select("u", "m"))  # fewer than HUBS rows
    light = ends.join(hubs.select("u"), "u", "left_anti").join(least.where(F.col("degree") <= limit).select("u", "m"), "u")
    return ends.join(hubs, "u").unionByName(light)


def _large_star(edges: DataFrame, count: int) -> DataFrame:
    """Tie each node's larger neighbours to its smallest one."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("degree")), "least")
    return _with_least(both.where("v > u"), least, count).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, count: int) -> DataFrame:
    """Tie each node and its smaller neighbours to the smallest of them."""
    least = materialize(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree")), "least")
    tied = _with_least(edges, least, count).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v")))


def _print(edges: DataFrame) -> tuple:
    """The number of edges and a sum that changes with any of them."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) of each node of ``links`` (a, b), where the component is its smallest node; materialised.

    Each round is a few joins of edge tables on a node; the rounds number about the logarithm of the longest path.  Links of a node to itself
    or to null count for nothing, and no links give no rows.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialize(edges, "edges")
    before = _print(edges)
    while before[0]:
        large = materialize(_large_star(edges, before[0]).distinct(), "edges")
        turned = materialize(_small_star(large, before[0]).distinct(), "edges")
        after = _print(turned)
        discard(edges)
        discard(large)
        edges, same = turned, after == before
        if same:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
