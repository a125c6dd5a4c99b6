"""Connected components of a large graph with DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import saved


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is the smallest node.

    Alternating stars: every node hands its larger neighbours to the smallest
    one it knows, then its smaller ones, until each component is one star.
    Every round is written to the shared checkpoint folder, so the lineage
    stays short; the number of rounds grows with the logarithm of the longest
    path. A node with very many neighbours is only the key of a partial
    minimum and of a plain join, which AQE can split. Self-links and nulls in
    the edges are dropped; an empty graph gives an empty table.
    """
    now = edges.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()
    now = saved(now, "edges")
    before = None
    while True:
        state = now.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if before == tuple(state) or state[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component"))
            ).groupBy("node").agg(F.min("component").alias("component"))
        before = tuple(state)
        now = saved(_small_star(_large_star(now)), "edges")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # every edge runs from the larger to the smaller node
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
