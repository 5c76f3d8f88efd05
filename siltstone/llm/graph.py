"""Connected components of a distributed graph by alternating large-star and small-star rounds.

A round is two grouped minima and two joins over the edges; no node's neighbours are ever gathered, and edges,
labels and components stay in the cluster. The minima are written before they are joined, so that both sides of a
join are plain shuffles, of which adaptive execution can split a node with very many neighbours. Lineage is cut
in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch


def _least(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """The least neighbour ``m`` of each node ``k`` that has a smaller one."""
    return scratch.keep(edges.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")))


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the edges ``(a, b)``; the root is the least node of the component.

    Self-loops, repeated and reversed edges are allowed; no edges give no rows. Nodes are of any type with an order.
    """
    ends = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    held = scratch.keep(ends)  # edges (u, v) with u > v
    least = _least(scratch, held)
    while held.count() > least.count() or not held.join(least, F.col("v") == F.col("k"), "left_semi").isEmpty():
        # Large: each node hands its larger neighbours to the least node it knows.
        large = scratch.keep(held.join(least, F.col("v") == F.col("k"), "left").select("u", F.coalesce("m", "v").alias("v")).distinct())
        scratch.drop(held, least)
        # Small: each node hands its smaller neighbours and itself to the least of them.
        least = _least(scratch, large)
        handed = large.join(least, F.col("u") == F.col("k")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        held = scratch.keep(handed.unionAll(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct())
        scratch.drop(large, least)
        least = _least(scratch, held)
    stars = held.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionAll(stars.select(F.col("root").alias("node"), "root").distinct())
