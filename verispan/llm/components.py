"""Connected components of a graph given as edges, in DataFrame joins and aggregations.

Alternating large-star and small-star steps (Kiveris et al., 2014): each round costs two
aggregations and two joins over the edges, the number of rounds grows with the logarithm
of the longest path, and the lineage is cut by a checkpoint in the shared folder after
every round. No adjacency list is gathered: a node's neighbours meet only in a min().
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verispan.llm.common import checkpointed


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step. edges: (a, b) with a > b, distinct."""
    if large:
        arcs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
    else:
        arcs = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = arcs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    moved = arcs.join(least, "u")
    if large:
        moved = moved.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.filter("v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    return moved.filter("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for each node that has an edge.

    edges: columns a and b of one orderable type; loops and repeats are allowed, null
    ends are ignored. An empty input gives an empty result.
    """
    now = checkpointed(
        edges.filter("a IS NOT NULL AND b IS NOT NULL AND a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    if now.isEmpty():
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    mark = None
    while True:  # each round but the last changes something, and only ever to smaller roots
        now = checkpointed(_star(_star(now, True), False))
        # The forest is final when a round changes nothing; two sums tell that without moving rows.
        seen = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
