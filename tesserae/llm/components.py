"""Connected components as a loop of joins: only counts reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the least node reachable. edges: src and dst of one type, in any direction.

    Alternating large-star and small-star steps, which need a number of rounds that grows with the
    logarithm of the longest path. Each round is written to the shared folder. A node with very
    many neighbours costs one row for each of them in the exchange, never a list: the least
    neighbour is a grouped minimum (combined before the shuffle) joined back, and Spark splits the
    large side of that join.
    """
    e = materialize(edges.select("src", "dst").where("src <> dst").distinct())
    while True:
        # large star: the greater neighbours of each node point to the least node around it
        both = e.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionAll(e.select(F.col("dst"), F.col("src")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        big = both.join(least, "u").where("v > u").select(F.col("v").alias("src"), F.col("m").alias("dst")).distinct()
        big = materialize(big)
        # small star: each node and its smaller neighbours point to the least of them
        down = big.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("src"), F.col("m").alias("dst"))
        nxt = materialize(moved.unionAll(least.select(F.col("u").alias("src"), F.col("m").alias("dst"))).distinct())
        # done when no node is both a root and a child and each child has one root
        left = nxt.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
        open_ = left.where("n > 1").select("src").unionAll(nxt.select(F.col("dst").alias("src")).join(left.select("src"), "src", "left_semi"))
        if open_.isEmpty():
            break
        e = nxt
    return nxt.select(F.col("src").alias("node"), F.col("dst").alias("root")).unionAll(nxt.select(F.col("dst"), F.col("dst")).distinct())
