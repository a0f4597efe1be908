"""Connected components of an edge table by large and small stars, all in Spark; no edge or label reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import join_counted, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of edges (u, v): label is the smallest node of its component.

    Each round first links every larger neighbour of a node to the node's smallest neighbour, then every smaller one;
    the number of rounds grows with the logarithm of the longest path. It ends when the edges are stars: every node
    has one smaller neighbour at most, and none that has one is a smaller neighbour itself. A node with very many
    neighbours is only ever reduced to a minimum (combined before the shuffle), and its minimum is sent to their rows.
    """
    now = stored(edges.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).filter("a <> b").distinct(), "components")
    while True:
        ends = now.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("b").alias("a"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if not ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)").take(1):
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m"), F.sum(F.expr("cast(b > a as long)")).alias("n_rows")).withColumn("m", F.least("a", "m")), "components-least")
        large = join_counted(both.filter("b > a"), least, ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = stored(large, "components-large")
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a")
        now = stored(small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), "components")
    tails = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return tails.unionByName(tails.select(F.col("label").alias("node"), "label").distinct())
