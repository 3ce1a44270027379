"""Connected components by alternating stars over written edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lastro.session import written


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of an undirected graph (a, b), roots being the least node of each component.

    Each round works on minima per node, which are summed before the shuffle, so a node with very many edges costs no more
    than its edges; what a round leaves is written, so lost executors cost no recomputation. Rounds grow with the logarithm
    of the longest path. Loops and repeated edges are dropped; an empty graph gives no rows.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.where("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        e = written(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return e.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
        before = now
