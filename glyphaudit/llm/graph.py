"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphaudit.llm.common import Scratch, release


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """``node, root`` for every node in ``links(a, b)``; root is the least node reachable.

    Each step turns edges towards the least neighbour; no neighbour list is ever gathered. The
    number of rounds grows with the logarithm of the longest path. Every round's edges are
    written to the shared folder, so a lost executor repeats one step.
    """
    spark, scratch = links.sparkSession, Scratch(links.sparkSession, name)
    edges = scratch.put(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "0")
    for k in range(1, 64):
        # Nothing is left to turn once every node has one edge to a node that has none itself.
        ends = edges.select(F.col("u").alias("node"), "v").union(edges.select(F.col("v").alias("node"), F.lit(None).cast("long")))
        ends = ends.groupBy("node").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("out"), F.count("*").alias("all"))
        if not ends.agg(F.max(F.expr("lo <> hi OR (out > 0 AND out < all)"))).first()[0]:
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = scratch.put(large, f"large{k}")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = scratch.put(small, str(k))
        scratch.drop(str(k - 1), f"large{k}")
    release(spark)
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))
