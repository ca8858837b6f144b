"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of a link; root is the smallest node of its component.

    Alternating large-star and small-star steps: links are rewired to ever smaller neighbours until all are
    stars, which one aggregation tells: nobody has two smaller neighbours, or one smaller and one larger. Each step
    is two aggregations, so a node with many links is combined in the map tasks; the links of each step are a table
    in the shared folder. An empty table gives an empty one.
    """
    e = written(links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct(), "links")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(least, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(least.select("u", F.col("m").alias("v")))
        e = written(small.distinct(), "links")
        # a step leaves distinct links from a greater u to a smaller v
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
            e.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        if ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter(
                "down > 1 or down = 1 and up = 1").isEmpty():
            break
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
