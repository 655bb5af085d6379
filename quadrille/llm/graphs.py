"""Connected components of links, by alternating large and small stars (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import removed, table


def components(links: DataFrame) -> DataFrame:
    """links: (a, b). Returns (id, root) of every id in a link between two ids: root is the smallest id reachable.

    A node of many links sends rows through joins whose skew Spark splits, never
    through one task's memory.
    """
    links = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links, path = table(links)
    before = None
    while True:
        # Large star: each neighbour above n links to the least of n and its neighbours.
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # Small star: u and its neighbours below it link to the least of these.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        below = large.join(least, "u")
        small = below.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))
        last = path
        links, path = table(small.where("u != v").distinct())
        removed(links.sparkSession, last)
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    roots = links.select("v").distinct().select(F.col("v").alias("id"), F.col("v").alias("root"))
    return links.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots)
