"""Comparison of results on different grids, by their items."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Differences of fewer items than this list them.
LISTED = 10


def difference_sizes(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: (equal, n_both, n_only_a, n_only_b) of two results' items."""
    left = a.select("item_id").distinct().withColumn("in_a", F.lit(1))
    right = b.select("item_id").distinct().withColumn("in_b", F.lit(1))
    both = left.join(right, "item_id", "full")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    in_a, in_b = F.col("in_a").isNotNull(), F.col("in_b").isNotNull()
    sizes = both.agg(count(in_a & in_b).alias("n_both"), count(in_a & ~in_b).alias("n_only_a"), count(in_b & ~in_a).alias("n_only_b"))
    return sizes.select((F.col("n_only_a") + F.col("n_only_b") == 0).alias("equal"), "n_both", "n_only_a", "n_only_b")


def difference_matrix(results: dict[str, DataFrame], pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """(a, b, n_different, items): symmetric difference of the items of each two results.

    items is the sorted list where it is shorter than LISTED, else null. One
    aggregate gives each item the mask of the results that have it.
    """
    names = list(results)
    pairs = pairs or list(combinations(names, 2))
    # A DataFrame that stands for several results is evaluated once, with the bits of all.
    bits: dict[int, int] = {}
    for k, name in enumerate(names):
        bits[id(results[name])] = bits.get(id(results[name]), 0) | 1 << k
    rows = None
    for own in {id(x): x for x in results.values()}.values():
        own = own.select("item_id", F.lit(bits[id(own)]).cast("long").alias("bit"))
        rows = own if rows is None else rows.unionByName(own)
    masks = rows.groupBy("item_id").agg(F.bit_or("bit").alias("mask"))
    listed = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(1 << names.index(a)).cast("long").alias("x"), F.lit(1 << names.index(b)).cast("long").alias("y")) for a, b in pairs))
    frame = rows.sparkSession.range(1).select(F.explode(listed).alias("p")).select("p.a", "p.b")
    each = masks.select("item_id", "mask", F.explode(listed).alias("p"))
    each = each.where((F.col("mask").bitwiseAND(F.col("p.x")) != 0) != (F.col("mask").bitwiseAND(F.col("p.y")) != 0)).select("p.a", "p.b", "item_id")
    sizes = each.groupBy("a", "b").agg(F.count("*").alias("n_different"))
    short = sizes.where(F.col("n_different") < LISTED).select("a", "b")
    lists = each.join(F.broadcast(short), ["a", "b"], "left_semi").groupBy("a", "b").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    out = frame.join(sizes, ["a", "b"], "left").join(lists, ["a", "b"], "left")
    n = F.coalesce("n_different", F.lit(0)).cast("long")
    return out.select("a", "b", n.alias("n_different"), F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.col("items")).alias("items"))
