"""Hierarchical results: full and partial pixels of several levels, none above another.

A pixel is full if the result has all (leaf pixel, item) pairs below it. Counting
pairs, not items, matters: an item that the result has in one child alone would
otherwise make the parent full and slip into the other child.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.grid import Grid


def _with_ancestors(leaves: DataFrame, grid: Grid, level: int) -> DataFrame:
    """(leaf, pixel, level) and the other columns, a row for each pixel from the leaf up to the root."""
    up = leaves.withColumnRenamed("pixel", "leaf").withColumn("up", F.explode(F.sequence(F.lit(0), F.lit(level))))
    return up.withColumns({"pixel": grid.ancestor(F.col("leaf"), F.col("up")), "level": F.lit(level) - F.col("up")}).drop("up")


def tree_totals(totals: DataFrame, grid: Grid, level: int) -> DataFrame:
    """(pixel, level, total): pairs below each pixel of every level, from the (cell, n_total) of the leaves."""
    above = _with_ancestors(totals.select(F.col("cell").alias("pixel"), "n_total"), grid, level)
    return above.groupBy("pixel", "level").agg(F.sum("n_total").alias("total"))


def compacted(pairs: DataFrame, tree: DataFrame, grid: Grid, level: int, compact: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """(pixel, level, is_full, items) of a result (cell, item_id) on the grid's pixels of a level; tree is tree_totals'.

    Full pixels are the topmost ones, and have null for items; partial pixels are
    leaves with their sorted items. Without compact, all pixels are leaves. Pairs
    are counted by leaf before the counts spread over levels, and items are listed
    for partial leaves alone. With `by`, pairs hold several results, told apart by
    these columns.
    """
    mine = pairs.select(*by, F.col("cell").alias("pixel"), "item_id")
    counts = mine.groupBy(*by, "pixel").agg(F.count("*").alias("got"))
    above = _with_ancestors(counts, grid, level)
    if not compact:
        above = above.where(F.col("level") == level)
    sums = above.groupBy(*by, "pixel", "level").agg(F.sum("got").alias("g"))
    full = sums.join(tree, ["pixel", "level"]).where("g = total").select(*by, "pixel", "level")
    # With what it does not sort by, so that nothing is pruned or filtered below in one use alone: all uses share the counts' exchange.
    best = above.join(full, [*by, "pixel", "level"])
    best = best.groupBy(*by, "leaf").agg(F.min(F.struct("level", "pixel", "leaf", *by, "got")).alias("b"))
    nodes = best.select(*by, "b.pixel", F.col("b.level").cast("int").alias("level")).distinct()
    nodes = nodes.select("*", F.lit(True).alias("is_full"), F.lit(None).cast("array<bigint>").alias("items"))
    partial = mine.join(best.select(*(f"b.{c}" for c in by), F.col("b.leaf").alias("pixel")), [*by, "pixel"], "left_anti")
    lists = partial.groupBy(*by, "pixel").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    return nodes.unionByName(lists.select(*by, "pixel", F.lit(level).cast("int").alias("level"), F.lit(False).alias("is_full"), "items"))


def merged_partials(nodes: DataFrame, grid: Grid, most: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Partial pixels below level `most` merge into their ancestors of that level, with the union of their items.

    Where an ancestor holds full pixels as well, those stay beside its merged list.
    """
    deep = ~F.col("is_full") & (F.col("level") > most)
    up = F.greatest(F.col("level") - most, F.lit(0))
    lists = nodes.where(deep).select(*by, grid.ancestor(F.col("pixel"), up).alias("pixel"), F.explode("items").alias("item_id")).distinct()
    lists = lists.groupBy(*by, "pixel").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    return nodes.where(~deep).unionByName(lists.select(*by, "pixel", F.lit(most).cast("int").alias("level"), F.lit(False).alias("is_full"), "items"))


def expanded(nodes: DataFrame, pci: DataFrame, grid: Grid, level: int) -> DataFrame:
    """(cell, item_id): the leaf pairs of a hierarchical result whose partial pixels are leaves."""
    everything = pci.select("pixel", "item_id").distinct()
    above = _with_ancestors(everything.select("pixel").distinct(), grid, level).select("leaf", "pixel", "level")
    whole = above.join(nodes.where("is_full").select("pixel", "level"), ["pixel", "level"]).select(F.col("leaf").alias("pixel")).distinct()
    pairs = everything.join(whole, "pixel", "left_semi").unionByName(nodes.where(~F.col("is_full")).select("pixel", F.explode("items").alias("item_id")))
    return pairs.select(F.col("pixel").alias("cell"), "item_id").distinct()


def items(nodes: DataFrame, pci: DataFrame, grid: Grid, level: int) -> DataFrame:
    return expanded(nodes, pci, grid, level).select("item_id").distinct()


def tree_size(nodes: DataFrame, grid: Grid) -> DataFrame:
    """One row: (depth, n_nodes, n_leaves): the deepest level, all pixels with their ancestors, and the pixels themselves."""
    every = nodes.select("pixel", "level", F.explode(F.sequence(F.lit(0), F.col("level"))).alias("up"))
    every = every.select(grid.ancestor(F.col("pixel"), F.col("up")).alias("pixel"), (F.col("level") - F.col("up")).alias("level"), (F.col("up") == 0).cast("long").alias("own"))
    every = every.groupBy("pixel", "level").agg(F.max("own").alias("own"))
    none = F.lit(0)
    return every.agg(F.coalesce(F.max("level"), none).cast("int").alias("depth"), F.count("*").alias("n_nodes"), F.coalesce(F.sum("own"), none).cast("long").alias("n_leaves"))


def region_cost(n_items: Column, tags: Column, key: str = "admin_level") -> Column:
    """Cost of showing a region: less for larger ones, a hundredfold without an administrative level."""
    base = 1.0 / (1.0 + n_items)
    return F.when(F.map_contains_key(tags, key), base).otherwise(base * 100)


def region_cover(pairs: DataFrame, totals: DataFrame, region_cells: DataFrame, regions: DataFrame, cell_items: DataFrame, key: str = "admin_level") -> DataFrame:
    """(kind, id, is_full, n_items): a result on cells, shown by regions where all cells of a region are full.

    A full cell goes to the covering region of most cells, then of least cost, then
    of the smallest id. Cells without one, and partial cells, stand for themselves.
    """
    counts = pairs.groupBy("cell").agg(F.count("*").alias("n")).join(totals, "cell")
    full = counts.where("n = n_total").select(F.col("cell").alias("cell_id"))
    sizes = region_cells.join(full.withColumn("has", F.lit(1)), "cell_id", "left").groupBy("region_id").agg(F.count("*").alias("n_cells"), F.count("has").alias("n_full"))
    n_items = region_cells.join(cell_items, "cell_id").groupBy("region_id").agg(F.count_distinct("item_id").alias("n_items"))
    covering = sizes.where("n_cells = n_full").join(n_items, "region_id").join(regions.select("region_id", "tags"), "region_id")
    covering = covering.withColumn("cost", region_cost(F.col("n_items"), F.col("tags"), key))
    choice = region_cells.join(covering, "region_id").groupBy("cell_id").agg(F.min(F.struct((-F.col("n_cells")).alias("size"), "cost", "region_id", "n_items")).alias("c"))
    shown = choice.select(F.col("c.region_id").alias("id"), F.col("c.n_items").alias("n_items")).distinct()
    single = counts.join(choice.select(F.col("cell_id").alias("cell")), "cell", "left_anti")
    return shown.select(F.lit("region").alias("kind"), "id", F.lit(True).alias("is_full"), "n_items").unionByName(
        single.select(F.lit("cell").alias("kind"), F.col("cell").alias("id"), (F.col("n") == F.col("n_total")).alias("is_full"), F.col("n").alias("n_items"))
    )
