"""What can be done with a result, the relation (cell, item_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flattened(pairs: DataFrame) -> DataFrame:
    return pairs.select("item_id").distinct()


def classified(pairs: DataFrame, totals: DataFrame) -> DataFrame:
    """(cell, is_full, n_items): a cell is full if the result has all its items."""
    counts = pairs.groupBy("cell").agg(F.count("*").alias("n_items"))
    return counts.join(totals, "cell").select("cell", (F.col("n_items") == F.col("n_total")).alias("is_full"), "n_items")


def cell_results(pairs: DataFrame, totals: DataFrame) -> DataFrame:
    """(cell, is_full, items): sorted items of partial cells, null for full ones, whose items are never collected."""
    cells = classified(pairs, totals)
    partial = cells.where(~F.col("is_full")).select("cell")
    lists = pairs.join(partial, "cell", "left_semi").groupBy("cell").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    return cells.join(lists, "cell", "left").select("cell", "is_full", "items")


def cell_result_rows(pairs: DataFrame, totals: DataFrame) -> DataFrame:
    """(cell, is_full, item_id): the same as plain rows, one for each full cell (null item) and each item of a partial one."""
    cells = classified(pairs, totals)
    full = cells.where("is_full").select("cell", "is_full", F.lit(None).cast("long").alias("item_id"))
    partial = pairs.join(cells.where(~F.col("is_full")).select("cell", "is_full"), "cell").select("cell", "is_full", "item_id")
    return full.unionByName(partial)


def all_items(cells: DataFrame, pci: DataFrame, key: str) -> DataFrame:
    """Full-match conversion: every item of each cell."""
    everything = pci.select(F.col(key).alias("cell"), "item_id").distinct()
    return everything.join(cells.select("cell").distinct(), "cell", "left_semi")


def result_size(pairs: DataFrame) -> DataFrame:
    """(n_pairs, n_cells, n_items), one row."""
    return pairs.agg(F.count("*").alias("n_pairs"), F.count_distinct("cell").alias("n_cells"), F.count_distinct("item_id").alias("n_items"))
