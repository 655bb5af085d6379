"""Index build: which items lie in which cell and in which pixel.

The core table is pci(pixel, cell_id, item_id), one row for each item with a point
in both. Items are indexed by their points alone, and all steps are equi-joins,
projections and one distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.grid import Grid

#: Side of the squares by which points find the cells that may hold them, in thousandths of a degree.
LOCATE_STEP = 9_000


def located(points: DataFrame, cells: DataFrame, step: int = LOCATE_STEP) -> DataFrame:
    """points(item_id, lat_m, lon_m) with the cell_id of every cell that holds them; cell 0 where none does.

    cells(cell_id, lat_lo, lat_hi, lon_lo, lon_hi) are half-open rectangles. Points
    and cells meet on the squares of a coarse grid by an equi-join, then exactly.
    """
    square = lambda c: F.floor(c / step)
    pieces = cells.select(
        "cell_id",
        *("lat_lo", "lat_hi", "lon_lo", "lon_hi"),
        F.explode(F.sequence(square(F.col("lat_lo")), square(F.col("lat_hi") - 1))).alias("sq_lat"),
    ).withColumn("sq_lon", F.explode(F.sequence(square(F.col("lon_lo")), square(F.col("lon_hi") - 1))))
    at = points.withColumns({"sq_lat": square(F.col("lat_m")), "sq_lon": square(F.col("lon_m"))})
    inside = (
        (at["sq_lat"] == pieces["sq_lat"])
        & (at["sq_lon"] == pieces["sq_lon"])
        & (F.col("lat_m") >= F.col("lat_lo"))
        & (F.col("lat_m") < F.col("lat_hi"))
        & (F.col("lon_m") >= F.col("lon_lo"))
        & (F.col("lon_m") < F.col("lon_hi"))
    )
    found = at.join(pieces, inside, "left").select("item_id", "lat_m", "lon_m", F.coalesce("cell_id", F.lit(0)).cast("long").alias("cell_id"))
    return found


def item_points(items: DataFrame, cells: DataFrame) -> DataFrame:
    """points(item_id, cell_id, lat_m, lon_m) of items(item_id, points array<struct<lat_m, lon_m>>, cells array<long>).

    An item of one cell has all its points there, without a look-up. The points of
    other items are located, and count only for cells that the item lists.
    """
    at = items.select("item_id", F.explode("points").alias("p"), F.col("cells").alias("own")).select("item_id", "p.*", "own")
    single = at.where(F.size("own") == 1).select("item_id", F.col("own")[0].alias("cell_id"), "lat_m", "lon_m")
    several = at.where(F.size("own") != 1)
    place = located(several.select("item_id", "lat_m", "lon_m").distinct(), cells)
    listed = several.select("item_id", F.explode("own").alias("cell_id")).distinct()
    return single.unionByName(place.join(listed, ["item_id", "cell_id"]).select("item_id", "cell_id", "lat_m", "lon_m"))


def build_pci(points: DataFrame, grid: Grid) -> DataFrame:
    pixel: Column = grid.index(F.col("lat_m"), F.col("lon_m"))
    return points.select(pixel.alias("pixel"), "cell_id", "item_id").distinct()


def cell_pixels(pci: DataFrame) -> DataFrame:
    return pci.select("cell_id", "pixel").distinct()


def totals(pci: DataFrame, key: str) -> DataFrame:
    """(cell, n_total): distinct items of each key."""
    return pci.select(F.col(key).alias("cell"), "item_id").distinct().groupBy("cell").agg(F.count("*").alias("n_total"))


def region_items(region_cells: DataFrame, cell_items: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """(region_id, item_id): the stored lists where a region has one, else the union over its cells."""
    by_cells = region_cells.join(cell_items, "cell_id").select("region_id", "item_id").distinct()
    if stored is None:
        return by_cells
    return stored.unionByName(by_cells.join(stored.select("region_id").distinct(), "region_id", "left_anti"))


def postings(pci: DataFrame, item_text: DataFrame, region_text: DataFrame) -> DataFrame:
    """(tok, whole, cell_id, pixel, item_id): for each token the rows of pci whose item has it, and, whole, those whose cell has it."""
    columns = ["tok", "whole", "cell_id", "pixel", "item_id"]
    of_items = pci.join(item_text.repartition("item_id").distinct(), "item_id").withColumn("whole", F.lit(False)).select(columns)
    return of_items.unionByName(pci.join(region_text.distinct(), "cell_id").withColumn("whole", F.lit(True)).select(columns))


def inconsistencies(pci: DataFrame, points: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """(cell_id, n_expected, n_found): cells whose items by the dataset are not those of the index, or whose stored total differs."""
    expected = points.select("cell_id", "item_id").distinct().withColumn("expected", F.lit(1))
    found = pci.select("cell_id", "item_id").distinct().withColumn("found", F.lit(1))
    both = expected.join(found, ["cell_id", "item_id"], "full").groupBy("cell_id")
    cells = both.agg(F.count("expected").alias("n_expected"), F.count("found").alias("n_found"), F.sum((F.col("expected").isNull() | F.col("found").isNull()).cast("long")).alias("n_wrong"))
    wrong = F.col("n_wrong") > 0
    if totals is not None:
        cells = cells.join(totals.select(F.col("cell").alias("cell_id"), "n_total"), "cell_id", "full")
        wrong = F.coalesce(wrong, F.lit(True)) | ~F.col("n_total").eqNullSafe(F.col("n_found"))
    return cells.where(wrong).select("cell_id", "n_expected", "n_found")
