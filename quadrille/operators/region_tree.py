"""The region tree as a grid: its pixels are the regions and the cells, its leaves the cells.

A pixel is twice the id of a cell, or twice the id of a region and one. Regions lie
below those that hold all their cells and more; of these, those with no other region
in between are the parents. All steps are equi-joins on cells.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.operators.build import region_items
from quadrille.operators.hierarchy import region_cost
from quadrille.sources.dataset import Dataset


def cell_pixel(cell_id: Column) -> Column:
    return (2 * cell_id).cast("long")


def region_pixel(region_id: Column) -> Column:
    return (2 * region_id + 1).cast("long")


def is_region(pixel: Column) -> Column:
    return F.pmod(pixel, F.lit(2)) == 1


def own_id(pixel: Column) -> Column:
    """The id of the cell or region that a pixel stands for."""
    return F.floor(pixel / 2).cast("long")


@dataclass(frozen=True)
class RegionTree:
    dataset: Dataset
    #: (region_id, item_id) of regions whose items are listed; of others they are the union over their cells.
    stored_items: DataFrame | None = None

    def items(self) -> DataFrame:
        """(pixel, item_id), each once."""
        d = self.dataset
        of_cells = d.cell_items().select(cell_pixel(F.col("cell_id")).alias("pixel"), "item_id")
        of_regions = region_items(d.region_cells, d.cell_items(), self.stored_items)
        return of_cells.unionByName(of_regions.select(region_pixel(F.col("region_id")).alias("pixel"), "item_id"))

    def pixels(self) -> DataFrame:
        """(pixel, is_region, id, n_cells, n_items), of all cells and regions."""
        d = self.dataset
        cells = d.cells.select(cell_pixel(F.col("cell_id")).alias("pixel"), F.lit(1).cast("long").alias("n_cells")).distinct()
        regions = d.region_cells.distinct().groupBy(region_pixel(F.col("region_id")).alias("pixel")).agg(F.count("*").alias("n_cells"))
        counts = self.items().groupBy("pixel").agg(F.count("*").alias("n_items"))
        every = cells.unionByName(regions).join(counts, "pixel", "left")
        return every.select("pixel", is_region(F.col("pixel")).alias("is_region"), own_id(F.col("pixel")).alias("id"), "n_cells", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"))

    def above(self) -> DataFrame:
        """(pixel, above): the regions that hold all cells of a region, and more; and those that hold a cell."""
        cells = self.dataset.region_cells.distinct()
        size = cells.groupBy("region_id").agg(F.count("*").alias("n"))
        sized = cells.join(size, "region_id")
        a, b = sized.select("region_id", "cell_id", "n"), sized.select(F.col("region_id").alias("other"), "cell_id", F.col("n").alias("m"))
        held = a.join(b, "cell_id").where("m > n").groupBy("region_id", "n", "other").agg(F.count("*").alias("common")).where("common = n")
        of_regions = held.select(region_pixel(F.col("region_id")).alias("pixel"), region_pixel(F.col("other")).alias("above"))
        of_cells = cells.select(cell_pixel(F.col("cell_id")).alias("pixel"), region_pixel(F.col("region_id")).alias("above"))
        return of_regions.unionByName(of_cells)

    def parents(self) -> DataFrame:
        """(pixel, parent): of the regions above a pixel, those that are not above another one of them."""
        above = self.above()
        farther = above.join(above.select(F.col("pixel").alias("above"), F.col("above").alias("farther")), "above").select("pixel", F.col("farther").alias("above"))
        return above.join(farther, ["pixel", "above"], "left_anti").select("pixel", F.col("above").alias("parent")).distinct()

    def costs(self, key: str = "admin_level") -> DataFrame:
        """(pixel, cost) of each region: less for more items, a hundredfold without the key among its tags."""
        regions = self.dataset.regions.select(region_pixel(F.col("region_id")).alias("pixel"), "tags")
        return self.pixels().join(regions, "pixel").select("pixel", region_cost(F.col("n_items"), F.col("tags"), key).alias("cost"))
