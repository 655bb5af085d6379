"""Statistics of indexes, results and measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.grid import Grid


def summary(rows: DataFrame, value: str) -> DataFrame:
    """One row: count, least, greatest, sum, mean, population deviation and median of a column."""
    v = F.col(value).cast("double")
    return rows.agg(
        F.count(value).alias("n"),
        F.min(v).alias("least"),
        F.max(v).alias("greatest"),
        F.sum(v).alias("total"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("deviation"),
        F.percentile(v, F.lit(0.5)).alias("median"),
    )


def pixel_counts(pci: DataFrame) -> DataFrame:
    """(pixel, n_entries, n_cells): an item counts once for each of its cells."""
    return pci.groupBy("pixel").agg(F.count("*").alias("n_entries"), F.count_distinct("cell_id").alias("n_cells"))


def index_summary(pci: DataFrame) -> DataFrame:
    """One row: the number of pixels, and least, greatest and total of entries and cells over them."""
    counts = pixel_counts(pci)

    def three(name: str) -> list[Column]:
        return [F.min(name).alias(f"min_{name[2:]}"), F.max(name).alias(f"max_{name[2:]}"), F.sum(name).cast("long").alias(f"sum_{name[2:]}")]

    return counts.agg(F.count("*").alias("n_pixels"), *three("n_entries"), *three("n_cells"))


def area_summary(pci: DataFrame, grid: Grid) -> DataFrame:
    """One row: level, number of pixels, and least, mean and greatest area in square kilometres."""
    pixels = pci.select("pixel").distinct().select(grid.level(F.col("pixel")).alias("level"), grid.area(F.col("pixel")).alias("area"))
    return pixels.agg(F.max("level").alias("level"), F.count("*").alias("n_pixels"), F.min("area").alias("min_km2"), F.avg("area").alias("mean_km2"), F.max("area").alias("max_km2"))
