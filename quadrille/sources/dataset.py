"""The inputs of an index, as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Coordinates are integer thousandths of a degree: equal in every engine, and exact.
MILLI = 1000


@dataclass(frozen=True)
class Dataset:
    """points(item_id, cell_id, lat_m, lon_m), item_text(item_id, tok), region_text(cell_id, tok),
    cells(cell_id, region_id, lat_lo, lat_hi, lon_lo, lon_hi), region_cells(region_id, cell_id),
    regions(region_id, name, tags)."""

    points: DataFrame
    item_text: DataFrame
    region_text: DataFrame
    cells: DataFrame
    region_cells: DataFrame
    regions: DataFrame

    def cell_items(self) -> DataFrame:
        """(cell_id, item_id): the items of each cell."""
        return self.points.select("cell_id", "item_id").distinct()


#: Item ids of parts start here; those of customers are their keys.
PART_ITEMS = 10_000_000
#: Extent of a cell in the derived world grid.
CELL_LAT, CELL_LON = 36_000, 72_000


def star_schema(spark: SparkSession, sf_dir: str) -> Dataset:
    """Items, cells and regions derived from the star schema's tables.

    Nations are cells in a 5 x 5 grid of the world, world regions are regions of
    five cells, each nation is a region of one cell as well. Customers are items of
    one point, parts are items of one point for each supplier of their first lines.
    """

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    long = lambda c: F.col(c).cast("long")
    nation = table("nation").select(long("n_nationkey").alias("cell_id"), long("n_regionkey").alias("region_id"), "n_name")
    row, column = F.col("cell_id") % 5, F.floor(F.col("cell_id") / 5)
    cells = nation.select(
        "cell_id",
        "region_id",
        (CELL_LAT * row - 90_000).cast("long").alias("lat_lo"),
        (CELL_LAT * (row + 1) - 90_000).cast("long").alias("lat_hi"),
        (CELL_LON * column - 180_000).cast("long").alias("lon_lo"),
        (CELL_LON * (column + 1) - 180_000).cast("long").alias("lon_hi"),
    )
    place = cells.select("cell_id", "lat_lo", "lon_lo")

    def placed(rows: DataFrame, lat: F.Column, lon: F.Column) -> DataFrame:
        at = rows.join(place, "cell_id")
        return at.select("item_id", "cell_id", (F.col("lat_lo") + lat % CELL_LAT).alias("lat_m"), (F.col("lon_lo") + lon % CELL_LON).alias("lon_m"))

    customer = table("customer").select(long("c_custkey").alias("item_id"), long("c_nationkey").alias("cell_id"), "c_name", "c_mktsegment")
    of_customers = placed(customer.select("item_id", "cell_id"), F.col("item_id") * 7919, F.col("item_id") * 104729)
    supplier = table("supplier").select(long("s_suppkey").alias("s"), long("s_nationkey").alias("cell_id"))
    first_lines = table("lineitem").where("l_linenumber = 1").select(long("l_partkey").alias("p"), long("l_suppkey").alias("s"))
    parts = first_lines.join(supplier, "s").withColumn("item_id", F.col("p") + PART_ITEMS)
    parts = parts.join(place, "cell_id").select(
        "item_id",
        "cell_id",
        (F.col("lat_lo") + (F.col("p") * 7919 + F.col("s") * 31) % CELL_LAT).alias("lat_m"),
        (F.col("lon_lo") + (F.col("p") * 104729 + F.col("s") * 17) % CELL_LON).alias("lon_m"),
    )
    points = of_customers.unionByName(parts.distinct())

    part = table("part").select((long("p_partkey") + PART_ITEMS).alias("item_id"), "p_name", "p_type")
    each = lambda *words: F.explode(F.array_distinct(F.array(*map(F.lower, words)))).alias("tok")
    texts = customer.select("item_id", each(F.col("c_mktsegment"), F.col("c_name")))
    texts = texts.unionByName(part.select("item_id", each(F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2)), F.col("p_type"))))
    # By item, so that copies meet and joins on items need no other shuffle; few are left within a file's part to count there.
    item_text = texts.repartition("item_id").distinct()

    region = table("region").select(long("r_regionkey").alias("region_id"), F.col("r_name").alias("name"))
    named = nation.join(region, "region_id")
    region_text = nation.select("cell_id", F.lower("n_name").alias("tok")).unionByName(named.select("cell_id", F.lower("name").alias("tok")))

    # Region ids: the world regions' keys; nations, as regions of one cell, follow at 100 and more.
    one_cell = nation.select((F.col("cell_id") + 100).alias("region_id"), "cell_id", F.col("n_name").alias("name"))
    tags = F.create_map(F.lit("admin_level"), F.lit("2"))
    no_tags = F.create_map().cast("map<string,string>")
    regions = region.select("region_id", "name", no_tags.alias("tags")).unionByName(one_cell.select("region_id", "name", tags.alias("tags")))
    region_cells = nation.select("region_id", "cell_id").unionByName(one_cell.select("region_id", "cell_id"))
    return Dataset(points, item_text, region_text, cells, region_cells, regions)
