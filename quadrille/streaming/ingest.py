"""Points that arrive as a stream are bucketed onto the grid and added to a stored pci table.

Each micro-batch goes through the same build as a whole index, drops rows that the
table has, and appends. A batch that is run again after a failure finds its rows
there and adds nothing, so the table holds each (pixel, cell_id, item_id) once. The
table is partitioned by pixels of level COARSE, so a batch reads only the parts of
the world that its points lie in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from quadrille.functions.grid import Grid
from quadrille.operators.build import build_pci


#: Level of the pixels by which the table is partitioned.
COARSE = 3


def append_new(batch: DataFrame, grid: Grid, path: str) -> None:
    spark = batch.sparkSession
    up = F.greatest(grid.level(F.col("pixel")) - COARSE, F.lit(0))
    pci = build_pci(batch, grid).withColumn("coarse", grid.ancestor(F.col("pixel"), up)).persist()
    try:
        new = pci
        if _exists(batch, path):
            used = [r[0] for r in pci.select("coarse").distinct().collect()]  # at most the grid's pixels of that level
            known = spark.read.schema(pci.schema).parquet(path).where(F.col("coarse").isin(used))
            new = pci.join(known, ["coarse", "pixel", "cell_id", "item_id"], "left_anti").select(pci.columns)
        new.write.mode("append").partitionBy("coarse").parquet(path)
    finally:
        pci.unpersist()


def _exists(batch: DataFrame, path: str) -> bool:
    jvm = batch.sparkSession._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(batch.sparkSession._jsparkSession.sessionState().newHadoopConf()).exists(at)


def ingest(points: DataFrame, grid: Grid, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer (call .start()) for a stream of points(item_id, cell_id, lat_m, lon_m)."""
    writer = points.writeStream.option("checkpointLocation", checkpoint).outputMode("append")
    return writer.foreachBatch(lambda batch, _: append_new(batch, grid, path))
