from quadrille.functions.grid import make_grid
from quadrille.operators.build import build_pci
from quadrille.sources.dataset import star_schema
from quadrille.streaming.ingest import append_new, ingest


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    points = star_schema(spark, sf_dir).points
    for k in range(3):  # the second and third files repeat rows of the first
        points.where(f"item_id % 3 <= {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    grid, path = make_grid("simplegrid", 3), f"file://{tmp_path}/pci"
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = ingest(stream, grid, path, f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    want = sorted(map(tuple, build_pci(points, grid).collect()))
    assert sorted(map(tuple, spark.read.parquet(path).select("pixel", "cell_id", "item_id").collect())) == want
    append_new(points, grid, path)  # a batch that runs again
    assert spark.read.parquet(path).count() == len(want)


def test_a_batch_reads_its_own_parts(spark, tmp_path):
    grid = make_grid("simplegrid", 5)
    path = str(tmp_path / "parts")
    rows = [(i, 0, lat, lon) for i, (lat, lon) in enumerate([(-80_000, -170_000), (80_000, 170_000), (1_000, 1_000)])]
    points = spark.createDataFrame(rows, "item_id long, cell_id long, lat_m long, lon_m long")
    for batch in (points.where("item_id = 0"), points.where("item_id < 2"), points, points):
        append_new(batch, grid, path)
    assert sorted(r["item_id"] for r in spark.read.parquet(path).collect()) == [0, 1, 2]
    assert len(list((tmp_path / "parts").glob("coarse=*"))) == 3
