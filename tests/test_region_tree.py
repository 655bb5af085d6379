"""The region tree as a grid, on a small nested arrangement."""

from quadrille.operators.region_tree import RegionTree
from quadrille.sources.dataset import Dataset


def tree(spark, stored=None):
    empty = spark.createDataFrame([], "item_id long, tok string")
    points = spark.createDataFrame([(10, 1), (11, 1), (12, 2), (12, 3)], "item_id long, cell_id long")
    cells = spark.createDataFrame([(c,) for c in (1, 2, 3, 4)], "cell_id long")
    # 7 holds 8, which holds 9; 6 overlaps 8 and lies in 7.
    region_cells = spark.createDataFrame([(7, 1), (7, 2), (7, 3), (8, 1), (8, 2), (9, 1), (6, 2), (6, 3)], "region_id long, cell_id long")
    regions = spark.createDataFrame([(6, "a", {"admin_level": "2"}), (7, "b", {}), (8, "c", {}), (9, "d", {})], "region_id long, name string, tags map<string,string>")
    return RegionTree(Dataset(points, empty, empty, cells, region_cells, regions), stored)


def test_pixels(spark):
    rows = {r["pixel"]: (r["is_region"], r["id"], r["n_cells"], r["n_items"]) for r in tree(spark).pixels().collect()}
    assert rows == {2: (False, 1, 1, 2), 4: (False, 2, 1, 1), 6: (False, 3, 1, 1), 8: (False, 4, 1, 0), 13: (True, 6, 2, 1), 15: (True, 7, 3, 3), 17: (True, 8, 2, 3), 19: (True, 9, 1, 2)}


def test_stored_items_come_first(spark):
    stored = spark.createDataFrame([(7, 99)], "region_id long, item_id long")
    assert {r["item_id"] for r in tree(spark, stored).items().where("pixel = 15").collect()} == {99}


def test_parents(spark):
    got = sorted(map(tuple, tree(spark).parents().collect()))
    assert got == [(2, 19), (4, 13), (4, 17), (6, 13), (13, 15), (17, 15), (19, 17)]


def test_costs(spark):
    got = {r["pixel"]: round(r["cost"], 6) for r in tree(spark).costs().collect()}
    assert got == {13: 0.5, 15: 25.0, 17: 25.0, 19: round(100 / 3, 6)}
