"""Results against a model on Python sets, and the invariants of the index."""

import random

import pytest
from pyspark.sql import functions as F

from quadrille.engine import Engine
from quadrille.errors import UnsupportedFeature
from quadrille.operators import build, compare, hierarchy, text
from quadrille.plans.evaluate import evaluate
from quadrille.plans.language import CellId, Empty, Full, RegionId, SetOp, Text, parse
from quadrille.sources.dataset import star_schema

TEXTS = ["asia", "europe", "red", "re", "ro", "nation_1", "a", "large", "nope", "x"]


@pytest.fixture(scope="module")
def index(spark, sf_dir):
    out = Engine(spark).build_index(star_schema(spark, sf_dir), "simplegrid", 3)
    out.preload()
    return out


@pytest.fixture(scope="module")
def model(index):
    """The same tables as Python values."""
    d = index.dataset
    return {
        "pci": {tuple(r) for r in index.pci.select("pixel", "cell_id", "item_id").collect()},
        "items": [tuple(r) for r in d.item_text.select("item_id", "tok").collect()],
        "regions": [tuple(r) for r in d.region_text.select("cell_id", "tok").collect()],
        "region_cells": [tuple(r) for r in d.region_cells.select("region_id", "cell_id").collect()],
    }


MATCH = {"exact": str.__eq__, "prefix": str.startswith, "suffix": str.endswith, "substring": str.__contains__}


def expected(node, m, key):
    k = 0 if key == "pixel" else 1
    if isinstance(node, Empty):
        return set()
    if isinstance(node, CellId):
        return {(x[k], x[2]) for x in m["pci"] if x[1] == node.cell_id}
    if isinstance(node, RegionId):
        cells = {c for r, c in m["region_cells"] if r == node.region_id}
        return {(x[k], x[2]) for x in m["pci"] if x[1] in cells}
    if isinstance(node, Full):
        cells = {c for c, _ in expected(node.of, m, key)}
        return {(x[k], x[2]) for x in m["pci"] if x[k] in cells}
    if isinstance(node, SetOp):
        a, b = expected(node.left, m, key), expected(node.right, m, key)
        return {"+": a | b, "/": a & b, "-": a - b, "^": a ^ b}[node.op]
    full = {c for c, tok in m["regions"] if MATCH[node.mode](tok, node.text)}
    own = {i for i, tok in m["items"] if MATCH[node.mode](tok, node.text)}
    regions = {(x[k], x[2]) for x in m["pci"] if x[1] in full}
    items = {(x[k], x[2]) for x in m["pci"] if x[1] not in full and x[2] in own}
    return {"all": regions | items, "regions": regions, "items": items}[node.part]


def random_tree(rng, depth, ids):
    if depth == 0 or rng.random() < 0.2:
        if ids and rng.random() < 0.15:
            return rng.choice([CellId(rng.randrange(25)), RegionId(rng.choice([0, 3, 104, 999]))])
        return rng.choice([Text(rng.choice(TEXTS), rng.choice(text.MODES), rng.choice(["all", "all", "items", "regions"])), Text(rng.choice(TEXTS), "exact")])
    if rng.random() < 0.15:
        return Full(random_tree(rng, depth - 1, ids))
    return SetOp(rng.choice("+/-^"), random_tree(rng, depth - 1, ids), random_tree(rng, depth - 1, ids))


@pytest.mark.parametrize("seed", range(10))
@pytest.mark.parametrize("key", ["pixel", "cell_id"])
def test_random_trees(index, model, seed, key):
    tree = random_tree(random.Random(seed), 3, key == "cell_id")
    source = index.pixel_source if key == "pixel" else index.cell_source
    got = [tuple(r) for r in evaluate(tree, source).collect()]
    assert len(got) == len(set(got))
    assert set(got) == expected(tree, model, key)


def test_more_leaves_than_a_mask_holds(index, model):
    tree = Empty()
    for k in range(70):
        tree = SetOp("+-^"[k % 3] if k else "+", tree, Text(f"{TEXTS[k % len(TEXTS)]}{k if k % 7 == 6 else ''}", text.MODES[k % 4], ["all", "items", "regions"][k % 3]))
    assert {tuple(r) for r in evaluate(tree, index.pixel_source).collect()} == expected(tree, model, "pixel")


def test_cells_pixels_and_items_differ(spark):
    # At sf0.01 the intersection of two neighbouring nations has no item by cell, 6 by pixel and 15 by item.
    index = Engine(spark).build_index(star_schema(spark, "/root/testdata/sf0.01"), "simplegrid", 2)
    q = '"nation_0" / "nation_1"'
    a, b = index.query('"nation_0"', "cell").flatten(), index.query('"nation_1"', "cell").flatten()
    assert (index.query(q, "cell").flatten().count(), index.query(q, "pixel").flatten().count(), a.intersect(b).count()) == (0, 6, 15)


def test_index_invariants(index):
    cell_items = index.dataset.cell_items()
    again = index.pci.select("cell_id", "item_id").distinct()
    assert again.exceptAll(cell_items).count() == 0 == cell_items.exceptAll(again).count()
    for q in ('"red"', "#a", "asi? + ro"):
        by = [{r[0] for r in index.query(q, b).flatten().collect()} for b in ("cell", "pixel", "hier", "region")]
        assert by[0] == by[2] == by[3] or "+" in q
        assert by[1] == by[2]


def test_backends_refuse(index):
    for backend in ("pixel", "hier"):
        with pytest.raises(UnsupportedFeature):
            index.query("$cell:1", backend)
    for backend in ("hier", "region"):
        with pytest.raises(UnsupportedFeature):
            index.query("a ^ b", backend)
    with pytest.raises(UnsupportedFeature):
        index.query("a", "none")


def test_cqr_and_hierarchy(index):
    r = index.query('"asia" + "red"')
    cqr = {x["cell"]: x for x in r.cqr().collect()}
    totals = {x["cell"]: x["n_total"] for x in index.totals("pixel").collect()}
    pairs = {}
    for c, i in r.pairs.collect():
        pairs.setdefault(c, set()).add(i)
    assert set(cqr) == set(pairs)
    for c, x in cqr.items():
        assert x["is_full"] == (len(pairs[c]) == totals[c])
        assert x["items"] is None if x["is_full"] else x["items"] == sorted(pairs[c])
    h = index.query('"asia" + "red"', "hier")
    back = hierarchy.expanded(h.hcqr(), index.pci, index.grid, 3)
    assert {tuple(x) for x in back.collect()} == {(c, i) for c, s in pairs.items() for i in s}
    pixels = [(x["pixel"], x["level"]) for x in h.hcqr().collect()]
    for p, n in pixels:  # an antichain
        assert not any(q >> (2 * (m - n)) == p for q, m in pixels if m > n)


def test_a_parent_is_full_by_pairs_not_items(spark):
    pci = spark.createDataFrame([(4, 0, 1), (4, 0, 2), (5, 0, 1)], "pixel long, cell_id long, item_id long")
    pairs = spark.createDataFrame([(4, 1), (4, 2)], "cell long, item_id long")
    from quadrille.functions.grid import make_grid

    grid = make_grid("simplegrid", 1)
    nodes = hierarchy.compacted(pairs, hierarchy.tree_totals(build.totals(pci, "pixel"), grid, 1), grid, 1)
    assert [tuple(r) for r in nodes.collect()] == [(4, 1, True, None)]


def test_points_outside_every_cell(spark):
    cells = spark.createDataFrame([(3, 0, 1000, 0, 1000), (4, 0, 2000, 500, 1000)], "cell_id long, lat_lo long, lat_hi long, lon_lo long, lon_hi long")
    points = spark.createDataFrame([(1, 10, 10), (2, 999, 999), (3, 1000, 1000), (4, -1, 5)], "item_id long, lat_m long, lon_m long")
    got = sorted((r["item_id"], r["cell_id"]) for r in build.located(points, cells, 300).collect())
    assert got == [(1, 3), (2, 3), (2, 4), (3, 0), (4, 0)]
    items = spark.createDataFrame([(1, [(10, 10), (999, 999)], [3]), (2, [(10, 10), (999, 999), (-5, -5)], [4, 0])], "item_id long, points array<struct<lat_m:long,lon_m:long>>, cells array<long>")
    got = sorted((r["item_id"], r["cell_id"], r["lat_m"]) for r in build.item_points(items, cells).collect())
    # One cell: no look-up. Several: only points in a listed cell; cell 0 is where points outside go.
    assert got == [(1, 3, 10), (1, 3, 999), (2, 0, -5), (2, 4, 999)]


def test_modes_fall_back():
    only = frozenset
    assert text.offered_mode("substring", only({"prefix", "exact"})) == "prefix"
    assert text.offered_mode("substring", only({"suffix", "exact"})) == "suffix"
    assert text.offered_mode("prefix", only({"suffix", "exact"})) == "exact"
    assert text.offered_mode("prefix", only({"suffix"})) is None
    assert text.offered_mode("exact") == "exact"


def test_case(spark, index):
    from quadrille.engine import Index

    strict = Index(index.dataset, index.grid, index.pci, case_sensitive=True)
    assert index.query('"RED"').pairs.count() == index.query('"red"').pairs.count() > 0
    assert strict.query('"RED"').pairs.count() == 0


def test_cache_and_stats(index):
    a = index.query("red", cached=True)
    assert index.query("red", cached=True) is a
    index.forget()
    assert index.query("red", cached=True) is not a
    assert tuple(a.stats().first()) == (a.pairs.count(), a.pairs.select("cell").distinct().count(), a.flatten().count())


def test_differences(spark):
    frame = lambda ids: spark.createDataFrame([(i,) for i in ids], "item_id long")
    a, b, c = frame([1, 2, 3]), frame([2, 3, 4]), frame(range(100))
    assert tuple(compare.difference_sizes(a, b).first()) == (False, 2, 1, 1)
    assert tuple(compare.difference_sizes(a, a).first()) == (True, 3, 0, 0)
    got = {(r["a"], r["b"]): (r["n_different"], r["items"]) for r in compare.difference_matrix({"a": a, "b": b, "c": c, "d": a}).collect()}
    assert got["a", "b"] == (2, [1, 4]) and got["a", "d"] == (0, []) and got["a", "c"] == (97, None)


def test_region_cost(spark):
    row = spark.createDataFrame([(9, {"admin_level": "2"}), (9, {})], "n long, tags map<string,string>")
    assert [r[0] for r in row.select(hierarchy.region_cost(F.col("n"), F.col("tags"))).collect()] == pytest.approx([0.1, 10.0])


def test_one_shuffle_for_a_tree(index):
    plan = index.query('"asia" / "red" - (ro + "large")').pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert parse("a") == Text("a", "substring")
