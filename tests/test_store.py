import re
import threading

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille import cli
from quadrille.engine import Engine, Index
from quadrille.errors import UnsupportedFeature
from quadrille.operators import build, hierarchy
from quadrille.sources import store
from quadrille.sources.dataset import star_schema


@pytest.fixture(scope="module")
def index(spark, sf_dir):
    return Engine(spark).build_index(star_schema(spark, sf_dir), "simplegrid", 3)


def test_index_round_trip(spark, index, tmp_path):
    path = f"file://{tmp_path}/index"
    store.write_index(index, path)
    back = store.read_index(spark, path)
    assert (back.grid.name, back.grid.default_level) == ("simplegrid", 3)
    for q in ('"asia" / re?', "$cell:3"):
        backend = "cell" if "$" in q else "pixel"
        assert sorted(back.query(q, backend).pairs.collect()) == sorted(index.query(q, backend).pairs.collect())


def test_hierarchy_round_trip(spark, index, tmp_path):
    q = '"asia" + "europe"'
    for only_leaves in (True, False):
        path = f"file://{tmp_path}/hcqr{only_leaves}"
        store.write_hierarchy(index, [q, '"red"'], path, only_leaves=only_leaves)
        want = sorted(map(repr, index.query(q, "hier").hcqr().collect()))
        assert sorted(map(repr, store.read_hierarchy(spark, path, q).collect())) == want
        stored = spark.read.parquet(path).where("is_full IS NULL").count()
        assert (stored == 0) == only_leaves


def test_query_file_and_raw_statistics(spark, index, tmp_path):
    (tmp_path / "q").write_text('"red"\n"asia"\n')
    queries = store.read_query_file(spark, f"file://{tmp_path}/q")
    assert queries == ['"red"', '"asia"']
    for backend, word in (("pixel", "cell"), ("hier", "node")):
        rows = cli.benchmark(index, queries, backend)
        lines = store.raw_statistics(rows, backend == "hier").splitlines()
        assert lines[0] == store.RAW_HEADER.format(word)
        cells = [x.split(";") for x in lines[1:]]
        assert [x[0] for x in cells] == ["0", "1"]
        assert int(cells[0][4]) == index.query('"red"').flatten().count()


def test_programs(spark, sf_dir, tmp_path, capsys):
    out = f"{tmp_path}/i"
    assert cli.main(["create", "sg", "-f", sf_dir, "-o", out, "-l", "3", "--index-type", "simplegrid"]) == 0
    assert cli.main(["create", "hcqr", "-f", sf_dir, "-o", f"{tmp_path}/h", "-l", "3", "--index-type", "simplegrid", "--compactify", "-q", "red"]) == 0
    assert cli.main(["diff", "-f", sf_dir, "-l", "3", "--index-type", "simplegrid", "-q", "red", "-q", "(", "-q", "$rect:1"]) == 0
    assert cli.main(["diff", "-f", sf_dir, "-l", "3", "--index-type", "simplegrid", "--search-type", "noop"]) == 0
    assert cli.main(["query", "-o", sf_dir, "-t", "4", "-m", '"red"', "-oq"]) == 0
    assert cli.main(["query", "-g", out, "-s", f"{tmp_path}/h", "-v", "1", "-m", "red", "-sq", "-oq", "-hsq", "-shq", "--stats", "-m", '"asia"', "-hoq", "--debug-diff"]) == 0
    said = capsys.readouterr().out
    assert "red: equal" in said and "sq: red: cells" in said and "shq: red: nodes" in said
    assert cli.main([]) == 2
    with pytest.raises(SystemExit):
        cli.main(["query", "-sq"])


def test_stored_hierarchy_answers_any_query(spark, index, tmp_path):
    path = f"file://{tmp_path}/any"
    store.write_hierarchy(index, ['"red"'], path)
    for q in ('"red"', '@re? + "asia" - ro'):
        want = index.query(q, "hier").hcqr()
        assert sorted(map(repr, store.read_hierarchy(spark, path, q).collect())) == sorted(map(repr, want.collect())) != []
    with pytest.raises(UnsupportedFeature):
        store.read_hierarchy(spark, path, '"red" ^ "asia"')


def test_create_hcqr_without_queries(spark, sf_dir, index, tmp_path, capsys):
    assert cli.main(["create", "hcqr", "-f", sf_dir, "-o", f"{tmp_path}/h", "-l", "3", "--index-type", "simplegrid", "--compactify", "1"]) == 0
    assert cli.main(["query", "-s", f"{tmp_path}/h", "-m", '"red"', "-shq"]) == 0
    n = hierarchy.merged_partials(index.query('"red"', "hier").hcqr(), index.grid, 1).count()
    assert n and f'shq: "red": nodes {n}\n' in capsys.readouterr().out


def test_benchmark_files_and_summaries(spark, sf_dir, index, tmp_path, capsys):
    (tmp_path / "q").write_text('"red"\n"asia" + "red"\n')
    store.write_hierarchy(index, [], f"{tmp_path}/h", tokens=True)
    store.write_index(index, f"{tmp_path}/i")
    for flag in ("0", "1"):
        assert cli.main(["query", "-g", f"{tmp_path}/i", "-s", f"{tmp_path}/h", "--benchmark", f"{tmp_path}/q", f"{tmp_path}/out{flag}", "0", flag, "2"]) == 0
    files = sorted(p.name for p in tmp_path.glob("out*"))
    assert files == ["out0.cells.stats.raw", "out0.simplegrid.stats.raw", "out1.cells.stats.raw", "out1.shcqr.stats.raw", "out1.simplegrid.stats.raw"]
    rows = {n: [x.split(";") for x in (tmp_path / n).read_text().splitlines()[1:]] for n in files}
    assert all([x[0] for x in r] == ["0", "1"] for r in rows.values())
    assert [x[3:] for x in rows["out1.shcqr.stats.raw"]] == [x[3:] for x in rows["out1.simplegrid.stats.raw"]]
    said = capsys.readouterr().out
    assert said.count("SpatialIndex::cqr: n 2") == 2 and "StoredHierarchy::cellCount: n 2" in said and "Cells::flaten: n 2" in said


def test_every_token_has_stored_nodes(spark, index, tmp_path):
    store.write_hierarchy(index, ['"red"'], f"{tmp_path}/t", only_leaves=False, tokens=True)
    stored = spark.read.schema(store.NODES).parquet(f"{tmp_path}/t")
    d = index.dataset
    tokens = d.item_text.select("tok").union(d.region_text.select("tok")).distinct()
    placed = {r[0] for r in tokens.join(index.pci.join(d.item_text, "item_id").select("tok").union(index.pci.join(d.region_text, "cell_id").select("tok")).distinct(), "tok").collect()}
    assert {r[0] for r in stored.select("query").distinct().collect()} == {f'"{t}"' for t in placed}
    for q in ('"red"', '"asia"', '"nation_3"', '"economy"'):
        want = sorted(map(repr, index.query(q, "hier").hcqr().collect()))
        assert sorted(map(repr, stored.where(F.col("query") == q).where("is_full IS NOT NULL").drop("query").collect())) == want != []
        assert sorted(map(repr, store.read_hierarchy(spark, f"{tmp_path}/t", q).collect())) == want


def test_a_stored_index_reads_postings_and_totals(spark, index, tmp_path):
    path = f"{tmp_path}/p"
    store.write_index(index, path)
    back = store.read_index(spark, path)
    for key in ("cell_id", "pixel"):
        assert sorted(back.totals(key).collect()) == sorted(index.totals(key).collect())
    for q in ('"asia" / "red"', '@re? + #ro', '("asia" + ame?) / (ro ^ ?een) - % ("red" / @"rod")', '"nope"', ""):
        for backend in ("pixel", "cell"):
            assert sorted(back.query(q, backend).pairs.collect()) == sorted(index.query(q, backend).pairs.collect())
    found = back.query('"asia" / "red"').cqr()
    # Neither the core table nor its totals are read or counted, and tokens are looked up by their ranges.
    assert {re.search(r"/p/(\w+)/", f)[1] for f in found.inputFiles()} == {"postings", "totals_pixel"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert any("EqualTo(tok,asia)" in x for x in re.findall(r"PushedFilters: (.*)", plan))
    assert sorted(map(repr, back.query('"asia" + "europe"', "hier").hcqr().collect())) == sorted(map(repr, index.query('"asia" + "europe"', "hier").hcqr().collect()))


def test_modes_of_a_stored_index(spark, sf_dir, tmp_path):
    few = Engine(spark).build_index(star_schema(spark, sf_dir), "simplegrid", 3, modes=["exact", "prefix"])
    store.write_index(few, f"{tmp_path}/few")
    back = store.read_index(spark, f"{tmp_path}/few")
    assert back.modes == {"exact", "prefix"}
    pairs = lambda i, q: sorted(i.query(q).pairs.collect())
    assert pairs(back, "ed") == pairs(few, "ed") == pairs(few, "ed?")
    assert pairs(back, "?red") == pairs(few, '"red"') != []
    none = Engine(spark).build_index(star_schema(spark, sf_dir), "simplegrid", 3, modes=["suffix"])
    assert pairs(none, '"red"') == [] and pairs(none, "red") == pairs(none, "?red")


def test_the_consistency_check(spark, sf_dir, index, tmp_path, capsys):
    store.write_index(index, f"{tmp_path}/c")
    back = store.read_index(spark, f"{tmp_path}/c")
    assert back.check().count() == index.check().count() == 0
    lost = back.pci.where("item_id % 5 != 0")
    wrong = {r["cell_id"]: (r["n_expected"], r["n_found"]) for r in build.inconsistencies(lost, back.dataset.points).collect()}
    assert wrong and all(a > b for a, b in wrong.values())
    assert build.inconsistencies(back.pci, back.dataset.points, back.totals("cell_id").where("cell != 3")).collect()[0]["cell_id"] == 3
    assert cli.main(["create", "sg", "-f", sf_dir, "-o", f"{tmp_path}/d", "-l", "2", "--index-type", "simplegrid", "--check", "--modes", "exact"]) == 0
    assert "0 cells differ" in capsys.readouterr().out


def test_the_cache_evicts(spark, sf_dir):
    i = Engine(spark).build_index(star_schema(spark, sf_dir), "simplegrid", 2)
    i.cache_size = 2
    a = i.query('"red"', cached=True)
    assert i.query('"red"', cached=True) is a
    b = i.query('"asia"', cached=True)
    i.query('"red"', cached=True)
    i.query('"rod"', cached=True)
    assert [k[0] for k in i._cache] == ['"red"', '"rod"'] and not b.pairs.is_cached and a.pairs.is_cached
    i.forget()
    assert not a.pairs.is_cached


def test_plain_rows_of_a_result(index):
    from quadrille.operators import results

    r = index.query('"asia" + re?')
    want = {(x["cell"], x["is_full"], i) for x in r.cqr().collect() for i in (x["items"] if x["items"] is not None else [None])}
    assert {tuple(x) for x in results.cell_result_rows(r.pairs, index.totals("pixel")).collect()} == want


def test_hierarchies_are_combined(index):
    a, b = index.query('"asia" + "europe"', "hier"), index.query("re?", "hier")
    for op in "+/-":
        want = index.query(f'("asia" + "europe") {op} re?', "hier")
        assert sorted(map(repr, a.combined(op, b).hcqr().collect())) == sorted(map(repr, want.hcqr().collect()))
    with pytest.raises(UnsupportedFeature):
        a.combined("^", b)
    with pytest.raises(UnsupportedFeature):
        a.combined("+", index.query("re?", "cell"))


def test_stored_tables_are_made_once(spark, index, tmp_path, monkeypatch):
    used = []
    for name in ("build_pci", "postings"):
        f = getattr(build, name)
        monkeypatch.setattr(build, name, lambda *a, f=f: used.extend(x for x in a if isinstance(x, DataFrame)) or f(*a))
    store.write_index(index, f"{tmp_path}/once")
    assert {re.search(r"/once/(\w+)/|$", x)[1] for t in used for x in t.inputFiles()} == {"points", "pci", "item_text", "region_text"}
    assert sorted(store.read_index(spark, f"{tmp_path}/once").pci.collect()) == sorted(index.pci.collect())


def test_a_pci_that_is_not_of_the_points_is_stored_as_it_is(spark, index, tmp_path):
    own = Index(index.dataset, index.grid, index.pci.where("item_id % 2 = 0"))
    store.write_index(own, f"{tmp_path}/own")
    assert sorted(store.read_index(spark, f"{tmp_path}/own").pci.collect()) == sorted(own.pci.collect())


def test_tables_are_written_side_by_side(spark):
    met = threading.Barrier(2, timeout=60)
    assert sorted(store._at_once(spark, met.wait, met.wait)) == [0, 1]
    with pytest.raises(ZeroDivisionError):
        store._at_once(spark, lambda: 1 / 0, int)


def test_stored_matches_are_shuffled_once(spark, index, tmp_path):
    store.write_index(index, f"{tmp_path}/s")
    back = store.read_index(spark, f"{tmp_path}/s")
    for backend, n in (("pixel", 3), ("cell", 5)):
        found = back.query('("asia" + ame?) - % ("red" / @"rod")', backend).pairs
        plan = found._jdf.queryExecution().executedPlan().toString()
        # Pairs within and without the conversion, and the cells between; cells without a bound may take a join by sorting.
        assert plan.count("Exchange hashpartitioning") <= n
    alone = back.query('"asia" + re?').pairs._jdf.queryExecution().executedPlan().toString()
    assert alone.count("Exchange hashpartitioning") == 1


def test_a_hierarchy_reads_postings_once(spark, index, tmp_path):
    store.write_index(index, f"{tmp_path}/r")
    nodes = store.read_index(spark, f"{tmp_path}/r").query('"asia" + "europe"', "hier").hcqr()
    assert sorted(map(repr, nodes.collect())) == sorted(map(repr, index.query('"asia" + "europe"', "hier").hcqr().collect())) != []
    final = nodes._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"FileScan parquet \[tok", final)) == 1


def test_texts_of_items_meet_them_in_one_shuffle(spark, sf_dir, index):
    pci = spark.createDataFrame([], "item_id long, pixel long")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = pci.hint("merge").join(star_schema(spark, sf_dir).item_text, "item_id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert plan.count("Exchange hashpartitioning") <= 2
