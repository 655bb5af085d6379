"""Registered queries on stored indexes, hierarchies and query files, and the same in DuckDB SQL."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.engine import Engine, Index
from quadrille.functions.grid import make_grid
from quadrille.operators import build, hierarchy
from quadrille.operators.region_tree import RegionTree
from quadrille.queries import _FULL_NESTED, _HIER, _HIER_SQL, _TOTALS, LEVEL, _add, _nodes_sql, _set_sql, base_sql, flat, index, leaf_sql
from quadrille.sources import store
from quadrille.sources.dataset import star_schema
from quadrille.streaming.ingest import append_new

_folders: dict[str, str] = {}


def _folder(spark: SparkSession) -> str:
    """A fresh path for a stored index, in the folder that the cluster shares; a local session gets a temporary one."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _folders:
            _folders[context.applicationId] = folder = tempfile.mkdtemp(prefix="quadrille-index-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = _folders[context.applicationId]
    return f"{base.rstrip('/')}/quadrille-index-{uuid.uuid4().hex}"


_stored: dict[tuple[str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str) -> Index:
    """The index of a folder, written once for each application and read again."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        path = _folder(spark)
        store.write_index(index(spark, sf_dir), path)
        _stored[key] = path
    return store.read_index(spark, _stored[key])


_MIXED = '("asia" + re?) / ro'


def _mixed_sql(key: str) -> str:
    return _set_sql("/", _set_sql("+", leaf_sql("asia", "exact", key), leaf_sql("re", "prefix", key)), leaf_sql("ro", "substring", key))


_add("stored_flat", lambda s, d: stored(s, d).query(_MIXED).pairs, f"{base_sql()} SELECT cell, item_id FROM {_mixed_sql('pixel')}")
_add(
    "stored_cells",
    lambda s, d: flat(stored(s, d).query(_MIXED, "cell").cqr()),
    f"""{base_sql()}, r AS (SELECT * FROM {_mixed_sql('cell_id')}), t AS ({_TOTALS.format(key='cell_id')})
SELECT cell, count(*) = any_value(n_total) AS is_full,
       CASE WHEN count(*) < any_value(n_total) THEN string_agg(item_id, ',' ORDER BY item_id) ELSE '' END AS items FROM r JOIN t USING (cell) GROUP BY cell""",
)
_NODES = "SELECT pixel, level, is_full, coalesce(array_to_string(items, ','), '') AS items FROM nodes"
_add("stored_hier", lambda s, d: flat(stored(s, d).query(_HIER, "hier").hcqr()), f"{base_sql()}, {_nodes_sql(_HIER_SQL)} {_NODES}")
_add("stored_nested", lambda s, d: stored(s, d).query(_FULL_NESTED[0]).pairs, f"{base_sql()} SELECT cell, item_id FROM {_FULL_NESTED[1]}")
_add("stored_totals", lambda s, d: stored(s, d).totals("pixel"), f"{base_sql()} {_TOTALS.format(key='pixel')}")
_add(
    "stored_postings",
    lambda s, d: stored(s, d).postings,
    f"""{base_sql()} SELECT tok, false AS whole, cell_id, pixel, item_id FROM fx_pci JOIN fx_item_text USING (item_id)
UNION ALL SELECT tok, true, cell_id, pixel, item_id FROM fx_pci JOIN (SELECT DISTINCT * FROM fx_region_text) USING (cell_id)""",
)
_add(
    "stored_tree_totals",
    lambda s, d: stored(s, d).tree_totals().select("pixel", F.col("level").cast("int").alias("level"), "total"),
    f"""{base_sql()} SELECT pixel >> (2 * up) AS pixel, CAST({LEVEL} - up AS INTEGER) AS level, count(*) AS total
FROM (SELECT DISTINCT pixel, item_id FROM fx_pci), (SELECT CAST(range AS BIGINT) AS up FROM range({LEVEL + 1})) GROUP BY ALL""",
)


def _fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of exact and prefix matches answers a substring by prefix and a suffix by exact match."""
    path = _folder(spark)
    few = Engine(spark).build_index(star_schema(spark, sf_dir), "simplegrid", LEVEL, modes=["exact", "prefix"])
    store.write_index(few, path)
    return store.read_index(spark, path).query("ro + ?red").pairs


_add("text_fallback", _fallback, f"{base_sql()} SELECT cell, item_id FROM {_set_sql('+', leaf_sql('ro', 'prefix', 'pixel'), leaf_sql('red', 'exact', 'pixel'))}")


def _file_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of items of each query of a file that was written and read."""
    path = _folder(spark)
    texts = ['"red"', '"asia" / "red"', "re? - ro"]
    spark.createDataFrame([("\n".join(texts),)], "value string").coalesce(1).write.text(path)
    i, rows = stored(spark, sf_dir), None
    for k, text in enumerate(store.read_query_file(spark, path)):
        own = i.query(text).flatten().agg(F.lit(k).cast("int").alias("query"), F.count("*").alias("n_items"))
        rows = own if rows is None else rows.unionByName(own)
    return rows


_FILE_SQL = [leaf_sql("red", "exact", "pixel"), _set_sql("/", leaf_sql("asia", "exact", "pixel"), leaf_sql("red", "exact", "pixel")), _set_sql("-", leaf_sql("re", "prefix", "pixel"), leaf_sql("ro", "substring", "pixel"))]
_add("query_file", _file_queries, base_sql() + " " + " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS query, count(DISTINCT item_id) AS n_items FROM {x}" for k, x in enumerate(_FILE_SQL)))


def _hierarchy_of_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the stored hierarchies of every token: full and partial pixels, and the items listed."""
    path = _folder(spark)
    store.write_hierarchy(index(spark, sf_dir), [], path, tokens=True)
    nodes = spark.read.schema(store.NODES).parquet(path)
    full = F.col("is_full").cast("long")
    return nodes.groupBy("query").agg(F.sum(full).alias("n_full"), F.sum(1 - full).alias("n_partial"), F.sum(F.coalesce(F.size("items"), F.lit(0))).cast("long").alias("n_listed"), F.min("level").cast("int").alias("top"))


_add(
    "stored_token_nodes",
    _hierarchy_of_tokens,
    f"""{base_sql()}, r AS (
  SELECT DISTINCT tok, pixel, item_id FROM fx_pci JOIN fx_item_text USING (item_id)
  UNION SELECT tok, pixel, item_id FROM fx_pci JOIN fx_region_text USING (cell_id)),
ups AS (SELECT CAST(range AS BIGINT) AS up FROM range({LEVEL + 1})),
got AS (SELECT tok, pixel >> (2 * up) AS pixel, {LEVEL} - up AS level, count(*) AS n FROM r, ups GROUP BY ALL),
tot AS (SELECT pixel >> (2 * up) AS pixel, {LEVEL} - up AS level, count(*) AS n FROM (SELECT DISTINCT pixel, item_id FROM fx_pci), ups GROUP BY ALL),
f AS (SELECT tok, got.pixel, got.level FROM got JOIN tot ON got.pixel = tot.pixel AND got.level = tot.level AND got.n = tot.n),
best AS (SELECT l.tok, l.pixel AS leaf, arg_min(f.pixel, f.level) AS pixel, min(f.level) AS level
  FROM (SELECT tok, pixel, pixel >> (2 * up) AS a FROM (SELECT DISTINCT tok, pixel FROM r), ups) l JOIN f ON f.tok = l.tok AND f.pixel = l.a GROUP BY l.tok, l.pixel),
nodes AS (
  SELECT DISTINCT tok, pixel, level, 1 AS whole, 0 AS listed FROM best
  UNION ALL SELECT tok, pixel, {LEVEL}, 0, count(*) FROM r ANTI JOIN best ON best.tok = r.tok AND best.leaf = r.pixel GROUP BY tok, pixel)
SELECT '"' || tok || '"' AS query, CAST(sum(whole) AS BIGINT) AS n_full, CAST(sum(1 - whole) AS BIGINT) AS n_partial, CAST(sum(listed) AS BIGINT) AS n_listed, CAST(min(level) AS INTEGER) AS top
FROM nodes GROUP BY tok""",
)


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The build-time check, of an index that lost every seventh item."""
    i = index(spark, sf_dir)
    return build.inconsistencies(i.pci.where("item_id % 7 != 0"), i.dataset.points)


_add(
    "index_check",
    _checked,
    f"""{base_sql()} SELECT cell_id, count(DISTINCT item_id) AS n_expected, count(DISTINCT CASE WHEN item_id % 7 != 0 THEN item_id END) AS n_found
FROM fx_pci GROUP BY cell_id HAVING count(DISTINCT item_id) != count(DISTINCT CASE WHEN item_id % 7 != 0 THEN item_id END)""",
)


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that arrive in three batches, of which one comes again."""
    path, points = _folder(spark), star_schema(spark, sf_dir).points
    grid = make_grid("simplegrid", LEVEL)
    for k in (0, 1, 1, 2):
        append_new(points.where(F.col("item_id") % 3 == k), grid, path)
    return spark.read.parquet(path).select("pixel", "cell_id", "item_id")


_add("ingested_batches", _batches, f"{base_sql()} SELECT pixel, cell_id, item_id FROM fx_pci")


def _ancestor_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pixels of level 2 are above which of level 4, among those of one cell."""
    i = index(spark, sf_dir)
    low = i.pci.select("cell_id", "pixel").distinct()
    high = low.select("cell_id", i.grid.ancestor(F.col("pixel"), F.lit(2)).alias("above")).distinct()
    return low.join(high, "cell_id").select("cell_id", "pixel", "above", i.grid.is_ancestor(F.col("above"), F.col("pixel")).alias("is_above"))


_add(
    "grid_is_ancestor",
    _ancestor_pairs,
    f"""{base_sql()}, l AS (SELECT DISTINCT cell_id, pixel FROM fx_pci), h AS (SELECT DISTINCT cell_id, pixel >> 4 AS above FROM fx_pci)
SELECT cell_id, pixel, above, pixel >> 4 = above AS is_above FROM l JOIN h USING (cell_id)""",
)
_add(
    "hcqr_combined",
    lambda s, d: flat((i := stored(s, d)).query(_HIER, "hier").combined("/", i.query("re?", "hier")).hcqr()),
    f"{base_sql()}, {_nodes_sql(_set_sql('/', _HIER_SQL, leaf_sql('re', 'prefix', 'pixel')))} {_NODES}",
)
_add(
    "hcqr_expanded",
    lambda s, d: hierarchy.expanded((r := stored(s, d).query(_HIER, "hier")).hcqr(), r.index.pci, r.index.grid, LEVEL),
    f"{base_sql()} SELECT DISTINCT cell, item_id FROM {_HIER_SQL}",
)

# The region tree as a grid.
_TREE = """tree AS (SELECT region_id, cell_id FROM fx_cells UNION ALL SELECT cell_id + 100, cell_id FROM fx_cells),
ti AS (SELECT DISTINCT 2 * cell_id AS pixel, item_id FROM fx_points UNION ALL SELECT DISTINCT 2 * region_id + 1, item_id FROM tree JOIN fx_points USING (cell_id)),
tp AS (
  SELECT 2 * cell_id AS pixel, false AS is_region, cell_id AS id, CAST(1 AS BIGINT) AS n_cells FROM fx_cells
  UNION ALL SELECT 2 * region_id + 1, true, region_id, count(*) FROM tree GROUP BY region_id),
tn AS (SELECT tp.*, coalesce(n, 0) AS n_items FROM tp LEFT JOIN (SELECT pixel, count(*) AS n FROM ti GROUP BY pixel) USING (pixel))"""
_add("region_tree_pixels", lambda s, d: RegionTree(star_schema(s, d)).pixels(), f"{base_sql()}, {_TREE} SELECT pixel, is_region, id, n_cells, n_items FROM tn")
_add(
    "region_tree_parents",
    lambda s, d: RegionTree(star_schema(s, d)).parents(),
    f"{base_sql()}, {_TREE} SELECT 2 * cell_id AS pixel, 2 * (cell_id + 100) + 1 AS parent FROM fx_cells UNION ALL SELECT 2 * (cell_id + 100) + 1, 2 * region_id + 1 FROM fx_cells",
)
_add(
    "region_tree_costs",
    lambda s, d: RegionTree(star_schema(s, d)).costs().select("pixel", F.round("cost", 9).alias("cost")),
    f"{base_sql()}, {_TREE} SELECT pixel, round(CASE WHEN id >= 100 THEN 1 ELSE 100 END * (1.0::DOUBLE / (1 + n_items)), 9) AS cost FROM tn WHERE is_region",
)
