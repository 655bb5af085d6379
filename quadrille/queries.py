"""Registered queries on the star schema's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.engine import Engine, Index
from quadrille.functions.grid import make_grid
from quadrille.operators import build, compare, hierarchy, results, statistics
from quadrille.sources.dataset import star_schema

LEVEL = 4
Query = Callable[[SparkSession, str], DataFrame]


def index(spark: SparkSession, sf_dir: str, grid: str = "simplegrid", level: int = LEVEL) -> Index:
    return Engine(spark).build_index(star_schema(spark, sf_dir), grid, level)


# SQL for the derived tables, built from the definitions of the dataset.
_CELLS = """fx_cells AS (
  SELECT CAST(n_nationkey AS BIGINT) AS cell_id, CAST(n_regionkey AS BIGINT) AS region_id,
         CAST(-90000 + 36000 * (n_nationkey % 5) AS BIGINT) AS lat_lo,
         CAST(-180000 + 72000 * ((n_nationkey - n_nationkey % 5) / 5) AS BIGINT) AS lon_lo FROM nation)"""
_POINTS = """fx_points AS (
  SELECT CAST(c_custkey AS BIGINT) AS item_id, cell_id,
         lat_lo + (c_custkey * 7919) % 36000 AS lat_m, lon_lo + (c_custkey * 104729) % 72000 AS lon_m
  FROM customer JOIN fx_cells ON cell_id = c_nationkey
  UNION ALL
  SELECT DISTINCT 10000000 + l_partkey AS item_id, cell_id,
         lat_lo + (l_partkey * 7919 + s_suppkey * 31) % 36000 AS lat_m, lon_lo + (l_partkey * 104729 + s_suppkey * 17) % 72000 AS lon_m
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN fx_cells ON cell_id = s_nationkey WHERE l_linenumber = 1)"""
_TEXT = """fx_item_text AS (
  SELECT DISTINCT item_id, tok FROM (
    SELECT CAST(c_custkey AS BIGINT) AS item_id, lower(c_mktsegment) AS tok FROM customer
    UNION ALL SELECT CAST(c_custkey AS BIGINT), lower(c_name) FROM customer
    UNION ALL SELECT 10000000 + p_partkey, lower(split_part(p_name, ' ', 1)) FROM part
    UNION ALL SELECT 10000000 + p_partkey, lower(split_part(p_name, ' ', 2)) FROM part
    UNION ALL SELECT 10000000 + p_partkey, lower(p_type) FROM part) t),
fx_region_text AS (
  SELECT CAST(n_nationkey AS BIGINT) AS cell_id, lower(n_name) AS tok FROM nation
  UNION ALL SELECT CAST(n_nationkey AS BIGINT), lower(r_name) FROM nation JOIN region ON r_regionkey = n_regionkey)"""


def _pixel_sql(level: int) -> str:
    n = 1 << level
    row, column = f"CAST(floor((lat_m + 90000) * {n} / 180000) AS BIGINT)", f"CAST(floor((lon_m + 180000) * {n} / 360000) AS BIGINT)"
    bits = [f"(({row} >> {b}) % 2) * {1 << (2 * b + 1)} + (({column} >> {b}) % 2) * {1 << (2 * b)}" for b in range(level)]
    return " + ".join([str(n * n), *bits])


def base_sql(level: int = LEVEL) -> str:
    pci = f"fx_pci AS (SELECT DISTINCT CAST({_pixel_sql(level)} AS BIGINT) AS pixel, cell_id, CAST(item_id AS BIGINT) AS item_id FROM fx_points)"
    return f"WITH {_CELLS},\n{_POINTS},\n{_TEXT},\n{pci}"


_MATCH = {"exact": "tok = '{0}'", "prefix": "starts_with(tok, '{0}')", "suffix": "ends_with(tok, '{0}')", "substring": "contains(tok, '{0}')"}


def leaf_sql(text: str, mode: str, key: str, part: str = "all") -> str:
    """(cell, item_id) of a text leaf: the cells of matching regions, and matching items in other cells."""
    m = _MATCH[mode].format(text)
    regions = f"SELECT {key} AS cell, item_id FROM fx_pci WHERE cell_id IN (SELECT cell_id FROM fx_region_text WHERE {m})"
    items = f"SELECT {key} AS cell, item_id FROM fx_pci WHERE item_id IN (SELECT item_id FROM fx_item_text WHERE {m}) AND cell_id NOT IN (SELECT cell_id FROM fx_region_text WHERE {m})"
    return {"all": f"({regions} UNION {items})", "regions": f"(SELECT DISTINCT * FROM ({regions}))", "items": f"(SELECT DISTINCT * FROM ({items}))"}[part]


def _set_sql(op: str, a: str, b: str) -> str:
    if op == "^":
        return f"(({a} EXCEPT {b}) UNION ({b} EXCEPT {a}))"
    return f"({a} {({'+': 'UNION', '/': 'INTERSECT', '-': 'EXCEPT'})[op]} {b})"


def flat(df: DataFrame) -> DataFrame:
    """Arrays as text, null as empty: a registered query's rows compare by plain values."""
    return df.select(*(F.coalesce(F.array_join(c, ","), F.lit("")).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes))


QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def _pairs(text: str, backend: str = "pixel", level: int = LEVEL) -> Query:
    return lambda spark, d: index(spark, d, level=level).query(text, backend).pairs


# The flagship: items named red in Asia, as cells with their full or partial match.
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(index(spark, sf_dir).query('"asia" / "red"').cqr())


_FLAGSHIP = _set_sql("/", leaf_sql("asia", "exact", "pixel"), leaf_sql("red", "exact", "pixel"))
_RED_RODS = _set_sql("/", _FLAGSHIP, leaf_sql("rod", "exact", "pixel"))
_TOTALS = "SELECT {key} AS cell, count(DISTINCT item_id) AS n_total FROM fx_pci GROUP BY 1"
_add("asia_red_rod", _pairs('"asia" / "red" / "rod"'), f"{base_sql()} SELECT cell, item_id FROM {_RED_RODS}")
_add(
    "cqr_presented",
    flagship,
    f"""{base_sql()}, r AS (SELECT * FROM {_FLAGSHIP}), t AS ({_TOTALS.format(key='pixel')})
SELECT cell, count(*) = any_value(n_total) AS is_full,
       CASE WHEN count(*) < any_value(n_total) THEN string_agg(item_id, ',' ORDER BY item_id) ELSE '' END AS items FROM r JOIN t USING (cell) GROUP BY cell""",
)

# Index build.
_add("pci_build", lambda s, d: index(s, d).pci, f"{base_sql()} SELECT pixel, cell_id, item_id FROM fx_pci")
_add("cell_pixels", lambda s, d: build.cell_pixels(index(s, d).pci), f"{base_sql()} SELECT DISTINCT cell_id, pixel FROM fx_pci")
_add("cell_items", lambda s, d: star_schema(s, d).cell_items(), f"{base_sql()} SELECT DISTINCT cell_id, CAST(item_id AS BIGINT) AS item_id FROM fx_points")
_add("pixel_totals", lambda s, d: index(s, d).totals("pixel"), f"{base_sql()} {_TOTALS.format(key='pixel')}")
_add("cell_totals", lambda s, d: index(s, d).totals("cell_id"), f"{base_sql()} {_TOTALS.format(key='cell_id')}")
_add(
    "item_postings",
    lambda s, d: star_schema(s, d).item_text,
    f"{base_sql()} SELECT CAST(item_id AS BIGINT) AS item_id, tok FROM fx_item_text",
)


#: Moves points out of their cells, so that some lie in other cells and some in none.
SHIFT_LAT, SHIFT_LON = 20_000, 25_000


def _shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = star_schema(spark, sf_dir)
    moved = d.points.select("item_id", (F.col("lat_m") + SHIFT_LAT).alias("lat_m"), (F.col("lon_m") + SHIFT_LON).alias("lon_m")).distinct()
    return build.located(moved, d.cells)


_add(
    "point_in_cell",
    _shifted,
    f"""{base_sql()}, m AS (SELECT DISTINCT CAST(item_id AS BIGINT) AS item_id, lat_m + {SHIFT_LAT} AS lat_m, lon_m + {SHIFT_LON} AS lon_m FROM fx_points)
SELECT item_id, CAST(m.lat_m AS BIGINT) AS lat_m, CAST(m.lon_m AS BIGINT) AS lon_m, coalesce(cell_id, 0) AS cell_id FROM m LEFT JOIN fx_cells c
ON m.lat_m >= c.lat_lo AND m.lat_m < c.lat_lo + 36000 AND m.lon_m >= c.lon_lo AND m.lon_m < c.lon_lo + 72000""",
)


def _geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = star_schema(spark, sf_dir)
    items = d.points.groupBy("item_id").agg(F.collect_list(F.struct("lat_m", "lon_m")).alias("points"), F.collect_set("cell_id").alias("cells"))
    return Engine(spark).geometry(items, d.cells, "simplegrid", LEVEL)


_add("pci_from_geometry", _geometry, f"{base_sql()} SELECT pixel, cell_id, item_id FROM fx_pci")
_add(
    "region_items",
    lambda s, d: build.region_items((x := star_schema(s, d)).region_cells, x.cell_items()),
    f"""{base_sql()}, rc AS (SELECT region_id, cell_id FROM fx_cells UNION ALL SELECT cell_id + 100, cell_id FROM fx_cells)
SELECT DISTINCT rc.region_id, CAST(item_id AS BIGINT) AS item_id FROM rc JOIN fx_points USING (cell_id)""",
)

# Text predicates.
for _name, _text, _leaf in (
    ("exact", '"red"', ("red", "exact")),
    ("prefix", "asi?", ("asi", "prefix")),
    ("suffix", "?ica", ("ica", "suffix")),
    ("substring", "ro", ("ro", "substring")),
):
    _add(f"text_{_name}", _pairs(_text), f"{base_sql()} SELECT cell, item_id FROM {leaf_sql(*_leaf, 'pixel')}")
_add("text_no_match", _pairs('"nope"'), f"{base_sql()} SELECT cell, item_id FROM {leaf_sql('nope', 'exact', 'pixel')}")
_add("text_folded_case", _pairs('"RED"'), f"{base_sql()} SELECT cell, item_id FROM {leaf_sql('red', 'exact', 'pixel')}")
_add("text_blank_in_token", _pairs('"middle east"'), f"{base_sql()} SELECT cell, item_id FROM {leaf_sql('middle east', 'exact', 'pixel')}")
_add("items_only", _pairs("@ro"), f"{base_sql()} SELECT cell, item_id FROM {leaf_sql('ro', 'substring', 'pixel', 'items')}")
_add("regions_only", _pairs("#a"), f"{base_sql()} SELECT cell, item_id FROM {leaf_sql('a', 'substring', 'pixel', 'regions')}")
_add("empty_query", _pairs(""), f"{base_sql()} SELECT pixel AS cell, item_id FROM fx_pci WHERE false")

# Set operators, on cells and on pixels.
for _key, _backend in (("cell_id", "cell"), ("pixel", "pixel")):
    for _op, _name in (("+", "union"), ("/", "intersect"), ("-", "diff"), ("^", "symdiff")):
        _sql = _set_sql(_op, leaf_sql("asia", "exact", _key), leaf_sql("re", "prefix", _key))
        _add(f"op_{_name}_{_backend}", _pairs(f'"asia" {_op} re?', _backend), f"{base_sql()} SELECT cell, item_id FROM {_sql}")
_NATIONS = [_set_sql("/", leaf_sql("nation_0", "exact", k), leaf_sql("nation_1", "exact", k)) for k in ("cell_id", "pixel")]
# Two nations share no cell, so that by cell only the third one's items are left.
for _key, _backend, _both in (("cell_id", "cell", _NATIONS[0]), ("pixel", "pixel", _NATIONS[1])):
    _sql = _set_sql("+", _both, leaf_sql("nation_7", "exact", _key))
    _add(f"neighbours_by_{_backend}", _pairs('("nation_0" / "nation_1") + "nation_7"', _backend, 2), f"{base_sql(2)} SELECT cell, item_id FROM {_sql}")


def _full_sql(inner: str, key: str) -> str:
    return f"(SELECT DISTINCT {key} AS cell, item_id FROM fx_pci WHERE {key} IN (SELECT cell FROM {inner}))"


_add("fm_conversion", _pairs('% ("red" / "rod")'), f"{base_sql()} SELECT cell, item_id FROM {_full_sql(_set_sql('/', leaf_sql('red', 'exact', 'pixel'), leaf_sql('rod', 'exact', 'pixel')), 'pixel')}")
_NESTED = _set_sql(
    "-",
    _set_sql("/", _set_sql("+", leaf_sql("asia", "exact", "pixel"), leaf_sql("ame", "prefix", "pixel")), _set_sql("^", leaf_sql("ro", "substring", "pixel"), leaf_sql("een", "suffix", "pixel"))),
    _full_sql(_set_sql("/", leaf_sql("red", "exact", "pixel"), leaf_sql("rod", "exact", "pixel", "items")), "pixel"),
)
#: The query and its SQL.
_FULL_NESTED = ('("asia" + ame?) / (ro ^ ?een) - % ("red" / @"rod")', _NESTED)
_add("nested_expr", _pairs(_FULL_NESTED[0]), f"{base_sql()} SELECT cell, item_id FROM {_NESTED}")
_add("cell_leaf", _pairs("$cell:7", "cell"), f"{base_sql()} SELECT DISTINCT cell_id AS cell, item_id FROM fx_pci WHERE cell_id = 7")
_add("region_leaf", _pairs("$region:2", "cell"), f"{base_sql()} SELECT DISTINCT cell_id AS cell, item_id FROM fx_pci WHERE cell_id IN (SELECT cell_id FROM fx_cells WHERE region_id = 2)")

# Results.
_BROAD = _set_sql("+", leaf_sql("asia", "exact", "pixel"), leaf_sql("re", "prefix", "pixel"))
_add(
    "cqr_classified",
    lambda s, d: results.classified((r := index(s, d).query('"asia" + re?')).pairs, r.index.totals("pixel")),
    f"""{base_sql()}, r AS (SELECT * FROM {_BROAD}), t AS ({_TOTALS.format(key='pixel')})
SELECT cell, count(*) = any_value(n_total) AS is_full, count(*) AS n_items FROM r JOIN t USING (cell) GROUP BY cell""",
)
_add("flatten_items", lambda s, d: index(s, d).query('"asia" + re?').flatten(), f"{base_sql()} SELECT DISTINCT item_id FROM {_BROAD}")
_add(
    "result_stats",
    lambda s, d: index(s, d).query('"asia" + re?').stats(),
    f"{base_sql()} SELECT count(*) AS n_pairs, count(DISTINCT cell) AS n_cells, count(DISTINCT item_id) AS n_items FROM {_BROAD}",
)

# Statistics of the index.
_add("pixel_stats", lambda s, d: statistics.pixel_counts(index(s, d).pci), f"{base_sql()} SELECT pixel, count(*) AS n_entries, count(DISTINCT cell_id) AS n_cells FROM fx_pci GROUP BY pixel")
_add(
    "index_stats",
    lambda s, d: index(s, d).stats(),
    f"""{base_sql()}, c AS (SELECT pixel, count(*) AS e, count(DISTINCT cell_id) AS k FROM fx_pci GROUP BY pixel)
SELECT count(*) AS n_pixels, min(e) AS min_entries, max(e) AS max_entries, CAST(sum(e) AS BIGINT) AS sum_entries,
       min(k) AS min_cells, max(k) AS max_cells, CAST(sum(k) AS BIGINT) AS sum_cells FROM c""",
)


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


_add(
    "pixel_summary",
    lambda s, d: _rounded(statistics.summary(statistics.pixel_counts(index(s, d).pci), "n_entries")),
    f"""{base_sql()}, c AS (SELECT CAST(count(*) AS DOUBLE) AS e FROM fx_pci GROUP BY pixel)
SELECT count(*) AS n, round(min(e), 6) AS least, round(max(e), 6) AS greatest, round(sum(e), 6) AS total, round(avg(e), 6) AS mean,
       round(stddev_pop(e), 6) AS deviation, round(median(e), 6) AS median FROM c""",
)

# Comparison.
_CELL_BROAD = _set_sql("/", leaf_sql("re", "prefix", "cell_id"), leaf_sql("ro", "substring", "cell_id"))
_PIXEL_BROAD = _set_sql("/", leaf_sql("re", "prefix", "pixel"), leaf_sql("ro", "substring", "pixel"))
_add(
    "diff_cell_vs_pixel",
    lambda s, d: (i := index(s, d, level=2)).query('"nation_0" / "nation_1"', "cell").diff(i.query('"nation_0" / "nation_1"', "pixel")),
    f"""{base_sql(2)}, a AS (SELECT DISTINCT item_id FROM {_NATIONS[0]}), b AS (SELECT DISTINCT item_id FROM {_NATIONS[1]}),
n AS (SELECT (SELECT count(*) FROM (FROM a INTERSECT FROM b)) AS n_both, (SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS n_only_a,
      (SELECT count(*) FROM (FROM b EXCEPT FROM a)) AS n_only_b)
SELECT n_only_a + n_only_b = 0 AS equal, n_both, n_only_a, n_only_b FROM n""",
)


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six differences: pixels and cells, each flat, deferred (the same plan here) and hierarchical."""
    i = index(spark, sf_dir)
    by = {name: i.query("re? / ro", backend).pairs for name, backend in (("sq", "pixel"), ("hsq", "hier"), ("oq", "cell"), ("hoq", "region"))}
    by |= {"tsq": by["sq"], "toq": by["oq"]}
    return flat(compare.difference_matrix(by, [("sq", "tsq"), ("sq", "hsq"), ("oq", "toq"), ("oq", "hoq"), ("sq", "oq"), ("hsq", "hoq")]))


_add(
    "diff_matrix",
    _matrix,
    f"""{base_sql()}, s AS (SELECT DISTINCT item_id FROM {_PIXEL_BROAD}), o AS (SELECT DISTINCT item_id FROM {_CELL_BROAD}),
x AS ((FROM s EXCEPT FROM o) UNION (FROM o EXCEPT FROM s)), k AS (SELECT count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS l FROM x),
p AS (SELECT * FROM (VALUES ('sq','tsq',0),('sq','hsq',0),('oq','toq',0),('oq','hoq',0),('sq','oq',1),('hsq','hoq',1)) v(a, b, other))
SELECT a, b, CASE WHEN other = 1 THEN n ELSE 0 END AS n_different,
       CASE WHEN other = 1 AND n > 0 AND n < 10 THEN l ELSE '' END AS items FROM p, k""",
)

# The simple grid's functions, on every pixel of three levels.


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = star_schema(spark, sf_dir).points
    rows = None
    for level in (0, 2, 5):
        own = points.select(make_grid("simplegrid", level).index(F.col("lat_m"), F.col("lon_m")).alias("pixel")).distinct()
        rows = own if rows is None else rows.unionByName(own)
    return rows


_PIXELS = ", ".join(f"p{n} AS (SELECT DISTINCT CAST({_pixel_sql(n)} AS BIGINT) AS pixel FROM fx_points)" for n in (0, 2, 5))
_PIXELS += ", px AS (FROM p0 UNION ALL FROM p2 UNION ALL FROM p5), lv AS (SELECT pixel, (length(bin(pixel)) - 1) // 2 AS lvl FROM px)"
_G = make_grid("simplegrid", 5)

_add("grid_level", lambda s, d: _pixels(s, d).select("pixel", _G.level(F.col("pixel")).alias("level")), f"{base_sql()}, {_PIXELS} SELECT pixel, CAST(lvl AS INTEGER) AS level FROM lv")
_add("grid_parent", lambda s, d: _pixels(s, d).where("pixel > 1").select("pixel", _G.parent(F.col("pixel")).alias("parent")), f"{base_sql()}, {_PIXELS} SELECT pixel, pixel >> 2 AS parent FROM px WHERE pixel > 1")
_add(
    "grid_children",
    lambda s, d: _pixels(s, d).select("pixel", F.explode(F.sequence(F.lit(0), _G.children_count(F.col("pixel")) - 1)).alias("n")).select("pixel", _G.child(F.col("pixel"), F.col("n")).alias("child"), _G.child_position(_G.child(F.col("pixel"), F.col("n"))).alias("position")),
    f"{base_sql()}, {_PIXELS} SELECT pixel, pixel * 4 + n AS child, CAST(n AS INTEGER) AS position FROM px, (SELECT CAST(range AS BIGINT) AS n FROM range(4))",
)
_add(
    "grid_ancestors",
    lambda s, d: _pixels(s, d).select("pixel", F.explode(F.sequence(F.lit(0), _G.level(F.col("pixel")))).alias("up")).select("pixel", _G.ancestor(F.col("pixel"), F.col("up")).alias("ancestor"), _G.is_ancestor(_G.ancestor(F.col("pixel"), F.col("up")), F.col("pixel")).alias("is_ancestor")),
    f"{base_sql()}, {_PIXELS} SELECT pixel, pixel >> CAST(2 * up AS BIGINT) AS ancestor, up > 0 OR pixel = 1 AS is_ancestor FROM (SELECT pixel, unnest(range(0, lvl + 1)) AS up FROM lv)",
)
_BOX_ROWS = " + ".join(f"(((pixel >> {2 * b + 1}) % 2) * {1 << b})" for b in range(5))
_BOX_COLUMNS = " + ".join(f"(((pixel >> {2 * b}) % 2) * {1 << b})" for b in range(5))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pixels(spark, sf_dir).where("pixel > 1")
    return rows.select("pixel", _G.bbox(F.col("pixel")).alias("b")).select("pixel", "b.*")


_add(
    "grid_bbox",
    _boxes,
    f"""{base_sql()}, {_PIXELS}, rc AS (SELECT pixel, lvl, ({_BOX_ROWS}) % (1 << CAST(lvl AS BIGINT)) AS r, ({_BOX_COLUMNS}) % (1 << CAST(lvl AS BIGINT)) AS c, CAST(1 << CAST(lvl AS BIGINT) AS DOUBLE) AS n FROM lv WHERE pixel > 1)
SELECT pixel, r * 180.0 / n - 90.0 AS lat_lo, (r + 1) * 180.0 / n - 90.0 AS lat_hi, c * 360.0 / n - 180.0 AS lon_lo, (c + 1) * 360.0 / n - 180.0 AS lon_hi FROM rc""",
)

# Hierarchy.
_HIER = '"asia" + "europe"'
_HIER_SQL = _set_sql("+", leaf_sql("asia", "exact", "pixel"), leaf_sql("europe", "exact", "pixel"))


def _nodes_sql(result: str, level: int = LEVEL, above: str = "pixel >> (2 * up)") -> str:
    """above: SQL of the ancestor, `up` levels above a leaf `pixel`."""
    ups = f"(SELECT CAST(range AS BIGINT) AS up FROM range({level + 1}))"
    return f"""r AS (SELECT cell AS pixel, item_id FROM {result}),
e AS (SELECT DISTINCT pixel, item_id FROM fx_pci),
got AS (SELECT {above} AS pixel, {level} - up AS level, count(*) AS n FROM r, {ups} GROUP BY ALL),
tot AS (SELECT {above} AS pixel, {level} - up AS level, count(*) AS n FROM e, {ups} GROUP BY ALL),
f AS (SELECT got.pixel, got.level FROM got JOIN tot ON got.pixel = tot.pixel AND got.level = tot.level AND got.n = tot.n),
best AS (SELECT l.pixel AS leaf, arg_min(f.pixel, f.level) AS pixel, min(f.level) AS level FROM (SELECT pixel, {above} AS a, {level} - up AS lv FROM (SELECT DISTINCT pixel FROM r), {ups}) l JOIN f ON f.pixel = l.a AND f.level = l.lv GROUP BY l.pixel),
nodes AS (
  SELECT DISTINCT pixel, CAST(level AS INTEGER) AS level, true AS is_full, CAST(NULL AS BIGINT[]) AS items FROM best
  UNION ALL SELECT pixel, {level}, false, list(item_id ORDER BY item_id) FROM r WHERE pixel NOT IN (SELECT leaf FROM best) GROUP BY pixel)"""


_FLAT_NODES = "pixel, level, is_full, coalesce(array_to_string(items, ','), '') AS items"
_add("hcqr_compact", lambda s, d: flat(index(s, d).query(_HIER, "hier").hcqr()), f"{base_sql()}, {_nodes_sql(_HIER_SQL)} SELECT {_FLAT_NODES} FROM nodes")
_add(
    "hcqr_leaves",
    lambda s, d: flat(index(s, d).query(_HIER, "hier", compact=False).hcqr()),
    f"""{base_sql()}, r AS (SELECT * FROM {_HIER_SQL}), t AS ({_TOTALS.format(key='pixel')})
SELECT cell AS pixel, {LEVEL} AS level, count(*) = any_value(n_total) AS is_full,
       CASE WHEN count(*) < any_value(n_total) THEN string_agg(item_id, ',' ORDER BY item_id) ELSE '' END AS items FROM r JOIN t USING (cell) GROUP BY cell""",
)
_add(
    "hcqr_nodes",
    lambda s, d: hierarchy.tree_size((r := index(s, d).query(_HIER, "hier")).hcqr(), r.index.grid),
    f"""{base_sql()}, {_nodes_sql(_HIER_SQL)},
every AS (SELECT DISTINCT pixel >> (2 * CAST(up AS BIGINT)) AS pixel FROM (SELECT pixel, unnest(range(0, level + 1)) AS up FROM nodes))
SELECT CAST(max(level) AS INTEGER) AS depth, (SELECT count(*) FROM every) AS n_nodes, count(*) AS n_leaves FROM nodes""",
)


def _hier_setop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference of two hierarchical results, as a hierarchy."""
    i = index(spark, sf_dir)
    return flat(i.query(_HIER, "hier").combined("-", i.query("re?", "hier")).hcqr())


_add("hcqr_setop", _hier_setop, f"{base_sql()}, {_nodes_sql(_set_sql('-', _HIER_SQL, leaf_sql('re', 'prefix', 'pixel')))} SELECT {_FLAT_NODES} FROM nodes")
_add(
    "hcqr_items",
    lambda s, d: hierarchy.items((r := index(s, d).query(_HIER, "hier")).hcqr(), r.index.pci, r.index.grid, LEVEL),
    f"{base_sql()} SELECT DISTINCT item_id FROM {_HIER_SQL}",
)
_add(
    "hcqr_merged",
    lambda s, d: flat(hierarchy.merged_partials((r := index(s, d).query(_HIER, "hier")).hcqr(), r.index.grid, 2)),
    f"""{base_sql()}, {_nodes_sql(_HIER_SQL)}
SELECT {_FLAT_NODES} FROM nodes WHERE is_full OR level <= 2
UNION ALL SELECT pixel, 2, false, string_agg(item_id, ',' ORDER BY item_id) FROM (
  SELECT DISTINCT pixel >> CAST(2 * (level - 2) AS BIGINT) AS pixel, unnest(items) AS item_id FROM nodes WHERE NOT is_full AND level > 2) GROUP BY pixel""",
)
_CELL_HIER = _set_sql("+", leaf_sql("asia", "exact", "cell_id"), leaf_sql("re", "prefix", "cell_id"))
_add(
    "region_cover",
    lambda s, d: index(s, d).query('"asia" + re?', "region").hcqr(),
    f"""{base_sql()}, r AS (SELECT cell, count(*) AS n FROM {_CELL_HIER} GROUP BY cell), t AS ({_TOTALS.format(key='cell_id')}),
c AS (SELECT cell, n, n = n_total AS is_full FROM r JOIN t USING (cell)),
g AS (SELECT region_id, count(*) = count(CASE WHEN is_full THEN 1 END) AS whole FROM fx_cells LEFT JOIN c ON cell = cell_id GROUP BY region_id)
SELECT 'region' AS kind, region_id AS id, true AS is_full, count(DISTINCT item_id) AS n_items
FROM fx_cells JOIN g USING (region_id) JOIN fx_pci USING (cell_id) WHERE whole GROUP BY region_id
UNION ALL SELECT CASE WHEN is_full THEN 'region' ELSE 'cell' END, CASE WHEN is_full THEN cell + 100 ELSE cell END, is_full, n
FROM c JOIN fx_cells ON cell = cell_id JOIN g USING (region_id) WHERE NOT whole""",
)
