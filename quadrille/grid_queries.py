"""Registered queries on the grids of spherical geometry, and the same in DuckDB SQL.

The SQL places points by its own route: a chain of steps, one a level, from the root
triangle or the face of the cube down. Ids are checked from the components that they
are made of. H3's unfolding of the icosahedron has no SQL here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import h3, s2
from quadrille.functions.grid import make_grid
from quadrille.functions.htm import CORNERS, ROOTS
from quadrille.functions.simple import EARTH_RADIUS_KM
from quadrille.operators import statistics
from quadrille.queries import _HIER, _TOTALS, Query, _add, _CELLS, _nodes_sql, _POINTS, _rounded, _set_sql, _TEXT, base_sql, flat, index, leaf_sql

_XYZ = "xyz"


def _points_sql() -> str:
    lat, lon = "radians(CAST(lat_m AS DOUBLE) / 1000)", "radians(CAST(lon_m AS DOUBLE) / 1000)"
    return f"pt AS (SELECT DISTINCT lat_m, lon_m, cos({lat}) * cos({lon}) AS x, cos({lat}) * sin({lon}) AS y, sin({lat}) AS z FROM fx_points)"


def _cross(a: str, b: str) -> tuple[str, str, str]:
    return tuple(f"({a}{_XYZ[(k + 1) % 3]} * {b}{_XYZ[(k + 2) % 3]} - {a}{_XYZ[(k + 2) % 3]} * {b}{_XYZ[(k + 1) % 3]})" for k in range(3))


def htm_sql(level: int) -> str:
    """px(lat_m, lon_m, pixel) and the corners j, k, l of the triangles."""
    roots = ", ".join(f"({r}, {', '.join(str(float(v)) for corner in ROOTS[r] for v in CORNERS[corner])})" for r in range(8))
    columns = ", ".join(f"{c}{k}" for c in "jkl" for k in _XYZ)
    south = "CASE WHEN y >= 0 THEN CASE WHEN x >= 0 THEN 0 ELSE 1 END ELSE CASE WHEN x >= 0 THEN 3 ELSE 2 END END"
    north = "CASE WHEN y >= 0 THEN CASE WHEN x >= 0 THEN 7 ELSE 6 END ELSE CASE WHEN x >= 0 THEN 4 ELSE 5 END END"
    steps = [
        _points_sql(),
        f"rt(r, {columns}) AS (VALUES {roots})",
        f"h0 AS (SELECT lat_m, lon_m, x, y, z, CAST(r + 8 AS BIGINT) AS id, {columns} FROM (SELECT *, CASE WHEN z < 0 THEN {south} ELSE {north} END AS r FROM pt) JOIN rt USING (r))",
    ]
    inside = lambda a, b: " + ".join(f"{c} * {k}" for c, k in zip(_cross(a, b), _XYZ)) + " >= 0"
    of = {"j": ("j", "k", "l", "u"), "k": ("w", "u", "v", "v"), "l": ("v", "w", "u", "w")}
    for n in range(level - 1):
        sums = ", ".join(f"{p}{k} + {q}{k} AS s{m}{k}" for m, p, q in (("u", "k", "l"), ("v", "j", "l"), ("w", "j", "k")) for k in _XYZ)
        units = ", ".join(f"s{m}{k} / sqrt(s{m}x * s{m}x + s{m}y * s{m}y + s{m}z * s{m}z) AS {m}{k}" for m in "uvw" for k in _XYZ)
        corner = ", ".join(f"CASE n WHEN 0 THEN {o[0]}{k} WHEN 1 THEN {o[1]}{k} WHEN 2 THEN {o[2]}{k} ELSE {o[3]}{k} END AS {c}{k}" for c, o in of.items() for k in _XYZ)
        steps.append(f"m{n} AS (SELECT *, {units} FROM (SELECT *, {sums} FROM h{n}))")
        steps.append(f"n{n} AS (SELECT *, CASE WHEN {inside('w', 'v')} THEN 0 WHEN {inside('u', 'w')} THEN 1 WHEN {inside('v', 'u')} THEN 2 ELSE 3 END AS n FROM m{n})")
        steps.append(f"h{n + 1} AS (SELECT lat_m, lon_m, x, y, z, id * 4 + n AS id, {corner} FROM n{n})")
    steps.append(f"px AS (SELECT lat_m, lon_m, id AS pixel, {columns} FROM h{level - 1})")
    return ",\n".join(steps)


def _listed(rows) -> str:
    return str(rows.tolist())


def _signed(wide: str) -> str:
    """A 64-bit pattern, computed in 128 bits, as BIGINT."""
    return f"CAST(CASE WHEN {wide} >= CAST(9223372036854775808 AS HUGEINT) THEN {wide} - CAST(18446744073709551616 AS HUGEINT) ELSE {wide} END AS BIGINT)"


def _s2_id(position: str, native: str) -> str:
    return _signed(f"((CAST({position} AS HUGEINT) * 2 + 1) * CAST(pow(4, {s2.LEVELS} - ({native})) AS HUGEINT))")


def s2_sql(level: int) -> str:
    """px(lat_m, lon_m, pixel, face, i, j) with i and j of the cell at its level."""
    native = level - 1
    faces = ("y / x, z / x", "-x / y, z / y", "-x / z, -y / z", "z / x, y / x", "z / y, -x / y", "-y / z, -x / z")
    uv = [" ".join(f"WHEN {k} THEN {f.split(', ')[n]}" for k, f in enumerate(faces)) for n in range(2)]
    axis = "CASE WHEN abs(x) >= abs(y) AND abs(x) >= abs(z) THEN CASE WHEN x < 0 THEN 3 ELSE 0 END WHEN abs(y) >= abs(z) THEN CASE WHEN y < 0 THEN 4 ELSE 1 END ELSE CASE WHEN z < 0 THEN 5 ELSE 2 END END"
    st = lambda c: f"CASE WHEN {c} >= 0 THEN 0.5::DOUBLE * sqrt(1 + 3 * abs({c})) ELSE 1 - 0.5::DOUBLE * sqrt(1 + 3 * abs({c})) END"
    size = 1 << s2.LEVELS
    ij = lambda c: f"CAST(greatest(0, least({size - 1}, floor(({st(c)}) * {size}))) AS BIGINT)"
    steps = [
        _points_sql(),
        f"fc AS (SELECT lat_m, lon_m, face, CASE face {uv[0]} END AS u, CASE face {uv[1]} END AS w FROM (SELECT *, {axis} AS face FROM pt))",
        f"g0 AS (SELECT lat_m, lon_m, face, {ij('u')} AS i, {ij('w')} AS j, CAST(face AS BIGINT) AS position, face % 2 AS turn FROM fc)",
    ]
    for n in range(native):
        k = s2.LEVELS - 1 - n
        place = f"{_listed(s2.IJ_TO_POSITION)}[turn + 1][((i >> {k}) % 2) * 2 + ((j >> {k}) % 2) + 1]"
        steps.append(f"q{n} AS (SELECT *, {place} AS p FROM g{n})")
        steps.append(f"g{n + 1} AS (SELECT lat_m, lon_m, face, i, j, position * 4 + p AS position, xor(CAST(turn AS BIGINT), CAST({_listed(s2.TURN)}[p + 1] AS BIGINT)) AS turn FROM q{n})")
    shift = s2.LEVELS - native
    steps.append(f"px AS (SELECT lat_m, lon_m, {_s2_id('position', str(native))} AS pixel, face, i >> {shift} AS i, j >> {shift} AS j FROM g{native})")
    return ",\n".join(steps)


def _s2_above(level: int) -> str:
    """The ancestor `up` levels above a leaf `pixel` of the level; the root is -1."""
    wide = "(CASE WHEN pixel < 0 THEN CAST(pixel AS HUGEINT) + CAST(18446744073709551616 AS HUGEINT) ELSE CAST(pixel AS HUGEINT) END)"
    position = f"({wide} // CAST(pow(2, {2 * (s2.LEVELS - level + 1) + 1}) AS HUGEINT)) // CAST(pow(4, up) AS HUGEINT)"
    return f"CASE WHEN up = {level} THEN CAST(-1 AS BIGINT) ELSE {_s2_id(position, f'{level - 1} - least(up, {level - 1})')} END"


_HTM_ABOVE = "CASE WHEN up = {level} THEN CAST(0 AS BIGINT) ELSE pixel >> (2 * up) END"


def grid_sql(placed: str) -> str:
    """The derived tables with fx_pci on another grid, whose px holds the pixel of each point."""
    return f"WITH {_CELLS},\n{_POINTS},\n{_TEXT},\n{placed},\nfx_pci AS (SELECT DISTINCT pixel, cell_id, CAST(item_id AS BIGINT) AS item_id FROM fx_points JOIN px USING (lat_m, lon_m))"


_PCI = " SELECT pixel, cell_id, item_id FROM fx_pci"
_NODES = " SELECT pixel, level, is_full, coalesce(array_to_string(items, ','), '') AS items FROM nodes"
_BOTH = _set_sql("+", leaf_sql("asia", "exact", "pixel"), leaf_sql("europe", "exact", "pixel"))
_ASIA_RED = _set_sql("/", leaf_sql("asia", "exact", "pixel"), leaf_sql("red", "exact", "pixel"))

_add("htm_index", lambda s, d: index(s, d, "htm", 8).pci, grid_sql(htm_sql(8)) + _PCI)
_add("s2_index", lambda s, d: index(s, d, "s2geom", 8).pci, grid_sql(s2_sql(8)) + _PCI)
_add("h3_index", lambda s, d: index(s, d, "h3", 6).pci)
_add("h3_hcqr", lambda s, d: flat(index(s, d, "h3", 4).query(_HIER, "hier").hcqr()))
_add(
    "htm_query",
    lambda s, d: flat(index(s, d, "htm", 6).query('"asia" / "red"').cqr()),
    f"""{grid_sql(htm_sql(6))}, r AS (SELECT * FROM {_ASIA_RED}), t AS ({_TOTALS.format(key='pixel')})
SELECT cell, count(*) = any_value(n_total) AS is_full,
       CASE WHEN count(*) < any_value(n_total) THEN string_agg(item_id, ',' ORDER BY item_id) ELSE '' END AS items FROM r JOIN t USING (cell) GROUP BY cell""",
)
_add("htm_hcqr", lambda s, d: flat(index(s, d, "htm", 6).query(_HIER, "hier").hcqr()), f"{grid_sql(htm_sql(6))}, {_nodes_sql(_BOTH, 6, _HTM_ABOVE.format(level=6))}{_NODES}")
_add("s2_hcqr", lambda s, d: flat(index(s, d, "s2geom", 6).query(_HIER, "hier").hcqr()), f"{grid_sql(s2_sql(6))}, {_nodes_sql(_BOTH, 6, _s2_above(6))}{_NODES}")


# Areas: level, number of pixels, and least, mean and greatest area.
def _areas(name: str, level: int) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        i = index(spark, sf_dir, name, level)
        return _rounded(statistics.area_summary(i.pci, i.grid), 3)

    return query


def _area_sql(level: int, area: str) -> str:
    """area: SQL of (pixel, area)."""
    return f"SELECT {level} AS level, count(*) AS n_pixels, round(min(area), 3) AS min_km2, round(avg(area), 3) AS mean_km2, round(max(area), 3) AS max_km2 FROM ({area})"


_R2 = EARTH_RADIUS_KM**2
_SIMPLE_ROW = " + ".join(f"(((pixel >> {2 * b + 1}) % 2) * {1 << b})" for b in range(6))
_add(
    "grid_area_simple",
    _areas("simplegrid", 6),
    base_sql(6) + " " + _area_sql(6, f"SELECT pixel, {_R2}::DOUBLE * (sin(radians((r + 1) * 180.0::DOUBLE / 64 - 90)) - sin(radians(r * 180.0::DOUBLE / 64 - 90))) * radians(360.0::DOUBLE / 64) AS area FROM (SELECT DISTINCT pixel, ({_SIMPLE_ROW}) % 64 AS r FROM fx_pci)"),
)


def _htm_area() -> str:
    """The circle around the centroid that holds the triangle."""
    edges = ("jk", "kl", "lj")
    normal = ", ".join(f"{c} AS {e}{k}" for e in edges for c, k in zip(_cross(e[0], e[1]), _XYZ))
    size = ", ".join(f"sqrt({e}x * {e}x + {e}y * {e}y + {e}z * {e}z) AS {e}n" for e in edges)
    angle = ", ".join(f"atan2({e}n, {' + '.join(f'{e[0]}{k} * {e[1]}{k}' for k in _XYZ)}) AS {e}t" for e in edges)
    centre = ", ".join(" + ".join(f"{e}{k} / {e}n * {e}t" for e in edges) + f" AS o{k}" for k in _XYZ)
    least = ", ".join(f"({' + '.join(f'{c}{k} * o{k}' for k in _XYZ)}) / sqrt(ox * ox + oy * oy + oz * oz)" for c in "jkl")
    return f"SELECT pixel, 2 * pi() * (1 - least({least})) * {_R2}::DOUBLE AS area FROM (SELECT *, {centre} FROM (SELECT *, {angle} FROM (SELECT *, {size} FROM (SELECT DISTINCT ON (pixel) *, {normal} FROM px))))"


_add("grid_area_htm", _areas("htm", 6), f"{grid_sql(htm_sql(6))} {_area_sql(6, _htm_area())}")


def _s2_area(native: int) -> str:
    """The flat area of the four corners, corrected for the bulge."""
    full = lambda c: f"CASE WHEN {c} >= 0.5 THEN (4 * {c} * {c} - 1) / 3 ELSE (1 - 4 * (1 - {c}) * (1 - {c})) / 3 END"
    n = float(1 << native)
    corners = ((0, 0), (1, 0), (1, 1), (0, 1))
    uv = ", ".join(f"{full(f'((i + {a}) / {n}::DOUBLE)')} AS u{k}, {full(f'((j + {b}) / {n}::DOUBLE)')} AS w{k}" for k, (a, b) in enumerate(corners))
    of = (("1", "u", "w"), ("-u", "1", "w"), ("-u", "-w", "1"), ("-1", "-w", "-u"), ("w", "-1", "-u"), ("w", "u", "-1"))
    value = lambda t, k: t + str(k) if t[-1] in "uw" else t
    xyz = ", ".join(f"(CASE face {' '.join(f'WHEN {f} THEN {value(t[c], k)}' for f, t in enumerate(of))} END) / sqrt(1 + u{k} * u{k} + w{k} * w{k}) AS p{k}{_XYZ[c]}" for k in range(4) for c in range(3))
    diagonals = ", ".join(f"p2{k} - p0{k} AS d{k}, p3{k} - p1{k} AS e{k}" for k in _XYZ)
    cross = _cross("d", "e")
    flat_area = "0.5::DOUBLE * sqrt(" + " + ".join(f"{c} * {c}" for c in cross) + ")"
    return f"SELECT pixel, flat * 2 / (1 + sqrt(1 - least(flat / pi(), 1))) * {_R2}::DOUBLE AS area FROM (SELECT pixel, {flat_area} AS flat FROM (SELECT *, {diagonals} FROM (SELECT *, {xyz} FROM (SELECT DISTINCT ON (pixel) *, {uv} FROM px))))"


_add("grid_area_s2", _areas("s2geom", 6), f"{grid_sql(s2_sql(6))} {_area_sql(6, _s2_area(5))}")
_add("grid_area_h3", _areas("h3", 5))


# Id arithmetic: pixels made of components, one for each customer.
def _of_ids(name: str, pixels: DataFrame) -> DataFrame:
    g, p = make_grid(name, 1), F.col("pixel")
    up = g.parent(p)
    area = {"mean_area": g.area(p)} if name == "h3" else {}
    return pixels.distinct().select(
        "pixel", g.level(p).alias("level"), up.alias("parent"), g.child(p, F.lit(2)).alias("child"), g.child(p, F.lit(9)).alias("no_child"),
        g.child_position(p).alias("position"), g.children_count(p).cast("int").alias("children"), g.is_ancestor(up, p).alias("parent_above"), g.is_ancestor(p, up).alias("above_parent"),
        *(c.alias(n) for n, c in area.items()),
    )


def _customers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    return spark.read.parquet(f"{sf_dir}/customer.parquet"), F.col("c_custkey").cast("long")


def _htm_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, k = _customers(spark, sf_dir)
    depth = (k % 6).cast("int")
    power = F.call_function("shiftleft", F.lit(1).cast("long"), 2 * depth)
    return _of_ids("htm", rows.select(((8 + F.floor(k / 6) % 8) * power + k % power).alias("pixel")))


_add(
    "grid_ids_htm",
    _htm_ids,
    """WITH c AS (SELECT DISTINCT CAST(c_custkey % 6 AS BIGINT) AS d, CAST(8 + c_custkey // 6 % 8 AS BIGINT) AS root, CAST(c_custkey % (1 << CAST(2 * (c_custkey % 6) AS BIGINT)) AS BIGINT) AS path FROM customer),
p AS (SELECT *, root * (1 << (2 * d)) + path AS pixel FROM c)
SELECT pixel, CAST(d + 1 AS INTEGER) AS level, CASE WHEN d = 0 THEN 0 ELSE root * (1 << (2 * (d - 1))) + path // 4 END AS parent, root * (1 << (2 * (d + 1))) + path * 4 + 2 AS child,
       CAST(NULL AS BIGINT) AS no_child, CAST(CASE WHEN d = 0 THEN root - 8 ELSE path % 4 END AS INTEGER) AS position, 4 AS children, true AS parent_above, false AS above_parent FROM p""",
)


def _s2_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, k = _customers(spark, sf_dir)
    depth = (k % 7).cast("int")
    power = F.call_function("shiftleft", F.lit(1).cast("long"), 2 * depth)
    position = (F.floor(k / 7) % 6) * power + k % power
    return _of_ids("s2geom", rows.select(F.call_function("shiftleft", position * 2 + 1, (2 * (s2.LEVELS - depth)).cast("int")).alias("pixel")))


_add(
    "grid_ids_s2",
    _s2_ids,
    f"""WITH c AS (SELECT DISTINCT CAST(c_custkey % 7 AS BIGINT) AS d, CAST(c_custkey // 7 % 6 AS BIGINT) AS face, CAST(c_custkey % (1 << CAST(2 * (c_custkey % 7) AS BIGINT)) AS BIGINT) AS path FROM customer)
SELECT {_s2_id('face * (1 << (2 * d)) + path', 'd')} AS pixel, CAST(d + 1 AS INTEGER) AS level,
       CASE WHEN d = 0 THEN -1 ELSE {_s2_id('face * (1 << (2 * greatest(d - 1, 0))) + path // 4', 'greatest(d - 1, 0)')} END AS parent,
       {_s2_id('face * (1 << (2 * (d + 1))) + path * 4 + 2', 'd + 1')} AS child, CAST(NULL AS BIGINT) AS no_child,
       CAST(CASE WHEN d = 0 THEN face ELSE path % 4 END AS INTEGER) AS position, 4 AS children, true AS parent_above, false AS above_parent FROM c""",
)

#: Digits of the H3 ids below; a pentagon has no digit 1, so that 2 stands for it in its cells.
_H3_DIGITS = 3


def _h3_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, k = _customers(spark, sf_dir)
    resolution, base = k % (_H3_DIGITS + 1), (k * 7) % h3.BASE_CELLS
    out = F.lit(1 << 59) + resolution * F.lit(1 << 52) + base * F.lit(1 << 45) + F.lit((1 << 45) - 1)
    for n in range(1, _H3_DIGITS + 1):
        digit = F.floor(k / (5 * 7 ** (n - 1))) % 7
        digit = F.when((digit == 1) & base.isin(*h3.PENTAGONS), 2).otherwise(digit)
        out = out - F.when(resolution >= n, (7 - digit) * F.lit(1 << (3 * (h3.RESOLUTIONS - n)))).otherwise(F.lit(0).cast("long"))
    return _of_ids("h3", rows.select(out.cast("long").alias("pixel")))


def _h3_sql() -> str:
    digits = [f"CASE WHEN c_custkey // {5 * 7 ** (n - 1)} % 7 = 1 AND (c_custkey * 7) % {h3.BASE_CELLS} IN {h3.PENTAGONS} THEN 2 ELSE c_custkey // {5 * 7 ** (n - 1)} % 7 END" for n in range(1, _H3_DIGITS + 1)]
    columns = ", ".join(f"CAST(CASE WHEN c_custkey % {_H3_DIGITS + 1} >= {n} THEN {d} ELSE 7 END AS BIGINT) AS d{n}" for n, d in enumerate(digits, 1))

    def made(resolution: str, digit) -> str:
        parts = " - ".join(f"(7 - {digit(n)}) * {1 << (3 * (h3.RESOLUTIONS - n))}" for n in range(1, _H3_DIGITS + 2))
        return f"{(1 << 59) + (1 << 45) - 1} + ({resolution}) * {1 << 52} + base * {1 << 45} - {parts}"

    last = f"CASE res {' '.join(f'WHEN {n} THEN d{n}' for n in range(1, _H3_DIGITS + 1))} END"
    zero = lambda upto: " AND ".join(["true", *(f"(d{n} = 0 OR {upto} < {n})" for n in range(1, _H3_DIGITS + 1))])
    pentagon = f"(base IN {h3.PENTAGONS})"
    own = lambda n: f"d{n}" if n <= _H3_DIGITS else "7"
    two = f"CASE WHEN {pentagon} AND {zero('res')} THEN 3 ELSE 2 END"
    areas = " ".join(f"WHEN {r} THEN {a}::DOUBLE" for r, a in enumerate(h3.MEAN_AREAS[: _H3_DIGITS + 1]))
    return f"""WITH c AS (SELECT DISTINCT CAST(c_custkey % {_H3_DIGITS + 1} AS BIGINT) AS res, CAST((c_custkey * 7) % {h3.BASE_CELLS} AS BIGINT) AS base, {columns} FROM customer)
SELECT {made('res', own)} AS pixel, CAST(res + 1 AS INTEGER) AS level,
       CASE WHEN res = 0 THEN -1 ELSE {made('res - 1', lambda n: f'(CASE WHEN res = {n} THEN 7 ELSE {own(n)} END)')} END AS parent,
       {made('res + 1', lambda n: f'(CASE WHEN res + 1 = {n} THEN {two} ELSE {own(n)} END)')} AS child, CAST(NULL AS BIGINT) AS no_child,
       CAST(CASE WHEN res = 0 THEN base WHEN {pentagon} AND {zero('res - 1')} AND {last} > 0 THEN {last} - 1 ELSE {last} END AS INTEGER) AS position,
       CASE WHEN {pentagon} AND {zero('res')} THEN 6 ELSE 7 END AS children, true AS parent_above, false AS above_parent, CASE res {areas} END AS mean_area FROM c"""


_add("grid_ids_h3", _h3_ids, _h3_sql())
