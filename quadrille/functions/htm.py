"""The Hierarchical Triangular Mesh (public scheme of Kunszt, Szalay and Thakar).

Ids carry a leading 1 bit: the eight root triangles are 8 to 15, a child is its
parent's id and two more bits. Level L here is the scheme's level L - 1; level 0
is the root. Points and areas go through Arrow-batched numpy; id arithmetic stays
in built-in functions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quadrille.functions.grid import Grid, register
from quadrille.functions.simple import EARTH_RADIUS_KM, _shift_right
from quadrille.shipping import ship

#: Corners of the octahedron, and the root triangles S0..S3, N0..N3 (ids 8..15) by their corners.
CORNERS = np.array([[0, 0, 1], [1, 0, 0], [0, 1, 0], [-1, 0, 0], [0, -1, 0], [0, 0, -1]], float)
ROOTS = np.array([[1, 5, 2], [2, 5, 3], [3, 5, 4], [4, 5, 1], [1, 0, 4], [4, 0, 3], [3, 0, 2], [2, 0, 1]])


def unit_vectors(lat_m: np.ndarray, lon_m: np.ndarray) -> np.ndarray:
    lat, lon = np.radians(lat_m / 1000.0), np.radians(lon_m / 1000.0)
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], 1)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _children(t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Midpoints opposite to the corners of triangles t (n, 3, 3)."""
    return _unit(t[:, 1] + t[:, 2]), _unit(t[:, 0] + t[:, 2]), _unit(t[:, 0] + t[:, 1])


def _child(t: np.ndarray, number: np.ndarray) -> np.ndarray:
    w0, w1, w2 = _children(t)
    of = np.stack([np.stack(x, 1) for x in ((t[:, 0], w2, w1), (t[:, 1], w0, w2), (t[:, 2], w1, w0), (w0, w1, w2))], 1)
    return of[np.arange(len(t)), number]


def htm_ids(v: np.ndarray, native: int) -> np.ndarray:
    """Ids of unit vectors at a native level. A point on an edge goes to the first triangle in order that has it."""
    x, y, z = v.T
    south = np.where(y >= 0, np.where(x >= 0, 0, 1), np.where(x >= 0, 3, 2))
    north = np.where(y >= 0, np.where(x >= 0, 7, 6), np.where(x >= 0, 4, 5))
    root = np.where(z < 0, south, north)
    ids, t = (root + 8).astype(np.int64), CORNERS[ROOTS[root]]
    for _ in range(native):
        w0, w1, w2 = _children(t)
        inside = lambda a, b: np.einsum("ij,ij->i", np.cross(a, b), v) >= 0
        number = np.select([inside(w2, w1), inside(w0, w2), inside(w1, w0)], [0, 1, 2], 3)
        t, ids = _child(t, number), ids << 2 | number
    return ids


def triangles(ids: np.ndarray) -> np.ndarray:
    """Corners (n, 3, 3) of triangles by id."""
    out = np.zeros((len(ids), 3, 3))
    bits = np.frexp(ids.astype(np.float64))[1]  # ids have at most 53 bits
    for n in np.unique(bits):
        at = np.flatnonzero(bits == n)
        own = ids[at]
        t = CORNERS[ROOTS[(own >> (n - 4)) - 8]]
        for k in range(n - 6, -1, -2):
            t = _child(t, (own >> k) & 3)
        out[at] = t
    return out


def circle_areas(t: np.ndarray) -> np.ndarray:
    """Area on the unit sphere of the circle around the centroid that holds the triangle."""
    centre = np.zeros((len(t), 3))
    for a, b in ((0, 1), (1, 2), (2, 0)):
        normal = np.cross(t[:, a], t[:, b])
        angle = np.arctan2(np.linalg.norm(normal, axis=1), np.einsum("ij,ij->i", t[:, a], t[:, b]))
        centre += _unit(normal) * angle[:, None]
    least = np.einsum("ikj,ij->ik", t, _unit(centre)).min(axis=1)
    return 2 * np.pi * (1 - least)


def boxes(t: np.ndarray) -> np.ndarray:
    """lat_lo, lat_hi, lon_lo, lon_hi (degrees) of spherical triangles, with the bulge of their edges; poles take all longitudes."""
    lat = np.arcsin(np.clip(t[:, :, 2], -1, 1))
    low, high = lat.min(axis=1), lat.max(axis=1)
    for a, b in ((0, 1), (1, 2), (2, 0)):
        normal = _unit(np.cross(t[:, a], t[:, b]))
        top = np.array([0.0, 0.0, 1.0]) - normal * normal[:, 2:3]
        size = np.linalg.norm(top, axis=1, keepdims=True)
        top = np.where(size > 1e-12, top / np.maximum(size, 1e-12), t[:, a])
        for sign in (1, -1):
            p = sign * top
            between = (np.einsum("ij,ij->i", np.cross(t[:, a], p), normal) >= 0) & (np.einsum("ij,ij->i", np.cross(p, t[:, b]), normal) >= 0)
            lat_p = np.arcsin(np.clip(p[:, 2], -1, 1))
            low, high = np.where(between, np.minimum(low, lat_p), low), np.where(between, np.maximum(high, lat_p), high)
    lon = np.arctan2(t[:, :, 1], t[:, :, 0])
    pole = np.abs(t[:, :, 2]) > 1 - 1e-12
    other = np.where(pole, np.nan, lon)
    first, last = np.nanmin(other, axis=1), np.nanmax(other, axis=1)
    # A triangle spans at most a quarter of the globe: a wider span crosses the date line.
    wraps = last - first > np.pi
    west = np.nanmin(np.where(other < 0, other + 2 * np.pi, other), axis=1)
    east = np.nanmax(np.where(other < 0, other + 2 * np.pi, other), axis=1)
    first, last = np.where(wraps, west, first), np.where(wraps, east, last)
    return np.degrees(np.stack([low, high, first, last], 1))


def valid_htm(pixel: Column) -> Column:
    """An id has a leading 1 bit and three more bits, then pairs of bits."""
    return (pixel >= 8) & (F.length(F.bin(pixel)) % 2 == 0)


class HtmGrid(Grid):
    name = "htm"
    root = 0
    deepest = 25

    def index(self, lat_m: Column, lon_m: Column, level: int | None = None) -> Column:
        level = self.default_level if level is None else level
        if level == 0:
            return F.lit(self.root).cast("long")

        ship()

        @pandas_udf("long")
        def of(lat: pd.Series, lon: pd.Series) -> pd.Series:
            return pd.Series(htm_ids(unit_vectors(lat.to_numpy(), lon.to_numpy()), level - 1))

        return of(lat_m, lon_m)

    def level(self, pixel: Column) -> Column:
        native = (F.length(F.bin(pixel)) - 4) / 2
        return F.when(pixel == self.root, 0).when(valid_htm(pixel), native + 1).cast("int")

    def ancestor(self, pixel: Column, up: Column) -> Column:
        return F.when(up >= self.level(pixel), F.lit(self.root).cast("long")).otherwise(_shift_right(pixel, 2 * up))

    def child(self, pixel: Column, number: Column) -> Column:
        of_root = F.when((number >= 0) & (number < 8), number + 8)
        return F.when(pixel == self.root, of_root).when((number >= 0) & (number < 4), F.shiftleft(pixel, 2) + number).cast("long")

    def child_position(self, pixel: Column) -> Column:
        return F.when(self.level(pixel) == 1, pixel - 8).when(pixel != self.root, pixel.bitwiseAND(F.lit(3))).cast("int")

    def children_count(self, pixel: Column) -> Column:
        return F.when(pixel == self.root, 8).otherwise(4)

    def area(self, pixel: Column) -> Column:
        ship()

        @pandas_udf("double")
        def of(ids: pd.Series) -> pd.Series:
            known = ids.to_numpy(float, na_value=0) >= 8
            out = np.full(len(ids), np.nan)
            out[known] = circle_areas(triangles(ids.to_numpy()[known].astype(np.int64))) * EARTH_RADIUS_KM**2
            return pd.Series(out)

        return F.when(pixel != self.root, of(pixel))

    def bbox(self, pixel: Column) -> Column:
        ship()

        @pandas_udf("lat_lo double, lat_hi double, lon_lo double, lon_hi double")
        def of(ids: pd.Series) -> pd.DataFrame:
            known = ids.to_numpy(float, na_value=0) >= 8
            out = np.full((len(ids), 4), np.nan)
            out[known] = boxes(triangles(ids.to_numpy()[known].astype(np.int64)))
            return pd.DataFrame(out, columns=["lat_lo", "lat_hi", "lon_lo", "lon_hi"])

        return F.when(pixel != self.root, of(pixel))


register(HtmGrid.name, HtmGrid)
