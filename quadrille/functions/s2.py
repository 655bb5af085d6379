"""S2 cells (public scheme): six faces of a cube, each a Hilbert curve of 30 levels.

An id is three bits of the face, two bits a level, and a 1 bit behind. Level L here
is the scheme's level L - 1; the root is the pattern of all ones, -1 as BIGINT.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quadrille.functions.grid import Grid, register
from quadrille.functions.htm import unit_vectors
from quadrille.functions.simple import EARTH_RADIUS_KM, _shift_left
from quadrille.shipping import ship

LEVELS = 30
#: Quadrant (i, j bits) of each curve position by orientation, and how a position turns the orientation.
POSITION_TO_IJ = np.array([[0, 1, 3, 2], [0, 2, 3, 1], [3, 2, 0, 1], [3, 1, 0, 2]])
TURN = np.array([1, 0, 0, 3])
IJ_TO_POSITION = np.argsort(POSITION_TO_IJ, axis=1)


def face_st(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Face, and the two coordinates in [0, 1] after the quadratic projection."""
    axis = np.abs(v).argmax(axis=1)
    face = axis + 3 * (v[np.arange(len(v)), axis] < 0)
    x, y, z = v.T
    with np.errstate(divide="ignore", invalid="ignore"):
        u = np.choose(face, [y / x, -x / y, -x / z, z / x, z / y, -y / z])
        w = np.choose(face, [z / x, z / y, -y / z, y / x, -x / y, -x / z])
    flat = lambda c: np.where(c >= 0, 0.5 * np.sqrt(1 + 3 * np.abs(c)), 1 - 0.5 * np.sqrt(1 + 3 * np.abs(c)))
    return face, flat(u), flat(w)


def s2_ids(v: np.ndarray, native: int) -> np.ndarray:
    """Ids of unit vectors at a native level, as signed 64-bit patterns."""
    face, s, t = face_st(v)
    size = 1 << LEVELS
    i, j = (np.clip(np.floor(c * size), 0, size - 1).astype(np.int64) for c in (s, t))
    position, turn = face.astype(np.uint64), face & 1
    for k in range(LEVELS - 1, LEVELS - 1 - native, -1):
        p = IJ_TO_POSITION[turn, ((i >> k) & 1) << 1 | ((j >> k) & 1)]
        position = position << np.uint64(2) | p.astype(np.uint64)
        turn = turn ^ TURN[p]
    tail = 2 * (LEVELS - native)
    return ((position << np.uint64(1) | np.uint64(1)) << np.uint64(tail)).view(np.int64)


def corners(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Native level of each id, and its four corners on the sphere (n, 4, 3), in order around it."""
    bits = ids.astype(np.int64).view(np.uint64)
    low = bits & (~bits + np.uint64(1))
    native = LEVELS - (np.log2(low.astype(np.float64)).astype(np.int64) >> 1)
    face = (bits >> np.uint64(61)).astype(np.int64)
    i, j, turn = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), face & 1
    for k in range(LEVELS):
        use = k < native
        p = ((bits >> np.uint64(2 * (LEVELS - 1 - k) + 1)) & np.uint64(3)).astype(np.int64)
        ij = POSITION_TO_IJ[turn, p]
        i, j = np.where(use, i << 1 | ij >> 1, i), np.where(use, j << 1 | ij & 1, j)
        turn = np.where(use, turn ^ TURN[p], turn)
    n = (1 << native).astype(float)
    full = lambda c: np.where(c >= 0.5, (4 * c * c - 1) / 3, (1 - 4 * (1 - c) ** 2) / 3)
    out = []
    for a, b in ((0, 0), (1, 0), (1, 1), (0, 1)):
        u, w = full((i + a) / n), full((j + b) / n)
        one = np.ones(len(ids))
        faces = [(one, u, w), (-u, one, w), (-u, -w, one), (-one, -w, -u), (w, -one, -u), (w, u, -one)]
        xyz = np.stack([np.stack(f, 1) for f in faces], 1)[np.arange(len(ids)), face]
        out.append(xyz / np.linalg.norm(xyz, axis=1, keepdims=True))
    return native, np.stack(out, 1)


def areas(ids: np.ndarray) -> np.ndarray:
    """Approximate areas on the unit sphere: the mean of the level for the two largest, else the flat area, corrected for the bulge."""
    native, c = corners(ids)
    flat = 0.5 * np.linalg.norm(np.cross(c[:, 2] - c[:, 0], c[:, 3] - c[:, 1]), axis=1)
    bulged = flat * 2 / (1 + np.sqrt(1 - np.minimum(flat / np.pi, 1)))
    return np.where(native < 2, 4 * np.pi / 6 / 4.0**native, bulged)


def boxes(ids: np.ndarray) -> np.ndarray:
    """lat_lo, lat_hi, lon_lo, lon_hi (degrees) around points along the edges; a cell at a pole takes all longitudes."""
    _, c = corners(ids)
    steps = np.linspace(0, 1, 17)[None, :, None]
    edge = np.concatenate([c[:, [k]] * (1 - steps) + c[:, [(k + 1) % 4]] * steps for k in range(4)], 1)
    edge /= np.linalg.norm(edge, axis=2, keepdims=True)
    lat, lon = np.degrees(np.arcsin(np.clip(edge[..., 2], -1, 1))), np.degrees(np.arctan2(edge[..., 1], edge[..., 0]))
    wraps = lon.max(axis=1) - lon.min(axis=1) > 180
    east = np.where(lon < 0, lon + 360, lon)
    low, high = np.where(wraps, east.min(axis=1), lon.min(axis=1)), np.where(wraps, east.max(axis=1), lon.max(axis=1))
    lat_lo, lat_hi = lat.min(axis=1), lat.max(axis=1)
    middle = c.sum(axis=1)
    for sign in (1, -1):
        pole = np.array([0, 0, sign], float)
        normals = np.cross(c, np.roll(c, -1, axis=1))
        side = np.einsum("ikj,j->ik", normals, pole) * np.sign(np.einsum("ikj,ij->ik", normals, middle))
        has = (side > -1e-15).all(axis=1) & (middle @ pole > 0)
        low, high = np.where(has, -180, low), np.where(has, 180, high)
        lat_lo, lat_hi = (lat_lo, np.where(has, 90, lat_hi)) if sign > 0 else (np.where(has, -90, lat_lo), lat_hi)
    return np.stack([lat_lo, lat_hi, low, high], 1)


class S2Grid(Grid):
    name = "s2geom"
    root = -1
    deepest = LEVELS + 1

    def _low_bit(self, pixel: Column) -> Column:
        return pixel.bitwiseAND(-pixel)

    def _zeros(self, pixel: Column) -> Column:
        """Zero bits behind the last 1 bit."""
        return F.bit_count(self._low_bit(pixel) - 1)

    def index(self, lat_m: Column, lon_m: Column, level: int | None = None) -> Column:
        level = self.default_level if level is None else level
        if level == 0:
            return F.lit(self.root).cast("long")

        ship()

        @pandas_udf("long")
        def of(lat: pd.Series, lon: pd.Series) -> pd.Series:
            return pd.Series(s2_ids(unit_vectors(lat.to_numpy(), lon.to_numpy()), level - 1))

        return of(lat_m, lon_m)

    def level(self, pixel: Column) -> Column:
        return F.when(pixel == self.root, 0).otherwise(LEVELS + 1 - self._zeros(pixel) / 2).cast("int")

    def ancestor(self, pixel: Column, up: Column) -> Column:
        low = _shift_left(self._low_bit(pixel), 2 * F.least(up, self.level(pixel) - 1))
        return F.when(up >= self.level(pixel), F.lit(self.root).cast("long")).otherwise(pixel.bitwiseAND(-low).bitwiseOR(low))

    def child(self, pixel: Column, number: Column) -> Column:
        number = number.cast("long")
        face = F.shiftleft(number, 61).bitwiseOR(F.lit(1 << 60))
        low = self._low_bit(pixel)
        inner = pixel - low + (2 * number + 1) * F.shiftright(low, 2)
        return (
            F.when(pixel == self.root, F.when((number >= 0) & (number < 6), face))
            .when((number >= 0) & (number < 4) & (low > 1), inner)
            .cast("long")
        )

    def child_position(self, pixel: Column) -> Column:
        # Bits of the face behind the sign must be read without it.
        face = F.shiftrightunsigned(pixel, 61)
        place = F.call_function("shiftrightunsigned", pixel, (self._zeros(pixel) + 1).cast("int")).bitwiseAND(F.lit(3))
        return F.when(pixel == self.root, None).when(self.level(pixel) == 1, face).otherwise(place).cast("int")

    def children_count(self, pixel: Column) -> Column:
        return F.when(pixel == self.root, 6).otherwise(4)

    def area(self, pixel: Column) -> Column:
        ship()

        @pandas_udf("double")
        def of(ids: pd.Series) -> pd.Series:
            known = ids.notna().to_numpy() & (ids.fillna(-1).to_numpy() != -1)
            out = np.full(len(ids), np.nan)
            out[known] = areas(ids.to_numpy()[known].astype(np.int64)) * EARTH_RADIUS_KM**2
            return pd.Series(out)

        return F.when(pixel != self.root, of(pixel))

    def bbox(self, pixel: Column) -> Column:
        ship()

        @pandas_udf("lat_lo double, lat_hi double, lon_lo double, lon_hi double")
        def of(ids: pd.Series) -> pd.DataFrame:
            known = ids.notna().to_numpy() & (ids.fillna(-1).to_numpy() != -1)
            out = np.full((len(ids), 4), np.nan)
            out[known] = boxes(ids.to_numpy()[known].astype(np.int64))
            return pd.DataFrame(out, columns=["lat_lo", "lat_hi", "lon_lo", "lon_hi"])

        return F.when(pixel != self.root, of(pixel))


register(S2Grid.name, S2Grid)
