"""H3 ids (public format): mode, resolution, base cell, and a digit of 0 to 6 for each resolution.

Level L is resolution L - 1; the root is the pattern of all ones, -1 as BIGINT. All
that follows from ids alone is integer arithmetic in built-in functions; placing
points and outlines go through Arrow-batched numpy.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quadrille.functions import h3_geometry
from quadrille.functions.grid import Grid, register
from quadrille.functions.htm import unit_vectors
from quadrille.shipping import ship

RESOLUTIONS = 15
BASE_CELLS = 122
#: Base cells that are pentagons.
PENTAGONS = (4, 14, 24, 38, 49, 58, 63, 72, 83, 97, 107, 117)
#: Mean hexagon area by resolution, square kilometres.
MEAN_AREAS = (
    4250546.848, 607220.9782, 86745.85403, 12392.26486, 1770.323552, 252.9033645, 36.1290521, 5.1612932,
    0.7373276, 0.1053325, 0.0150475, 0.0021496, 0.0003071, 0.0000439, 0.0000063, 0.0000009,
)
_MODE = 1 << 59
_UNUSED = (1 << 45) - 1


def _shifted(value: Column | int, by: Column) -> Column:
    return F.call_function("shiftleft", F.lit(value).cast("long") if isinstance(value, int) else value, by.cast("int"))


class H3Grid(Grid):
    name = "h3"
    root = -1
    deepest = RESOLUTIONS + 1

    def index(self, lat_m: Column, lon_m: Column, level: int | None = None) -> Column:
        level = self.default_level if level is None else level
        if level == 0:
            return F.lit(self.root).cast("long")

        ship()

        @pandas_udf("long")
        def of(lat: pd.Series, lon: pd.Series) -> pd.Series:
            return pd.Series(h3_geometry.h3_ids(unit_vectors(lat.to_numpy(), lon.to_numpy()), level - 1))

        return of(lat_m, lon_m)

    def bbox(self, pixel: Column) -> Column:
        """Around a cell's corners."""

        ship()

        @pandas_udf("lat_lo double, lat_hi double, lon_lo double, lon_hi double")
        def of(ids: pd.Series) -> pd.DataFrame:
            known = ids.notna().to_numpy() & (ids.fillna(-1).to_numpy() != -1)
            out = np.full((len(ids), 4), np.nan)
            if known.any():
                out[known] = h3_geometry.boxes(ids.to_numpy()[known].astype(np.int64))
            return pd.DataFrame(out, columns=["lat_lo", "lat_hi", "lon_lo", "lon_hi"])

        return F.when(pixel != self.root, of(pixel))

    def _resolution(self, pixel: Column) -> Column:
        return F.shiftrightunsigned(pixel, 52).bitwiseAND(F.lit(15)).cast("int")

    def base_cell(self, pixel: Column) -> Column:
        return F.shiftrightunsigned(pixel, 45).bitwiseAND(F.lit(127)).cast("int")

    def level(self, pixel: Column) -> Column:
        return F.when(pixel == self.root, 0).otherwise(self._resolution(pixel) + 1).cast("int")

    def ancestor(self, pixel: Column, up: Column) -> Column:
        """Digits below the ancestor's resolution are all ones."""
        resolution = F.greatest(self._resolution(pixel) - up, F.lit(0))
        unused = _shifted(1, 3 * (RESOLUTIONS - resolution)) - 1
        other = pixel.bitwiseAND(F.bitwise_not(F.lit(15 << 52)))
        found = other.bitwiseOR(_shifted(resolution.cast("long"), F.lit(52))).bitwiseOR(unused)
        return F.when(up >= self.level(pixel), F.lit(self.root).cast("long")).otherwise(found)

    def is_pentagon(self, pixel: Column) -> Column:
        """A pentagon's base cell is one, and all its digits are 0."""
        unused = 3 * (RESOLUTIONS - self._resolution(pixel))
        digits = F.call_function("shiftrightunsigned", pixel.bitwiseAND(F.lit(_UNUSED)), unused.cast("int"))
        return self.base_cell(pixel).isin(*PENTAGONS) & (digits == 0)

    def child(self, pixel: Column, number: Column) -> Column:
        """Children in order of their digits; a pentagon has no digit 1."""
        number = number.cast("long")
        top = F.lit(_MODE | _UNUSED) + F.shiftleft(number, 45)
        digit = F.when(self.is_pentagon(pixel) & (number > 0), number + 1).otherwise(number)
        place = 3 * (RESOLUTIONS - 1 - self._resolution(pixel))
        inner = (pixel + F.lit(1 << 52)) - _shifted(7 - digit, place)
        fits = (number >= 0) & (number < self.children_count(pixel)) & (self._resolution(pixel) < RESOLUTIONS)
        return F.when(pixel == self.root, F.when((number >= 0) & (number < BASE_CELLS), top)).when(fits, inner).cast("long")

    def child_position(self, pixel: Column) -> Column:
        place = 3 * (RESOLUTIONS - self._resolution(pixel))
        digit = F.call_function("shiftrightunsigned", pixel, place.cast("int")).bitwiseAND(F.lit(7))
        skipped = F.when(self.is_pentagon(self.ancestor(pixel, F.lit(1))) & (digit > 0), digit - 1).otherwise(digit)
        return F.when(pixel == self.root, None).when(self.level(pixel) == 1, self.base_cell(pixel)).otherwise(skipped).cast("int")

    def children_count(self, pixel: Column) -> Column:
        return F.when(pixel == self.root, BASE_CELLS).when(self.is_pentagon(pixel), 6).otherwise(7)

    def area(self, pixel: Column) -> Column:
        """Mean area of the resolution's hexagons."""
        of = F.array(*(F.lit(a) for a in MEAN_AREAS))
        return F.when(pixel != self.root, F.get(of, self._resolution(pixel)))


register(H3Grid.name, H3Grid)
