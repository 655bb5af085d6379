"""The simple grid: 2^L x 2^L boxes of latitude and longitude, numbered in Z order behind a leading 1 bit.

All of it is integer arithmetic in built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrille.functions.grid import Grid, register

LAT_SPAN, LON_SPAN = 180_000, 360_000
#: Square kilometres of a sphere of the diameter that the area functions take (12700 km).
EARTH_RADIUS_KM = 12700 / 2


def _shift_right(c: Column, by: Column) -> Column:
    return F.call_function("shiftright", c, by.cast("int"))


def _shift_left(c: Column, by: Column) -> Column:
    return F.call_function("shiftleft", c, by.cast("int"))


def _spread(c: Column, bits: int) -> Column:
    """Bit b of c at place 2b."""
    out = F.lit(0).cast("long")
    for b in range(bits):
        out = out + F.shiftleft(c.bitwiseAND(F.lit(1 << b)), b)
    return out


def _gathered(c: Column, bits: int) -> Column:
    """Bit 2b of c at place b."""
    out = F.lit(0).cast("long")
    for b in range(bits):
        out = out + F.shiftright(c.bitwiseAND(F.lit(1 << (2 * b)).cast("long")), b)
    return out


class SimpleGrid(Grid):
    name = "simplegrid"
    root = 1
    deepest = 28

    def index(self, lat_m: Column, lon_m: Column, level: int | None = None) -> Column:
        level = self.default_level if level is None else level
        last = F.lit((1 << level) - 1).cast("long")

        def place(c: Column, span: int) -> Column:
            return F.greatest(F.lit(0).cast("long"), F.least(last, F.floor((c + span // 2) * F.lit(1 << level) / span)))

        row, column = place(lat_m, LAT_SPAN), place(lon_m, LON_SPAN)
        return F.lit(1 << (2 * level)).cast("long") + F.shiftleft(_spread(row, level), 1) + _spread(column, level)

    def level(self, pixel: Column) -> Column:
        return ((F.length(F.bin(pixel)) - 1) / 2).cast("int")

    def ancestor(self, pixel: Column, up: Column) -> Column:
        return _shift_right(pixel, 2 * F.least(up, self.level(pixel)))

    def child(self, pixel: Column, number: Column) -> Column:
        return F.when((number >= 0) & (number < 4) & (self.level(pixel) < self.deepest), F.shiftleft(pixel, 2) + number).cast("long")

    def child_position(self, pixel: Column) -> Column:
        return F.when(pixel != self.root, pixel.bitwiseAND(F.lit(3))).cast("int")

    def children_count(self, pixel: Column) -> Column:
        return F.lit(4)

    def row_column(self, pixel: Column) -> tuple[Column, Column]:
        # The leading 1 bit is at an even place, so it shows among the column's bits alone.
        n = _shift_left(F.lit(1).cast("long"), self.level(pixel))
        return _gathered(F.shiftright(pixel, 1), self.deepest), _gathered(pixel, self.deepest + 1) - n

    def box(self, pixel: Column) -> tuple[Column, Column, Column, Column]:
        """lat_lo, lat_hi, lon_lo, lon_hi in degrees, root included."""
        row, column = self.row_column(pixel)
        n = _shift_left(F.lit(1).cast("long"), self.level(pixel))
        lat, lon = (lambda x: x * 180.0 / n - 90.0), (lambda x: x * 360.0 / n - 180.0)
        return lat(row), lat(row + 1), lon(column), lon(column + 1)

    def bbox(self, pixel: Column) -> Column:
        a, b, c, d = self.box(pixel)
        return F.when(pixel != self.root, F.struct(a.alias("lat_lo"), b.alias("lat_hi"), c.alias("lon_lo"), d.alias("lon_hi")))

    def area(self, pixel: Column) -> Column:
        a, b, c, d = self.box(pixel)
        zone = F.sin(F.radians(b)) - F.sin(F.radians(a))
        return F.when(pixel != self.root, EARTH_RADIUS_KM**2 * zone * F.radians(d - c))


register(SimpleGrid.name, SimpleGrid)
