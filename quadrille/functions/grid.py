"""What a grid is: column builders for pixel ids, and a registry by name.

A pixel id is a BIGINT that holds the grid's 64-bit pattern. Level 0 is the root,
a single pixel for the whole world; a grid's native levels follow from level 1 on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrille.errors import InvalidPixel, UnsupportedFeature


class Grid:
    """A hierarchical grid over the globe. Columns are latitude and longitude in thousandths of a degree."""

    name = ""
    root = 0
    #: Deepest level that ids have room for.
    deepest = 0

    def __init__(self, level: int):
        if not 0 <= level <= self.deepest:
            raise InvalidPixel(f"{self.name} has levels 0 to {self.deepest}, not {level}")
        self.level_of_index = level

    # Levels
    @property
    def max_level(self) -> int:
        return self.level_of_index

    @property
    def default_level(self) -> int:
        return self.level_of_index

    # Column builders
    def index(self, lat_m: Column, lon_m: Column, level: int | None = None) -> Column:
        raise NotImplementedError

    def level(self, pixel: Column) -> Column:
        raise NotImplementedError

    def ancestor(self, pixel: Column, up: Column) -> Column:
        """The pixel `up` levels above; the root from level 0 up."""
        raise NotImplementedError

    def child(self, pixel: Column, number: Column) -> Column:
        """A child by number; null where there is no such child."""
        raise NotImplementedError

    def bbox(self, pixel: Column) -> Column:
        """struct(lat_lo, lat_hi, lon_lo, lon_hi) in degrees; null for the root."""
        raise NotImplementedError

    def area(self, pixel: Column) -> Column:
        """Square kilometres; null for the root."""
        raise NotImplementedError

    def children_count(self, pixel: Column) -> Column:
        raise NotImplementedError

    def parent(self, pixel: Column) -> Column:
        """The pixel above; null for the root."""
        return F.when(pixel != F.lit(self.root), self.ancestor(pixel, F.lit(1)))

    def is_ancestor(self, above: Column, below: Column) -> Column:
        """Whether `above` is a proper ancestor of `below`; the root is above everything, itself included."""
        up = self.level(below) - self.level(above)
        return (above == F.lit(self.root)) | ((up > 0) & (self.ancestor(below, F.greatest(up, F.lit(0))) == above))

    def child_position(self, pixel: Column) -> Column:
        raise NotImplementedError

    def tree(self, pixels: Column) -> Column:
        raise UnsupportedFeature(f"{self.name}: tree of pixels")


_GRIDS: dict[str, Callable[[int], Grid]] = {}


def register(name: str, make: Callable[[int], Grid]) -> None:
    _GRIDS[name] = make


def make_grid(name: str, level: int) -> Grid:
    if name not in _GRIDS:
        raise UnsupportedFeature(f"no grid named {name}; there are {', '.join(sorted(_GRIDS))}")
    return _GRIDS[name](level)


def grid_names() -> list[str]:
    return sorted(_GRIDS)
