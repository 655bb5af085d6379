"""The engine: an index over a dataset, and queries on it by cells, pixels or a hierarchy."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import quadrille.functions.h3  # noqa: F401  registers the grid
import quadrille.functions.htm  # noqa: F401  registers the grid
import quadrille.functions.s2  # noqa: F401  registers the grid
import quadrille.functions.simple  # noqa: F401  registers the grid
from quadrille.errors import UnsupportedFeature
from quadrille.functions.grid import Grid, make_grid
from quadrille.operators import build, compare, hierarchy, results, statistics
from quadrille.operators.text import MODES
from quadrille.plans.evaluate import Source, evaluate
from quadrille.plans.language import parse
from quadrille.sources.dataset import Dataset

CELLS, PIXELS, HIERARCHY, REGIONS = "cell", "pixel", "hier", "region"
#: Down to this level no grid has over 300,000 pixels (H3, 2 + 120 * 7^4).
FEW_LEVEL = 4
BACKENDS = (CELLS, PIXELS, HIERARCHY, REGIONS)


@dataclass
class Result:
    """A query's result on an index: pairs (cell, item_id), where a cell is a cell id or a pixel."""

    index: Index
    backend: str
    pairs: DataFrame
    compact: bool = True

    @property
    def on_cells(self) -> bool:
        return self.backend in (CELLS, REGIONS)

    def flatten(self) -> DataFrame:
        return results.flattened(self.pairs)

    def cqr(self) -> DataFrame:
        """(cell, is_full, items)."""
        return results.cell_results(self.pairs, self.index.totals("cell_id" if self.on_cells else "pixel"))

    def hcqr(self) -> DataFrame:
        """(pixel, level, is_full, items) on a grid; (kind, id, is_full, n_items) by regions."""
        i = self.index
        if self.on_cells:
            d = i.dataset
            return hierarchy.region_cover(self.pairs, i.totals("cell_id"), d.region_cells, d.regions, d.cell_items())
        return hierarchy.compacted(self.pairs, i.tree_totals(), i.grid, i.grid.default_level, self.compact)

    def stats(self) -> DataFrame:
        return results.result_size(self.pairs)

    def combined(self, op: str, other: Result) -> Result:
        """Union '+', intersection '/' or difference '-' with another result on the same places.

        Of hierarchies too: the leaf pairs that both stand for are combined, and
        presented as a hierarchy once.
        """
        sets = {"+": lambda a, b: a.unionByName(b).distinct(), "/": DataFrame.intersect, "-": DataFrame.subtract}
        if op not in sets or self.on_cells != other.on_cells:
            raise UnsupportedFeature(f"{op} of results by {self.backend} and {other.backend}")
        return Result(self.index, self.backend, sets[op](self.pairs, other.pairs), self.compact)

    def diff(self, other: Result) -> DataFrame:
        return compare.difference_sizes(self.pairs, other.pairs)


@dataclass
class Index:
    """A dataset re-bucketed onto a grid."""

    dataset: Dataset
    grid: Grid
    pci: DataFrame
    case_sensitive: bool = False
    #: Match modes that the index offers; others fall back on them.
    modes: frozenset[str] = frozenset(MODES)
    #: Of a stored index: postings by token, and totals by 'cell_id', by 'pixel' and of the 'tree' of pixels.
    postings: DataFrame | None = None
    stored_totals: dict[str, DataFrame] = field(default_factory=dict)
    #: Whether pci is that of the dataset's points, so that it can be made from a copy of them.
    of_points: bool = False
    #: Results that are kept; the one used least recently goes first.
    cache_size: int = 16
    _cache: OrderedDict[tuple[str, str, bool], Result] = field(default_factory=OrderedDict)

    def totals(self, key: str) -> DataFrame:
        """(cell, n_total): stored with the index, or else counted."""
        return self.stored_totals[key] if key in self.stored_totals else build.totals(self.pci, key)

    def tree_totals(self) -> DataFrame:
        """(pixel, level, total) of the grid's hierarchy: stored with the index, or else counted."""
        if "tree" in self.stored_totals:
            return self.stored_totals["tree"]
        return hierarchy.tree_totals(self.totals("pixel"), self.grid, self.grid.default_level)

    def check(self) -> DataFrame:
        """Cells whose items in the index are not those of the dataset: no rows if all is well."""
        return build.inconsistencies(self.pci, self.dataset.points, self.stored_totals.get("cell_id"))

    @cached_property
    def cell_source(self) -> Source:
        d = self.dataset
        return Source(self.pci, d.item_text, d.region_text, "cell_id", d.region_cells, self.modes, self.case_sensitive, postings=self.postings)

    @cached_property
    def pixel_source(self) -> Source:
        d = self.dataset
        return Source(self.pci, d.item_text, d.region_text, "pixel", None, self.modes, self.case_sensitive, ids=False, postings=self.postings, few=self.grid.default_level <= FEW_LEVEL)

    def query(self, text: str, backend: str = PIXELS, compact: bool = True, cached: bool = False) -> Result:
        """Evaluate a query. Backends: 'cell' and 'pixel' flat, 'hier' on the grid's hierarchy, 'region' on the region tree.

        With cached, the pairs are kept, and the same query is not evaluated again
        while it is among the last cache_size ones.
        """
        if backend not in BACKENDS:
            raise UnsupportedFeature(f"backend {backend}")
        if cached and (text, backend, compact) in self._cache:
            self._cache.move_to_end((text, backend, compact))
            return self._cache[text, backend, compact]
        source = self.cell_source if backend in (CELLS, REGIONS) else self.pixel_source
        if backend in (HIERARCHY, REGIONS):
            source = Source(**{**source.__dict__, "symmetric": False})
        out = Result(self, backend, evaluate(parse(text), source), compact)
        if cached and self.cache_size > 0:
            out.pairs = out.pairs.persist()
            self._cache[text, backend, compact] = out
            while len(self._cache) > self.cache_size:
                self._cache.popitem(last=False)[1].pairs.unpersist()
        return out

    def forget(self) -> None:
        for r in self._cache.values():
            r.pairs.unpersist()
        self._cache.clear()

    def preload(self) -> int:
        """Hold the index tables in memory; their number of rows."""
        d = self.dataset
        return sum(t.persist().count() for t in (self.pci, d.item_text, d.region_text, d.region_cells))

    def held(self) -> Index:
        """The same index with pci kept in memory or on disk: for several queries on an index that is not stored."""
        self.pci = self.pci.persist()
        self.of_points = False
        return self

    def stats(self) -> DataFrame:
        return statistics.index_summary(self.pci)


class Engine:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def build_index(self, dataset: Dataset, grid: str = "simplegrid", level: int = 4, case_sensitive: bool = False, modes: Iterable[str] = MODES) -> Index:
        made = make_grid(grid, level)
        return Index(dataset, made, build.build_pci(dataset.points, made), case_sensitive, frozenset(modes), of_points=True)

    def geometry(self, items: DataFrame, cells: DataFrame, grid: str, level: int) -> DataFrame:
        """pci of items(item_id, points, cells), whose points are located in the cells first."""
        return build.build_pci(build.item_points(items, cells), make_grid(grid, level))

    def pixel_sizes(self, index: Index) -> DataFrame:
        return index.pci.groupBy("pixel").agg(F.count_distinct("item_id").alias("n_items"))
