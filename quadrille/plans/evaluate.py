"""Operator trees as DataFrame plans.

A result is the relation (cell, item_id), where a cell is a cell of the region
arrangement or a pixel. All text leaves are evaluated together: cells and items get
a mask with a bit for each leaf that matches them, pci joins the matching cells and
the matching items, and one aggregate by (cell, item_id) ors the bits. The tree is
then a boolean formula on the mask. So pci is read twice and only rows that some
leaf matches are shuffled, once, however many leaves there are. All joins with pci
are inner or semi joins, so Spark can broadcast the smaller side or filter pci by it
before the shuffle. Full-match conversion needs the cells of its operand first.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.errors import UnsupportedFeature
from quadrille.operators import text
from quadrille.plans.language import CellId, Empty, Full, Node, RegionId, SetOp, Text

#: Leaves that one mask holds; larger trees are cut into parts.
MASK_BITS = 62


@dataclass
class Source:
    """What a tree is evaluated on. key is 'cell_id' or 'pixel'."""

    pci: DataFrame
    item_text: DataFrame
    region_text: DataFrame
    key: str
    region_cells: DataFrame | None = None
    modes: frozenset[str] = field(default_factory=lambda: frozenset(text.MODES))
    case_sensitive: bool = False
    symmetric: bool = True
    ids: bool = True
    #: Of a stored index: (tok, whole, cell_id, pixel, item_id), a row for each token of an item or, whole, of its cell.
    postings: DataFrame | None = None
    #: Whether cells are few by the grid's level, so that a set of them can go to every executor.
    few: bool = False

    def no_pairs(self) -> DataFrame:
        return self.pci.select(F.col(self.key).alias("cell"), "item_id").limit(0)


def leaves(node: Node) -> list[Node]:
    """Leaves of a tree; a full-match conversion counts as one."""
    if isinstance(node, SetOp):
        return leaves(node.left) + leaves(node.right)
    return [] if isinstance(node, Empty) else [node]


def _check(node: Node, source: Source) -> None:
    if isinstance(node, SetOp):
        if node.op == "^" and not source.symmetric:
            raise UnsupportedFeature("symmetric difference of hierarchical results")
        _check(node.left, source)
        _check(node.right, source)
    elif isinstance(node, Full):
        _check(node.of, source)
    elif isinstance(node, CellId | RegionId) and not source.ids:
        raise UnsupportedFeature("cell and region ids on a grid")


def _formula(node: Node, bit_of: dict[Node, int]) -> Column:
    if isinstance(node, Empty):
        return F.lit(False)
    if isinstance(node, SetOp):
        a, b = _formula(node.left, bit_of), _formula(node.right, bit_of)
        return {"+": a | b, "/": a & b, "-": a & ~b, "^": a != b}[node.op]
    return F.col("mask").bitwiseAND(F.lit(1 << bit_of[node]).cast("long")) != 0


def _token_mask(leaf_bits: list[tuple[Text, int]], source: Source) -> tuple[Column, Column] | None:
    """Whether some leaf matches a token, and the mask of those that do."""
    bits = []
    for leaf, bit in leaf_bits:
        mode = text.offered_mode(leaf.mode, source.modes)
        if mode is not None:
            bits.append((text.matches(F.col("tok"), leaf.text, mode, source.case_sensitive), bit))
    if not bits:
        return None
    mask, some = F.lit(0).cast("long"), F.lit(False)
    for m, b in bits:
        mask, some = mask + F.when(m, F.lit(1 << b)).otherwise(F.lit(0)).cast("long"), some | m
    return some, mask


def _masks(tokens: DataFrame, key: str, leaf_bits: list[tuple[Text, int]], source: Source, name: str) -> DataFrame | None:
    """(key, mask): the leaves that some token of each key matches."""
    found = _token_mask(leaf_bits, source)
    return None if found is None else tokens.where(found[0]).groupBy(key).agg(F.bit_or(found[1]).alias(name))


def _posted(texts: list[tuple[Text, int]], others: list[tuple[DataFrame, Column]], source: Source, regions: int, items: int) -> list[tuple[DataFrame, Column]]:
    """What matches by the stored postings, of which the tokens' rows alone are read, and the rows of pci that other leaves match.

    All go by (key, item) once, which serves the aggregate by row of pci and that of the tree.
    """
    found = _token_mask(texts, source)
    none, place = F.lit(0).cast("long"), ("pixel", "cell_id", "item_id")
    rows = None if found is None else source.postings.where(found[0]).select(*place, "whole", found[1].alias("leaves"))
    for matched, bit in others:
        own = matched.select(*place, F.lit(None).cast("boolean").alias("whole"), bit.alias("leaves"))
        rows = own if rows is None else rows.unionByName(own)
    if rows is None:
        return []
    mine = lambda whole, name: F.coalesce(F.bit_or(F.when(F.col("whole").eqNullSafe(F.lit(whole)), F.col("leaves"))), none).alias(name)
    rows = rows.repartition(source.key, "item_id").groupBy(*place).agg(mine(True, "by_cell"), mine(False, "by_item"), mine(None, "by_leaf"))
    # An item that matches by itself counts in cells that no region of the leaf's match fills.
    by_item = F.col("by_item").bitwiseAND(F.lit(items).cast("long")).bitwiseAND(F.bitwise_not("by_cell"))
    return [(rows, F.col("by_cell").bitwiseAND(F.lit(regions).cast("long")).bitwiseOR(by_item).bitwiseOR(F.col("by_leaf")))]


def _small_tree(node: Node, source: Source) -> DataFrame:
    found = list(dict.fromkeys(leaves(node)))
    if not found:
        return source.no_pairs()
    bit_of = {leaf: k for k, leaf in enumerate(found)}
    texts = [(x, bit_of[x]) for x in found if isinstance(x, Text)]
    # The bits of leaves that take regions, and of those that take items.
    regions = sum(1 << b for x, b in texts if x.part != "items")
    items = sum(1 << b for x, b in texts if x.part != "regions")
    parts, by_cell, by_item = [], None, None
    if source.postings is None:
        by_cell = _masks(source.region_text, "cell_id", texts, source, "cell_mask")
        by_item = _masks(source.item_text, "item_id", [x for x in texts if x[0].part != "regions"], source, "item_mask")
    if by_cell is not None and regions:
        parts.append((source.pci.join(by_cell, "cell_id"), F.col("cell_mask").bitwiseAND(F.lit(regions).cast("long"))))
    if by_item is not None:
        # An item that matches by itself counts in cells that no region of the leaf's match fills.
        rows, mask = source.pci.join(by_item, "item_id"), F.col("item_mask").bitwiseAND(F.lit(items).cast("long"))
        if by_cell is not None:
            rows = rows.join(by_cell, "cell_id", "left")
            mask = mask.bitwiseAND(F.bitwise_not(F.coalesce("cell_mask", F.lit(0).cast("long"))))
        parts.append((rows, mask))
    for leaf in found:
        bit = F.lit(1 << bit_of[leaf]).cast("long")
        if isinstance(leaf, CellId):
            parts.append((source.pci.where(F.col("cell_id") == leaf.cell_id), bit))
        elif isinstance(leaf, RegionId):
            if source.region_cells is None:
                raise UnsupportedFeature("regions by id")
            cells = source.region_cells.where(F.col("region_id") == leaf.region_id).select("cell_id")
            parts.append((source.pci.join(cells, "cell_id", "left_semi"), bit))
        elif isinstance(leaf, Full):
            cells = evaluate(leaf.of, source).select(F.col("cell").alias(source.key)).distinct()
            parts.append((source.pci.join(F.broadcast(cells) if source.few else cells, source.key, "left_semi"), bit))
    if source.postings is not None:
        parts = _posted(texts, parts, source, regions, items)
    if not parts:
        return source.no_pairs()
    out = None
    for rows, mask in parts:
        own = rows.select(F.col(source.key).alias("cell"), "item_id", mask.alias("mask")).where("mask != 0")
        out = own if out is None else out.unionByName(own)
    return out.groupBy("cell", "item_id").agg(F.bit_or("mask").alias("mask")).where(_formula(node, bit_of)).select("cell", "item_id")


def evaluate(node: Node, source: Source) -> DataFrame:
    """(cell, item_id) of a tree, each pair once."""
    _check(node, source)
    if not isinstance(node, SetOp) or len(set(leaves(node))) <= MASK_BITS:
        return _small_tree(node, source)
    a, b = evaluate(node.left, source), evaluate(node.right, source)
    if node.op == "+":
        return a.unionByName(b).distinct()
    if node.op == "/":
        return a.intersect(b)
    if node.op == "-":
        return a.subtract(b)
    return a.subtract(b).unionByName(b.subtract(a))
