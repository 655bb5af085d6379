"""Stored indexes, query files and raw statistics.

An index is a directory of Parquet tables and a one-row table of its properties: the
core table, the postings of all tokens, the totals by cell and by pixel, and the
dataset. A hierarchical index holds such an index for all queries, and the nodes of
chosen ones or of every token. Paths may be of any file system that Spark reads;
nothing else opens them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import partial
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.engine import Index
from quadrille.functions.grid import make_grid
from quadrille.operators import build, hierarchy
from quadrille.operators.text import MODES
from quadrille.sources.dataset import Dataset

T = TypeVar("T")
VERSION = 2
NODES = "query string, pixel long, level int, is_full boolean, items array<bigint>"
_TABLES = ("points", "item_text", "region_text", "cells", "region_cells", "regions")


def _at_once(spark: SparkSession, *steps: Callable[[], T]) -> list[T]:
    """The results of steps whose jobs run side by side: the stages of one leave cores idle that another uses."""
    with ThreadPoolExecutor(len(steps)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(s)) for s in steps]]


def write_index(index: Index, path: str) -> None:
    """Tables go by ranges, so that readers skip files by their statistics: pci by cell and item, which parts a large
    cell as well, postings and tokens by tok, and then by place or item.

    Each table is made once: pci from the stored points, postings from the stored pci and texts.
    """
    spark = index.pci.sparkSession
    d = index.dataset

    def write(name: str, table: DataFrame, *by: str) -> DataFrame:
        table = table.repartitionByRange(*by).sortWithinPartitions(*by) if by else table
        table.write.mode("overwrite").parquet(f"{path}/{name}")
        return spark.read.schema(table.schema).parquet(f"{path}/{name}")

    def texts(name: str) -> DataFrame:
        table = getattr(d, name)
        return write(name, table, "tok", next(c for c in table.columns if c != "tok"))

    def placed() -> DataFrame:
        points = write("points", d.points)
        return write("pci", build.build_pci(points, index.grid) if index.of_points else index.pci, "cell_id", "item_id")

    def by_pixel() -> None:
        tree = hierarchy.tree_totals(write("totals_pixel", build.totals(pci, "pixel"), "cell"), index.grid, index.grid.default_level)
        write("totals_tree", tree, "level", "pixel")

    plain = [partial(write, name, getattr(d, name)) for name in ("cells", "region_cells", "regions")]
    pci, item_text, region_text, *_ = _at_once(spark, placed, lambda: texts("item_text"), lambda: texts("region_text"), *plain)
    _at_once(
        spark,
        lambda: write("postings", build.postings(pci, item_text, region_text), "tok", "pixel", "item_id"),
        lambda: write("totals_cell_id", build.totals(pci, "cell_id"), "cell"),
        by_pixel,
    )
    meta = spark.range(1).select(
        F.lit(VERSION).alias("version"),
        F.lit(index.grid.name).alias("grid"),
        F.lit(index.grid.default_level).alias("level"),
        F.lit(",".join(m for m in MODES if m in index.modes)).alias("modes"),
        F.lit(index.case_sensitive).alias("case_sensitive"),
    )
    meta.write.mode("overwrite").json(f"{path}/meta")


def read_index(spark: SparkSession, path: str) -> Index:
    meta = spark.read.json(f"{path}/meta").first()
    if meta["version"] != VERSION:
        raise ValueError(f"{path} has version {meta['version']}; version {VERSION} is read here")
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    dataset = Dataset(**{name: read(name) for name in _TABLES})
    modes = frozenset(m for m in (meta["modes"] or "").split(",") if m)
    totals = {key: read(f"totals_{key}") for key in ("cell_id", "pixel", "tree")}
    return Index(dataset, make_grid(meta["grid"], meta["level"]), read("pci"), meta["case_sensitive"], modes, read("postings"), totals)


def _nodes(index: Index, query: str, compact: bool, most: int | None) -> DataFrame:
    nodes = index.query(query, "hier", compact=compact).hcqr()
    return nodes if most is None else hierarchy.merged_partials(nodes, index.grid, most)


def _token_nodes(index: Index, compact: bool, most: int | None) -> DataFrame:
    """Nodes of every token, by exact match, as those of the query that names it: one job for all.

    As leaf pairs, a token has all items of the cells that have it, and its items in other cells.
    """
    posted = index.postings if index.postings is not None else build.postings(index.pci, index.dataset.item_text, index.dataset.region_text)
    name = F.concat(F.lit('"'), F.replace(F.replace("tok", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')).alias("query")
    pairs = posted.select(name, F.col("pixel").alias("cell"), "item_id").distinct()
    nodes = hierarchy.compacted(pairs, index.tree_totals(), index.grid, index.grid.default_level, compact, ("query",))
    return nodes if most is None else hierarchy.merged_partials(nodes, index.grid, most, ("query",))


def _inner(nodes: DataFrame, index: Index) -> DataFrame:
    """The pixels above nodes, with null for is_full and items."""
    up = nodes.select("query", "pixel", "level", F.explode(F.sequence(F.lit(1), F.greatest("level", F.lit(1)))).alias("up")).where("up <= level")
    up = up.select("query", index.grid.ancestor(F.col("pixel"), F.col("up")).alias("pixel"), (F.col("level") - F.col("up")).cast("int").alias("level")).distinct()
    return up.select("query", "pixel", "level", F.lit(None).cast("boolean").alias("is_full"), F.lit(None).cast("array<bigint>").alias("items"))


def write_hierarchy(index: Index, queries: Iterable[str], path: str, compact: bool = True, only_leaves: bool = True, most: int | None = None, tokens: bool = False) -> None:
    """Nodes of each query on the grid's hierarchy, as (query, pixel, level, is_full, items), and the index that answers others.

    With tokens, also those of every token by exact match. Without only_leaves the
    inner pixels above the nodes are stored too, with null for is_full and items.
    Partial pixels below level `most`, if it is given, merge.
    """
    spark = index.pci.sparkSession
    spark.createDataFrame([], NODES).write.mode("overwrite").parquet(path)
    # Readers of the nodes pass over names that begin with an underscore.
    write_index(index, f"{path}/_index")
    index = read_index(spark, f"{path}/_index")
    form = spark.range(1).select(F.lit(compact).alias("compact"), F.lit(-1 if most is None else most).alias("most"))
    form.write.mode("overwrite").json(f"{path}/_index/form")
    parts = [_nodes(index, text, compact, most).withColumn("query", F.lit(text)) for text in dict.fromkeys(queries)]
    if tokens:
        every = _token_nodes(index, compact, most)
        parts.append(every.where(~F.col("query").isin(*queries)) if queries else every)
    for nodes in parts:
        nodes = nodes if only_leaves else nodes.unionByName(_inner(nodes, index))
        # By query and place: a reader of one query skips the files of others.
        nodes.select("query", "pixel", "level", "is_full", "items").repartitionByRange("query", "pixel").write.mode("append").parquet(path)


def read_hierarchy(spark: SparkSession, path: str, query: str) -> DataFrame:
    """Nodes of any query, without inner pixels: the stored ones, or those of its tree over the stored index."""
    stored = spark.read.schema(NODES).parquet(path).where(F.col("query") == query).where("is_full IS NOT NULL").drop("query")
    if not stored.isEmpty():
        return stored
    form = spark.read.json(f"{path}/_index/form").first()
    return _nodes(read_index(spark, f"{path}/_index"), query, form["compact"], None if form["most"] < 0 else form["most"])


def read_query_file(spark: SparkSession, path: str) -> list[str]:
    """One query a line, in order; the end of the last line is no query. Query files are small by nature."""
    lines = spark.read.text(path, wholetext=True).collect()
    from quadrille.plans.language import read_queries

    return [q for row in lines for q in read_queries(row[0])]


#: Fixed value: the header of raw statistics, with cells or nodes counted.
RAW_HEADER = "Query id; cqr time [us];flaten time[us];{} count; item count"


def raw_statistics(rows: list[tuple[int, int, int, int, int]], hierarchical: bool) -> str:
    """Lines id;evaluation;flattening;cells or nodes;items under their header."""
    lines = [RAW_HEADER.format("node" if hierarchical else "cell"), *(";".join(map(str, r)) for r in rows)]
    return "\n".join(lines) + "\n"
