"""Three programs: `diff`, `create` and `query`.

    python -m quadrille.cli diff   -f DATA [-l LEVEL] [--index-type GRID] [--search-type mem|noop] -q QUERY...
    python -m quadrille.cli create {sg|hcqr} -f DATA -o OUT [-l LEVEL] [--index-type GRID] [--compactify [LEVEL]] [--only-leafs] [--modes MODE,...] [--check] [-q QUERY...]
    python -m quadrille.cli query  {-g INDEX|-o DATA} [-s HCQR] ACTION...

`create hcqr` without -q holds the nodes of every token. The actions of `query` run in their order: `-m QUERY` sets the query for those that
follow. Thread counts (-t, -st) are taken and have no effect: Spark's parallelism is
the session's.
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from quadrille.engine import Engine, Index, Result
from quadrille.errors import QuerySyntaxError, UnsupportedFeature
from quadrille.operators import compare, hierarchy, statistics
from quadrille.operators.text import MODES
from quadrille.sources import store
from quadrille.sources.dataset import star_schema

#: Actions that evaluate, and their backends. t: the deferred form, which is the same plan here.
EVALUATIONS = {"-sq": "pixel", "-tsq": "pixel", "-hsq": "hier", "-oq": "cell", "-toq": "cell", "-hoq": "region"}


def _session(tempdir: str | None) -> SparkSession:
    builder = SparkSession.builder.appName("quadrille")
    if tempdir:
        builder = builder.config("spark.local.dir", tempdir)
    return builder.getOrCreate()


def _common(p: argparse.ArgumentParser) -> None:
    p.add_argument("--tempdir")
    p.add_argument("-t", type=int)
    p.add_argument("-st", type=int)
    p.add_argument("-q", action="append", default=[])


def _diff(argv: list[str]) -> int:
    p = argparse.ArgumentParser(prog="diff")
    p.add_argument("-f", required=True)
    p.add_argument("-l", type=int, default=8)
    p.add_argument("--index-type", default="htm")
    p.add_argument("--search-type", choices=["mem", "noop"], default="mem")
    _common(p)
    a = p.parse_args(argv)
    spark = _session(a.tempdir)
    index = Engine(spark).build_index(star_schema(spark, a.f), a.index_type, a.l)
    if a.search_type == "noop":  # the cost of a build that stores nothing
        began = time.time()
        index.pci.write.format("noop").mode("overwrite").save()
        print(f"built in {time.time() - began:.1f} s")
        return 0
    for text in a.q:
        try:
            on_grid, on_cells = index.query(text, "pixel"), index.query(text, "cell")
            row = on_cells.diff(on_grid).first()
        except (QuerySyntaxError, UnsupportedFeature) as e:
            print(f"{text}: {e}", file=sys.stderr)
            continue
        print(f"{text}: {'equal' if row['equal'] else 'different'}; both {row['n_both']}, cells only {row['n_only_a']}, grid only {row['n_only_b']}")
    return 0


def _create(argv: list[str]) -> int:
    p = argparse.ArgumentParser(prog="create")
    p.add_argument("kind", choices=["sg", "hcqr"])
    p.add_argument("-f", required=True)
    p.add_argument("-o", required=True)
    p.add_argument("-l", type=int, default=8)
    p.add_argument("--index-type", default="htm")
    p.add_argument("--compactify", type=int, nargs="?", const=-1)
    p.add_argument("--only-leafs", action="store_true")
    p.add_argument("--modes", default=",".join(MODES))
    p.add_argument("--check", action="store_true")
    _common(p)
    a = p.parse_args(argv)
    spark = _session(a.tempdir)
    began = time.time()
    modes = [m for m in a.modes.split(",") if m]
    if unknown := set(modes) - set(MODES):
        raise SystemExit(f"no match mode {', '.join(sorted(unknown))}; there are {', '.join(MODES)}")
    index = Engine(spark).build_index(star_schema(spark, a.f), a.index_type, a.l, modes=modes)
    if a.kind == "sg":
        store.write_index(index, a.o)
    else:
        most = None if a.compactify is None or a.compactify < 0 else a.compactify
        store.write_hierarchy(index, a.q, a.o, a.compactify is not None, a.only_leafs, most, tokens=not a.q)
    if a.check:
        wrong = store.read_index(spark, a.o if a.kind == "sg" else f"{a.o}/_index").check().count()
        print(f"{wrong} cells differ from the dataset")
        if wrong:
            return 1
    print(f"{a.kind} written to {a.o} in {time.time() - began:.1f} s")
    return 0


def timed(result: Result) -> tuple[int, int, int, int]:
    """Microseconds of evaluation and of flattening, cells (or nodes), and items."""
    began = time.time()
    if result.backend in ("hier", "region"):
        nodes = result.hcqr()
        size = hierarchy.tree_size(nodes, result.index.grid).first()["n_nodes"] if result.backend == "hier" else nodes.count()
    else:
        size = result.stats().first()["n_cells"]
    evaluated = time.time()
    items = result.flatten().count()
    return int((evaluated - began) * 1e6), int((time.time() - evaluated) * 1e6), size, items


def timed_nodes(spark: SparkSession, path: str, text: str) -> tuple[int, int, int, int]:
    """The same of a stored hierarchy."""
    began = time.time()
    nodes = store.read_hierarchy(spark, path, text)
    index = store.read_index(spark, f"{path}/_index")
    size = hierarchy.tree_size(nodes, index.grid).first()["n_nodes"]
    evaluated = time.time()
    items = hierarchy.items(nodes, index.pci, index.grid, index.grid.default_level).count()
    return int((evaluated - began) * 1e6), int((time.time() - evaluated) * 1e6), size, items


def benchmark(index: Index, queries: list[str], backend: str) -> list[tuple[int, int, int, int, int]]:
    """Times and sizes of queries; hierarchical ones run once before they are timed."""
    rows = []
    for k, text in enumerate(queries):
        if backend in ("hier", "region"):
            timed(index.query(text, backend))
        rows.append((k, *timed(index.query(text, backend))))
    return rows


#: What summaries call the columns of raw statistics.
_SUMMARISED = ("cqr", "flaten", "cellCount")


def summaries(spark: SparkSession, name: str, rows: list[tuple[int, int, int, int, int]]) -> str:
    """Summary statistics of the times and sizes of a benchmark, a line each."""
    out = []
    table = spark.createDataFrame(rows, "id long, cqr long, flaten long, cellCount long, items long")
    for c in _SUMMARISED:
        x = statistics.summary(table, c).first()
        out.append(f"{name}::{c}: " + ", ".join(f"{k} {x[k]:g}" for k in x.asDict() if x[k] is not None))
    return "\n".join(out)


def run_benchmark(spark: SparkSession, index: Index, hcqr: str | None, file: str, prefix: str, hierarchical: bool) -> None:
    """Raw statistics of a file's queries beside `prefix`, by the grid, by cells, and from a stored hierarchy; prints summaries."""
    queries = store.read_query_file(spark, file)
    runs = [(index.grid.name, "SpatialIndex", lambda: benchmark(index, queries, "hier" if hierarchical else "pixel"))]
    runs.append(("cells", "Cells", lambda: benchmark(index, queries, "region" if hierarchical else "cell")))
    if hcqr and hierarchical:
        runs.append(("shcqr", "StoredHierarchy", lambda: [(k, *timed_nodes(spark, hcqr, q)) for k, q in enumerate(queries)]))
    for name, title, run in runs:
        rows = run()
        with open(f"{prefix}.{name}.stats.raw", "w") as out:
            out.write(store.raw_statistics(rows, hierarchical))
        if rows:
            print(summaries(spark, title, rows))


def differences(index: Index, text: str):
    """Six symmetric differences of items among flat, deferred and hierarchical results on pixels and cells."""
    of = {a[1:]: index.query(text, b) for a, b in EVALUATIONS.items()}
    by = {a: r.pairs for a, r in of.items()}
    by["hsq"] = hierarchy.items(of["hsq"].hcqr(), index.pci, index.grid, index.grid.default_level)
    return compare.difference_matrix(by, [("sq", "tsq"), ("sq", "hsq"), ("oq", "toq"), ("oq", "hoq"), ("sq", "oq"), ("hsq", "hoq")])


def _query(argv: list[str]) -> int:
    index = text = hcqr = spark = None
    flatten, compact, cached, work = False, True, False, list(argv)

    def value(option: str) -> str:
        if not work:
            raise SystemExit(f"{option} takes a value")
        return work.pop(0)

    if "--tempdir" in work:
        k = work.index("--tempdir")
        spark = _session(work[k + 1] if k + 1 < len(work) else None)
        del work[k : k + 2]
    spark = spark or _session(None)
    while work:
        o = work.pop(0)
        if o == "-g":
            index = store.read_index(spark, value(o))
        elif o == "-o":
            data = value(o)
            index = index or Engine(spark).build_index(star_schema(spark, data), "simplegrid", 8)
        elif o == "-s":
            hcqr = value(o)
        elif o == "-m":
            text = value(o)
        elif o == "-v":
            flatten = int(value(o)) != 0
        elif o == "--compact-hcqr":
            compact = True
        elif o == "--no-compact-hcqr":
            compact = False
        elif o == "--static-hcqr":
            pass  # plans are lazy: there is nothing to make static
        elif o == "--hcqr-cache":
            size = int(value(o))
            cached = size > 0
            if index is None:
                raise SystemExit("-g INDEX or -o DATA comes first")
            index.cache_size = size
        elif o in ("-t", "-st"):
            value(o)
        elif index is None and o != "-shq":
            raise SystemExit("-g INDEX or -o DATA comes first")
        elif o in EVALUATIONS:
            r = index.query(text or "", EVALUATIONS[o], compact, cached)
            stats = r.stats().first()
            print(f"{o[1:]}: {text}: cells {stats['n_cells']}, items {r.flatten().count() if flatten else stats['n_items']}")
        elif o == "-shq":
            nodes = store.read_hierarchy(spark, hcqr, text or "")
            print(f"shq: {text}: nodes {nodes.count()}")
        elif o == "--preload":
            print(f"preloaded {index.preload()} rows")
        elif o == "--stats":
            statistics.area_summary(index.pci, index.grid).show(truncate=False)
            index.stats().show(truncate=False)
        elif o == "--debug-diff":
            differences(index, text or "").show(truncate=False)
        elif o == "--benchmark":
            # The file, the prefix, whether deferred (the same plan here), whether hierarchical, and threads (without effect).
            file, prefix, _, hierarchical, _ = (value(o) for _ in range(5))
            run_benchmark(spark, index, hcqr, file, prefix, hierarchical.lower() in ("1", "true", "yes", "on"))
        else:
            raise SystemExit(f"no option {o}")
    return 0


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    programs = {"diff": _diff, "create": _create, "query": _query}
    if not argv or argv[0] not in programs:
        print(__doc__)
        return 2
    return programs[argv[0]](argv[1:])


if __name__ == "__main__":
    sys.exit(main())
