"""Exact dedup by a log-structured merge index, in DataFrame functions only.

* Memtable: each task holds the index entries of its input rows and flushes them
  as one run, sorted by digest: a Parquet file, whose footer holds the digest
  range and a Bloom filter of each row group (for single lookups).
* Filters: a run's filter is the set of its digests' 64-bit fingerprints. Runs are
  probed against all filters at once: a fingerprint that occurs once among them
  says that the digest has no copy, and its entry skips the compaction.
* Compaction: the entries left are merged level by level, FAN runs into one; a
  digest keeps its best entry (most code points, then smallest identifier) and the
  number of its entries. Entries combine before each shuffle, so a digest that a
  third of all rows share sends one row a task.
* Hits (digests of more than one entry) are verified byte by byte against the
  text that stays. A digest whose texts differ is grouped again by its texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import Ids, ids_of, removed, shared_dir, table, text_or_empty, written

#: The characters that comparison ignores.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"

#: Runs that a compaction merges into one.
FAN = 16


def normalised(text: Column) -> Column:
    for c in BLANKS:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def sha256(norm: Column) -> Column:
    return F.unhex(F.sha2(norm.cast("binary"), 256))


def flush_runs(docs: DataFrame, ids: Ids, path: str, digest: Callable[[Column], Column] = sha256) -> None:
    """Write the index entries of docs under path, as sorted runs with filters."""
    text = text_or_empty()
    entries = docs.select(digest(normalised(text)).alias("digest"), ids.known().alias("doc_id"), F.length(text).cast("long").alias("size"))
    entries = entries.withColumns({"run": F.spark_partition_id().cast("long"), "fingerprint": F.xxhash64("digest")})
    entries.sortWithinPartitions("digest").write.mode("append").option("parquet.bloom.filter.enabled#digest", "true").parquet(path)


def open_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("digest binary, doc_id long, size long, run long, fingerprint long").parquet(path)


def lookup(spark: SparkSession, path: str, digest: bytes) -> DataFrame:
    """Entries of one digest; runs and row groups whose range or filter excludes it are skipped."""
    return open_runs(spark, path).where(F.col("digest") == F.lit(digest))


def probed(runs: DataFrame) -> DataFrame:
    """runs with `maybe`: whether the filters say that a digest may occur again."""
    again = runs.groupBy("fingerprint").count().where("count > 1").select("fingerprint", F.lit(True).alias("maybe"))
    # Written: Spark splits a hot fingerprint in a join of plain rows, but not right behind the aggregate.
    return runs.join(written(again).hint("merge"), "fingerprint", "left").withColumn("maybe", F.coalesce("maybe", F.lit(False)))


def merged(level: DataFrame) -> DataFrame:
    """The next level: each FAN runs as one, with one entry a digest."""
    # Most code points, then the smallest id, are the least of the struct.
    best = F.min(F.struct((-F.col("size")).alias("less"), F.col("doc_id").alias("doc_id"))).alias("best")
    groups = level.groupBy(F.floor(F.col("run") / FAN).cast("long").alias("run"), "digest").agg(best, F.sum("entries").alias("entries"))
    return groups.select("run", "digest", F.col("best.doc_id").alias("doc_id"), (-F.col("best.less")).alias("size"), "entries")


def compacted(runs: DataFrame) -> DataFrame:
    """digest, keep_id, group_size: one row a digest, from runs merged level by level."""
    last = runs.agg(F.max("run")).first()[0] or 0
    level, path = runs.select("run", "digest", "doc_id", "size", F.lit(1).cast("long").alias("entries")), None
    while True:
        before = path
        level, path = table(merged(level))
        if before:
            removed(level.sparkSession, before)
        last //= FAN
        if not last:
            return level.select("digest", F.col("doc_id").alias("keep_id"), F.col("entries").alias("group_size"))


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, digest.

    Texts are equal when equal without BLANKS; null counts as empty, so null,
    empty and blank texts form one group. Of ties in code points the smallest
    doc_id stays; a null doc_id is smaller than any other. Rows that repeat a
    doc_id count in group_size, and all of them have kept where that id stays.
    An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    path = shared_dir(spark)
    ids = ids_of(docs)
    flush_runs(docs, ids, path, digest)
    # All written: Spark splits a hot digest in a join of plain rows, but not between aggregates on digest.
    entries = written(probed(open_runs(spark, path)))
    several = entries.where("maybe").select("run", "digest", "doc_id", "size")
    index = compacted(several)
    out = written(several.select("digest", "doc_id").join(index.hint("merge"), "digest"))

    # Byte verification of hits: each text against the one that stays.
    hits = out.where("group_size > 1").select("digest", "doc_id", "keep_id").distinct()
    texts = docs.select(ids.known().alias("doc_id"), normalised(text_or_empty()).alias("norm"))
    texts = texts.withColumn("digest", digest(F.col("norm")))
    members = written(texts.join(hits.hint("merge"), ["doc_id", "digest"]))
    kept = written(members.where("doc_id = keep_id").select("digest", F.col("norm").alias("kept_norm")).dropDuplicates(["digest"]))
    # Written before it is made distinct: an aggregate on digest right behind the join would keep Spark from splitting a hot digest.
    differing = written(members.join(kept, "digest").where("norm != kept_norm").select("digest")).distinct()
    columns = ["doc_id", "keep_id", "group_size", "digest"]
    if not differing.isEmpty():
        sized = docs.select(ids.known().alias("doc_id"), normalised(text_or_empty()).alias("norm"), F.length(text_or_empty()).cast("long").alias("size"))
        again = sized.withColumn("digest", digest(F.col("norm"))).join(differing, "digest", "left_semi")
        best = F.min(F.struct((-F.col("size")).alias("less"), F.col("doc_id")))
        groups = again.groupBy("digest", "norm").agg(best["doc_id"].alias("keep_id"), F.count("*").alias("group_size"))
        again = again.join(groups, ["digest", "norm"])
        out = out.join(differing, "digest", "left_anti").select(columns).unionByName(again.select(columns))
    single = entries.where("NOT maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "digest")
    return out.select(columns).unionByName(single).select(
        ids.own("doc_id").alias("doc_id"),
        ids.own("keep_id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("doc_id") == F.col("keep_id")).alias("kept"),
        "digest",
    )
