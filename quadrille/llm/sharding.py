"""Sharding by extendible hashing, in DataFrame functions only.

A document's 60-bit hash is the leading bits of the SHA-256 of its doc_id. A shard
of depth d holds all documents that share its d leading bits; only a shard over
the byte limit splits on its next bit. The directory has an entry for each prefix
of a common number of bits (a few more than evenly filled shards need), which
points to the shard that the prefix belongs to.

Splitting one bucket after the other would take a job each. The sizes of all
prefixes say the same: they are added up from the directory's entries, some bits
at a time, and a prefix is a shard if it fits and the prefix one bit shorter does
not. Only entries that are still too large go on, on all bits of their hashes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadrille.llm.common import text_or_empty, written

BITS = 60
#: Bits of the directory beyond those that evenly filled shards need.
SPARE_BITS = 6
#: Bits by which sizes are added up at once.
STEP_BITS = 4


def hash_bits(key: Column) -> Column:
    return F.conv(F.substring(F.sha2(key.cast("string").cast("binary"), 256), 1, BITS // 4), 16, 10).cast("long")


def _prefix(depth: Column | int) -> Column:
    """The leading bits of `h`, with a 1 before them: no two prefixes of different depth are alike."""
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.call_function("shiftright", F.col("h"), (F.lit(BITS) - depth).cast("int")) + F.call_function("shiftleft", F.lit(1).cast("long"), depth.cast("int"))


def _deep(sizes: DataFrame, first: int, limit: int) -> DataFrame:
    """h -> (depth, shard, shard_docs, shard_bytes): the shortest prefix of at least `first` bits within the limit, else all bits."""
    levels = sizes.select("h", "docs", "bytes", F.explode(F.sequence(F.lit(first), F.lit(BITS))).alias("depth"))
    levels = levels.withColumn("shard", _prefix(F.col("depth")))
    totals = levels.groupBy("depth", "shard").agg(F.sum("docs").alias("shard_docs"), F.sum("bytes").alias("shard_bytes"))
    fits = totals.where((F.col("shard_bytes") <= limit) | (F.col("depth") == BITS))
    best = levels.select("h", "depth", "shard").join(fits, ["depth", "shard"])
    row = F.min(F.struct("depth", "shard", "shard_docs", "shard_bytes")).alias("x")
    return best.groupBy("h").agg(row).select("h", "x.*")


def _prefix_sizes(entries: DataFrame, bits: int) -> DataFrame:
    """entries: (prefix, docs, bytes) of `bits` bits. (depth, prefix, docs, bytes) of all prefixes of them."""
    out = None
    while True:
        step = min(STEP_BITS, bits)
        depth = F.explode(F.sequence(F.lit(bits - step), F.lit(bits))).alias("depth")
        levels = entries.select(depth, "prefix", "docs", "bytes")
        shorter = F.call_function("shiftright", F.col("prefix"), F.lit(bits) - F.col("depth"))
        levels = levels.groupBy("depth", shorter.alias("prefix")).agg(F.sum("docs").alias("docs"), F.sum("bytes").alias("bytes"))
        found = levels if bits - step == 0 else levels.where(F.col("depth") > bits - step)
        out = found if out is None else out.unionByName(found)
        if bits == step:
            return out
        entries = written(levels.where(F.col("depth") == bits - step).drop("depth"))
        bits -= step


def directory(entries: DataFrame, bits: int, limit: int) -> DataFrame:
    """leaf -> (depth, shard, shard_docs, shard_bytes), for all prefixes of `bits` bits that a shard covers: those of shards within the limit, and of entries above it."""
    sizes = written(_prefix_sizes(entries, bits))
    large = sizes.where(F.col("bytes") > limit).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("above"))
    above = F.call_function("shiftright", F.col("prefix"), F.lit(1))
    found = sizes.withColumn("above", above).where((F.col("bytes") <= limit) | (F.col("depth") == bits))
    shards = found.where("depth = 0").drop("above").unionByName(found.where("depth > 0").join(large, ["depth", "above"], "left_semi").drop("above"))
    rest = F.lit(bits) - F.col("depth")
    first = F.call_function("shiftleft", F.col("prefix"), rest)
    last = F.call_function("shiftleft", F.col("prefix") + 1, rest) - 1
    shard = F.col("prefix") + F.call_function("shiftleft", F.lit(1).cast("long"), F.col("depth"))
    return shards.select(F.explode(F.sequence(first, last)).alias("leaf"), "depth", shard.alias("shard"), F.col("docs").alias("shard_docs"), F.col("bytes").alias("shard_bytes"))


def sharded(docs: DataFrame, limit_bytes: int) -> DataFrame:
    """One row for each row of docs: doc_id, shard, depth, page, n_bytes, shard_docs, shard_bytes.

    A null text has no bytes. A null doc_id hashes as the empty string. Rows
    of equal doc_id have equal hashes, which no bit can part: where they exceed
    the limit at full depth, they go to numbered pages of that shard, dealt by a
    hash of the row and filled in order to at most half the limit before the
    next page begins. A text larger than the limit is alone on a page. `page` is
    0 elsewhere; shard_docs and shard_bytes count a page. An empty table gives no
    rows. Other columns are not read.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.octet_length(text_or_empty()).cast("long").alias("n_bytes"),
        F.crc32(text_or_empty().cast("binary")).alias("crc"),
    ).withColumn("h", hash_bits(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    first = min(BITS - 1, max(0, math.ceil(math.log2(max(1, total / limit_bytes)))) + SPARE_BITS)

    sizes = rows.groupBy("h").agg(F.count("*").alias("docs"), F.sum("n_bytes").alias("bytes"))
    leaf = F.call_function("shiftright", F.col("h"), F.lit(BITS - first))
    entries = sizes.groupBy(leaf.alias("prefix")).agg(F.sum("docs").alias("docs"), F.sum("bytes").alias("bytes"))
    top = directory(entries, first, limit_bytes)
    over = top.where(F.col("shard_bytes") > limit_bytes).select("leaf")
    deep = _deep(sizes.withColumn("leaf", leaf).join(over, "leaf", "left_semi").drop("leaf"), first + 1, limit_bytes)
    fits = rows.withColumn("leaf", leaf).join(top.where(F.col("shard_bytes") <= limit_bytes), "leaf").drop("leaf")
    rest = rows.withColumn("leaf", leaf).join(over, "leaf", "left_semi").drop("leaf").join(deep, "h")
    columns = ["doc_id", "shard", "depth", "page", "n_bytes", "shard_docs", "shard_bytes"]
    one = F.lit(0).cast("long").alias("page")
    alone = rest.where((F.col("shard_bytes") <= limit_bytes) | (F.col("shard_docs") == 1)).withColumn("page", one)

    # Pages of equal hashes: each of some streams is filled on its own.
    streams = F.ceil(F.col("shard_bytes") / limit_bytes)
    many = rest.where((F.col("shard_bytes") > limit_bytes) & (F.col("shard_docs") > 1))
    many = many.withColumn("stream", F.pmod(F.xxhash64("doc_id", "n_bytes", "crc"), streams))
    large = F.col("n_bytes") * 2 > limit_bytes
    order = Window.partitionBy("shard", "stream", "large").orderBy("doc_id", "n_bytes", "crc").rowsBetween(Window.unboundedPreceding, -1)
    step = F.when(F.col("large"), F.count("*").over(order)).otherwise(F.floor(F.coalesce(F.sum("n_bytes").over(order), F.lit(0)) * 2 / limit_bytes))
    many = many.withColumn("large", large).withColumn("step", step.cast("long"))
    paged = many.groupBy("shard", "stream", "large", "step").agg(F.count("*").alias("shard_docs"), F.sum("n_bytes").alias("shard_bytes"))
    number = F.row_number().over(Window.partitionBy("shard").orderBy("stream", "large", "step")).cast("long")
    paged = paged.withColumn("page", number)
    many = many.drop("shard_docs", "shard_bytes").join(paged, ["shard", "stream", "large", "step"])
    out = fits.withColumn("page", one).select(columns).unionByName(alone.select(columns)).unionByName(many.select(columns))
    return out.withColumn("depth", F.col("depth").cast("int"))
