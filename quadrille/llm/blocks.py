"""Questions about repeated keys, asked by blocks of documents.

A block holds the documents that hash to it, about BLOCK_BYTES of text.
It combines its own keys before any shuffle and sends one packed row to each
bucket of keys; the bucket answers with one bit (or a few) for each key, in the
order in which they came. So a key that a third of all rows holds is sent once a
block, and what comes back is small. Blocks read their texts from one shuffle,
which Spark reuses for each step of a query.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import Ids, written

BLOCK_BYTES = 2 << 20
#: Packed bytes that a bucket's task holds at once.
BUCKET_BYTES = 6 << 20


def text_blocks(docs: DataFrame, ids: Ids, carry: Sequence[str] = (), block_bytes: int | None = None) -> tuple[DataFrame, int, int]:
    """(block, doc_id, text as bytes, carried), the number of blocks, and the bytes of all texts.

    carried is a struct of the columns named, and is there only if some are. Rows
    of one doc_id (null is one) go to different blocks. Equal rows meet in a block
    while they take no more room than one; else all rows are numbered and written
    first, and dealt by their numbers.
    """
    block_bytes = block_bytes or BLOCK_BYTES
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    others = [F.struct(*(F.col(f"`{c}`") for c in carry)).alias("carried")] if carry else []
    rows = docs.select(ids.known().alias("doc_id"), text.alias("text"), *others)
    dealt = F.xxhash64("doc_id", "text")
    alike = rows.groupBy(dealt.alias("dealt")).agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.count("*").alias("n"))
    total, repeated = alike.agg(F.sum("bytes"), F.max(F.when(F.col("n") > 1, F.col("bytes") + 8 * F.col("n")))).first()
    total = total or 0
    count = max(1, math.ceil(total / block_bytes))
    if (repeated or 0) > block_bytes:
        rows = written(rows.withColumn("row", F.monotonically_increasing_id()))
        dealt = F.xxhash64("row")
    return rows.select(F.pmod(dealt, F.lit(count)).alias("block"), "doc_id", "text", *(["carried"] if carry else [])), count, total


def in_order(table: pa.Table) -> pa.Table:
    return table.take(pc.sort_indices(table.select(["doc_id", "text"]), [("doc_id", "ascending"), ("text", "ascending")]))


def read_block(table: pa.Table) -> tuple[int, np.ndarray, list[bytes]]:
    """Block number, doc_ids in rising order (then by text), and their texts."""
    order = in_order(table)
    return order.column("block")[0].as_py(), order.column("doc_id").to_numpy(), order.column("text").to_pylist()


def bucket_ends(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's keys begin in sorted keys: a bucket is a range of keys. One more entry holds the end."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))


def short_keys(keys: np.ndarray) -> bytes:
    """The lower half of each key; the bucket already tells the upper bits.

    A bucket has about a million keys at any size of the input, so a few in ten
    thousand look shared that are not. What follows compares in full.
    """
    return keys.astype(np.uint32).tobytes()


def asked(block: int, keys: np.ndarray, buckets: int) -> pa.Table:
    """Rows that ask the buckets about sorted distinct keys."""
    ends = bucket_ends(keys, buckets)
    used = np.flatnonzero(np.diff(ends))
    blobs = [short_keys(keys[ends[b] : ends[b + 1]]) for b in used]
    return pa.table({"bucket": pa.array(used, pa.int32()), "block": pa.array([block] * len(used), pa.int64()), "data": pa.array(blobs, pa.binary())})


ASKED = "bucket int, block long, data binary"


def seen_often(table: pa.Table, limits: Sequence[int] = (1,)) -> pa.Table:
    """For each asking row and limit, bits that say which of its keys more blocks than that have."""
    blobs = table.column("data").to_pylist()
    keys = np.frombuffer(b"".join(blobs), np.uint32)
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    times = np.empty(len(keys), np.int64)
    size = np.diff(np.r_[first, len(keys)])
    times[order] = np.repeat(size, size)
    ends = np.cumsum([len(b) // 4 for b in blobs])
    bits = [b"".join(np.packbits(times[z - len(b) // 4 : z] > n).tobytes() for n in limits) for b, z in zip(blobs, ends, strict=True)]
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "data": pa.array(bits, pa.binary())})


def seen_twice(table: pa.Table) -> pa.Table:
    return seen_often(table)


ANSWERS = "block long, bucket int, data binary"


def answers(table: pa.Table) -> dict[int, bytes]:
    """bucket -> answer, of one block."""
    return dict(zip(table.column("bucket").to_pylist(), table.column("data").to_pylist(), strict=True))


def answered_bits(table: pa.Table, keys: np.ndarray, buckets: int, limits: int = 1) -> list[np.ndarray]:
    """The bits that answer `asked` with these keys, for each limit."""
    ends = bucket_ends(keys, buckets)
    out = [np.zeros(len(keys), bool) for _ in range(limits)]
    for b, data in answers(table).items():
        n = int(ends[b + 1] - ends[b])
        size = -(-n // 8)
        for k, bits in enumerate(out):
            bits[ends[b] : ends[b + 1]] = np.unpackbits(np.frombuffer(data, np.uint8, size, k * size), count=n).astype(bool)
    return out
