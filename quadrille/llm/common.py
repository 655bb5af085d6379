"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.shipping import ship  # noqa: F401  the operators take it from here

#: The least long: what a null doc_id becomes inside the operators.
LEAST_ID = -(2**63)

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A fresh path in the folder that the driver and all executors share.

    The folder is the session's spark.checkpoint.dir, or else the context's
    checkpoint directory. Where neither is set, a local session (as in tests)
    gets a temporary folder that goes with the process; a cluster has no folder
    that all share, so that is an error.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _local:
            _local[context.applicationId] = folder = tempfile.mkdtemp(prefix="quadrille-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = _local[context.applicationId]
    return f"{base.rstrip('/')}/quadrille-{context.applicationId}/{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete all temporary tables of this application: results that were not read yet are lost."""
    removed(spark, shared_dir(spark).rsplit("/", 1)[0])


def table(df: DataFrame) -> tuple[DataFrame, str]:
    """Cut the lineage: write the rows to the shared folder and read them again. Also the path."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame) -> DataFrame:
    return table(df)[0]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@dataclass(frozen=True)
class Ids:
    """doc_ids, null among them, as longs in the same order, null first.

    `gap` is the least long that is no doc_id. Null becomes LEAST_ID; ids below the
    gap, if there are any, move up by one. No id is a sentinel.
    """

    gap: int

    def known(self, c: str = "doc_id") -> Column:
        c = F.col(c).cast("long")
        moved = c if self.gap == LEAST_ID else F.when(c < self.gap, c + 1).otherwise(c)
        return F.coalesce(moved, F.lit(LEAST_ID))

    def own(self, c: Column | str = "doc_id") -> Column:
        """The inverse of known."""
        c = F.col(c) if isinstance(c, str) else c
        back = c if self.gap == LEAST_ID else F.when(c <= self.gap, c - 1).otherwise(c)
        return F.when(c != F.lit(LEAST_ID), back)


def ids_of(docs: DataFrame) -> Ids:
    ids = docs.select(F.col("doc_id").cast("long").alias("id"))
    if ids.where(F.col("id") == LEAST_ID).isEmpty():
        return Ids(LEAST_ID)
    ids = ids.where("id IS NOT NULL").distinct()
    followed = ids.where(F.col("id") > LEAST_ID).select((F.col("id") - 1).alias("id"))
    return Ids(ids.join(followed, "id", "left_anti").agg(F.min("id")).first()[0] + 1)


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit mix (the public splitmix64 finaliser) of uint64 values."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
