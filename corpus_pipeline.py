"""The corpus pipeline: documents to training sequences, in stages that are written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import exact_dedup, language, near_dedup, packing, suffix_dedup
from quadrille.llm.common import removed, table, written
from quadrille.llm.queries import SEQUENCE_TOKENS, tokenizer_file


def _only(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is kept, with all columns; a null doc_id counts as an id."""
    kept = decisions.where("kept").select(F.col("doc_id").alias("__kept_id")).distinct()
    return docs.join(kept.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__kept_id")), "left_semi")


def _by_row(docs: DataFrame) -> DataFrame:
    """docs with a doc_id of each row's own and the given one in __own_id.

    Ids that repeat (null counts as an id) give way to places in the order of the
    given ids, null first, so that ties fall as they would by them. Where none
    repeats, the ids stand as they are and nothing moves.
    """
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs.withColumn("__own_id", F.col("doc_id"))
    placed = docs.withColumn("__row", F.monotonically_increasing_id()).orderBy(F.asc_nulls_first("doc_id"), "__row")
    # Written, as the places must not change between two readings.
    return written(placed.drop("__row").withColumnRenamed("doc_id", "__own_id").withColumn("doc_id", F.monotonically_increasing_id()))


def _given(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of _by_row with the ids and columns that were given."""
    return rows.select(*(F.col("__own_id").alias(c) if c == "doc_id" else F.col(f"`{c}`") for c in columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: no letter, or no language that stands out."""
    return language.accepted(docs, language.fit(docs))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of equal texts, whatever the ids."""
    rows = _by_row(docs)
    return _given(_only(rows, exact_dedup.exact_groups(rows)), docs.columns)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each component of near duplicates, whatever the ids."""
    rows = _by_row(docs)
    return _given(_only(rows, near_dedup.near_duplicates(rows, shingle=5, percent=80)), docs.columns)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove repeated passages from the texts, among rows of one id too; n_chars follows. No document goes."""
    rows = _by_row(docs)
    found = suffix_dedup.without_repeats(rows, text=True, carry=rows.columns)
    return found.select(
        *(
            F.col("kept_text").alias(c) if c == "text" else F.length("kept_text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("carried.__own_id" if c == "doc_id" else f"carried.`{c}`").alias(c)
            for c in docs.columns
        )
    )


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into training sequences."""
    return packing.packed(docs, tokenizer_file("word_bpe_49k.json"), SEQUENCE_TOKENS)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup_stage),
    ("MinHash near-dedup", minhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("best-fit packing", best_fit_packing),
]

#: SQL can't express the language model, the similarity links or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, over documents; each stage's rows are written and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs, path = table(stage(spark, docs, sf_dir))
        if before:
            removed(spark, before)
        before = path
    return docs
