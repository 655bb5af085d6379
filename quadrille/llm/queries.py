"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import chat, exact_dedup, gif, language, near_dedup, packing, sentencepieces, sharding, suffix_dedup, window_dedup
from quadrille.llm.common import documents

#: Fixed value: the text of both turns of conversation -1.
PROBE = "</s>[INST] ok [/INST]"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.sql(
        "SELECT -1L AS conv_id, CAST(turn AS BIGINT) AS turn, role, text "
        f"FROM VALUES (0, 'user', '{PROBE}'), (1, 'assistant', '{PROBE}') AS t(turn, role, text)"
    )
    return chat.chat_digests(chat.format_chats(rows.unionByName(probe)))


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer's file, on the driver and the executors alike."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gif.media(documents(spark, sf_dir))
    rgb = F.array_join(F.concat("red", "green", "blue").cast("array<string>"), ",")
    feature = F.concat(F.lit("frames="), "n_frames", F.lit(";ms="), "duration_ms", F.lit(";rgb="), rgb)
    return found.withColumn("feature", feature).drop("red", "green", "blue")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(documents(spark, sf_dir), length=50)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(documents(spark, sf_dir))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encoded(documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"))


#: Production parameter of op6: bytes of text in a shard.
SHARD_BYTES = 1 << 24


#: A smaller one, for tables that one shard would hold.
SMALL_SHARD_BYTES = 1 << 16


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(documents(spark, sf_dir), SHARD_BYTES)


def op6_sharding_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in shards so small that small tables split as well."""
    return sharding.sharded(documents(spark, sf_dir), SMALL_SHARD_BYTES)


#: Production parameter of op7: tokens in a sequence.
SEQUENCE_TOKENS = 2048


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"), SEQUENCE_TOKENS)


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), shingle=4, percent=80)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language.identified(docs, language.fit(docs))


def op10_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_dedup.without_repeats(documents(spark, sf_dir), window=20)


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_gif_media": op2_gif_media,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_sharding": op6_sharding,
    "op6_sharding_small": op6_sharding_small,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_language_id": op9_language_id,
    "op10_window_dedup": op10_window_dedup,
}

_CONTROLS = "+".join(f"(length(text) - length(replace(text, '{c}', ''))) // {len(c)}" for c in chat.CONTROLS)
_BROKEN = " OR ".join(f"contains(text, '{c[0]}\\{c[1:]}')" for c in chat.CONTROLS)


def _sharding_sql(limit: int) -> str:
    return f"""
WITH t AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
         CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM documents),
p AS (
  SELECT depth, (h >> (60 - depth)) + (CAST(1 AS BIGINT) << depth) AS shard, count(*) AS shard_docs, sum(n_bytes) AS shard_bytes
  FROM t, (SELECT CAST(range AS BIGINT) AS depth FROM range(0, 61)) GROUP BY ALL),
f AS (SELECT * FROM p WHERE shard_bytes <= {limit} OR depth = 60),
m AS (
  SELECT doc_id, n_bytes, min(depth) AS depth, arg_min(f.shard, depth) AS shard, arg_min(shard_docs, depth) AS shard_docs,
         arg_min(shard_bytes, depth) AS shard_bytes
  FROM t JOIN f ON f.shard = (t.h >> (60 - f.depth)) + (CAST(1 AS BIGINT) << f.depth) GROUP BY doc_id, n_bytes)
SELECT doc_id, shard, CAST(depth AS INTEGER) AS depth, CAST(0 AS BIGINT) AS page, n_bytes,
       CAST(shard_docs AS BIGINT) AS shard_docs, CAST(shard_bytes AS BIGINT) AS shard_bytes FROM m"""


ORACLES = {
    "op1_chat_format": rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
sized AS (
  SELECT *, {_CONTROLS} AS controls, ({_BROKEN}) AS broken,
         length(text) - length(replace(text, '\', '')) AS slashes FROM rows),
lines AS (
  SELECT *, length(text) + controls + CASE WHEN controls > 0 AND broken THEN slashes ELSE 0 END
            + CASE role WHEN 'user' THEN 14 WHEN 'assistant' THEN 8 ELSE 17 + length(role) END AS chars FROM sized)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars, true AS identical
FROM lines GROUP BY conv_id""",
    "op4_exact_dedup": r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS size,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (
  SELECT norm, arg_min(doc_id, (-size, doc_id)) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM t JOIN g USING (norm)""",
    "op6_sharding": _sharding_sql(SHARD_BYTES),
    "op6_sharding_small": _sharding_sql(SMALL_SHARD_BYTES),
}
