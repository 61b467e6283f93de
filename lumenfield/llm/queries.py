"""The ten production queries, one for each operator, and SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, codec, langid, media, mixing, secret_scan, simhash, suffix, tokens, warc

#: The vocabulary file; another place can be named in the environment.
VOCABULARY = "byte_bpe_50k.json"


def vocabulary() -> str:
    import public_tokenizers

    return os.environ.get("LUMENFIELD_VOCABULARY") or public_tokenizers.path(VOCABULARY)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary(), 512)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, seed=42, radius=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_telephony_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), codec="mulaw")


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary())


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    spans = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.array_join(spans, ",").alias("spans"))


def op7_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), least_bytes=0))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), cosine=0.9)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", langid.held_out())
    return langid.identify(docs, keep=["doc_id", "held_out"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_simhash_near_dedup, op3_source_mix, op4_telephony_media, op5_bpe_codec, op6_secret_scan, op7_warc_archives, op8_embedding_near_dedup, op9_suffix_dedup, op10_language_id)}


_OP7 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first, row_number() OVER (PARTITION BY hex ORDER BY page_id) AS nth FROM p),
bits AS (SELECT *, list_transform(range(32), lambda i: (
    ('0x' || substr(hex, (1 + (i * 5) // 4)::BIGINT, 2))::BIGINT // CAST(pow(2, 3 - (i * 5) % 4) AS BIGINT)) % 32) AS five FROM d)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(five, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN nth = 1 OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN nth > 1 THEN first END AS refers_to
FROM bits"""


def oracle_sql() -> dict[str, str]:
    return {"op7_warc_archives": _OP7}
