"""One query for each operator, over its whole table, with the SQL that gives the same where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logweave.llm import classifier, linededup, media, mixing, neardup, packing, quality_rules, secrets, tokenize, warc


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(_documents(spark, sf_dir))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"), min_bytes=0)
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), _vocabulary("byte_bpe_50k.json"), end_id=0, capacity=1024)


#: Seed of the mix; part of its definition.
MIX_SEED = 20240229


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir), share=1.5, max_epochs=2.0, seed=MIX_SEED)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_documents(spark, sf_dir), percent=85)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.count_tokens(_documents(spark, sf_dir), _vocabulary("word_bpe_49k.json"), limit=2048)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(_documents(spark, sf_dir))


def op8_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(_documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.fit_and_apply(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return classifier.score(docs, classifier.fit(docs, _labels(spark, sf_dir)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_line_dedup, op2_warc, op3_packing, op4_mixing, op5_minhash, op6_token_counts, op7_secrets, op8_media_chunks, op9_quality_rules, op10_quality_classifier)
}

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

SQL: dict[str, str] = {
    "op2_warc": f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS hex FROM p),
g AS (SELECT hex, max(page_id) AS last_id FROM d GROUP BY hex)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('{_BASE32}',
    ((CAST('0x' || substr(hex, CAST(5 * (k // 4) + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last_id THEN NULL ELSE last_id END AS refers_to
FROM d JOIN g USING (hex)""",
    "op4_mixing": mixing.MIX_SQL.replace("{seed}", str(MIX_SEED)),
    "op5_minhash": neardup.NEAR_SQL,
    "op7_secrets": secrets.SECRETS_SQL,
}
