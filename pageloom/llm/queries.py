"""The queries of the llm operators, and SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, exact_dedup, fingerprints, mixing, near_dedup, packing, periodic, quality, rans, secrets, sharding, token_counts, toxicity
from .common import load_documents

SHARDS = [f"shard-{i:03d}" for i in range(64)]


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(load_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.in_training_order(mixing.mixing_plan(load_documents(spark, sf_dir)))
    return plan.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 6).alias("position"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_dedup(load_documents(spark, sf_dir))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_report(load_documents(spark, sf_dir))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_components(load_documents(spark, sf_dir), shingle=2)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.round_trip(load_documents(spark, sf_dir)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(load_documents(spark, sf_dir))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(token_counts.with_middle_edit(load_documents(spark, sf_dir)))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(load_documents(spark, sf_dir).select("doc_id", "text"), SHARDS).select("doc_id", "slot", "shard")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load_documents(spark, sf_dir))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_report(conversations.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(load_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.runs_report(load_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_classifier, op2_source_mixing, op3_exact_dedup, op4_fingerprints, op5_near_dedup, op6_token_files, op7_secret_scan, op8_token_counts, op9_sharding, op10_packing, op11_conversation_repair, op12_toxicity, op13_periodic_runs)
}

ORACLE_SQL = {
    "op2_source_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS draw FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS k FROM s),
v AS (SELECT source, source_size, CASE k WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight,
             CASE k WHEN 0 THEN -0.5 WHEN 1 THEN 0.0 ELSE 0.5 END::DOUBLE AS slope FROM w),
l AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM v WINDOW o AS (ORDER BY 2 * source_size / weight, source NULLS LAST)),
t AS (SELECT source, source_size, slope, least(2.0 * source_size, weight *
             coalesce(max(level) FILTER (WHERE level * weight <= 2 * source_size) OVER (), 'inf'::DOUBLE)) AS target FROM l),
p AS (SELECT d.*, t.source_size, t.slope, t.target, sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id, size) - size AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, greatest(0, least(size, CAST(round(target) AS BIGINT) - start)) AS a,
             greatest(0, least(size, CAST(round(target) AS BIGINT) - start - source_size)) AS b,
             CASE WHEN target > 0 THEN start / target ELSE 0 END AS part FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(a + b AS BIGINT) AS taken,
       CASE WHEN a > 0 THEN round(least(1.0, 2 * part / ((1 - slope / 2) + sqrt(greatest(0.0, (1 - slope / 2) * (1 - slope / 2) + 2 * slope * part)))), 6) END AS position
FROM c""",
    "op3_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
}
