"""Sinks: pages, assets, manifests, logs and documents of a run."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Phases of errors.
PHASES = ("robots", "navigation", "asset-save", "css-rewrite", "inline-css-rewrite", "inline-css-save", "inline-css-extract", "design", "agent-context")


def _put(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file through Hadoop's file system, so that any store will do."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def save_pages(pages: DataFrame, run_dir: str) -> None:
    """SNK1: rewritten pages as a table (``url, path, html``)."""
    pages.select("url", "path", "html").write.mode("overwrite").parquet(f"{run_dir}/pages.parquet")


def save_assets(assets: DataFrame, run_dir: str) -> None:
    """SNK2, SNK3: each file once (``path, body``)."""
    assets.dropDuplicates(["path"]).select("path", "body").write.mode("overwrite").parquet(f"{run_dir}/assets.parquet")


def save_files(files: DataFrame, run_dir: str) -> None:
    """SNK1 to SNK3 as single files below ``run_dir``: for one site's export, row by row through the driver."""
    for row in files.select("path", "body").toLocalIterator():
        _put(files.sparkSession, f"{run_dir}/{row.path}", bytes(row.body))


def manifest_row(source_url: str, started_at: str, finished_at: str, options: dict, pages: DataFrame, assets: DataFrame, errors: DataFrame) -> DataFrame:
    """SNK4: one row with the manifest's JSON; entries in order of ``ordinal``."""
    spark = pages.sparkSession

    def listed(df: DataFrame, name: str) -> DataFrame:
        columns = [c for c in df.columns if c != "ordinal"]
        rows = F.sort_array(F.collect_list(F.struct("ordinal", F.struct(*columns).alias("e"))))
        return df.agg(F.transform(rows, lambda r: r["e"]).alias(name))

    head = spark.range(1).select(F.lit(source_url).alias("sourceUrl"), F.lit(started_at).alias("startedAt"), F.lit(finished_at).alias("finishedAt"), F.from_json(F.lit(json.dumps({k: str(v) for k, v in options.items()})), "map<string,string>").alias("options"))
    for name, df in (("pages", pages), ("assets", assets), ("errors", errors)):
        head = head.crossJoin(listed(df, name))  # one row each
    return head.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value"))


def save_manifest(manifest: DataFrame, run_dir: str) -> None:
    _put(manifest.sparkSession, f"{run_dir}/scrape-manifest.json", manifest.first().value.encode())


def save_events(events: DataFrame, run_dir: str) -> None:
    """SNK5: events as JSON lines, appended."""
    events.write.mode("append").json(f"{run_dir}/scrape-log.jsonl")


def error_rows(df: DataFrame, phase: str) -> DataFrame:
    """SNK6: ``url, error, phase`` of rows that carry an error."""
    if phase not in PHASES:
        raise ValueError(phase)
    return df.where("error is not null").select("url", "error", F.lit(phase).alias("phase"))


def save_text(spark: SparkSession, path: str, text: str) -> None:
    """SNK7, SNK8: a document."""
    _put(spark, path, text.encode())


def progress(pages: DataFrame, errors: DataFrame) -> DataFrame:
    """AGG14: one row ``completed, ok, failed``; pages that robots rules deny count as failed."""
    failed = errors.where(F.col("phase").isin("robots", "navigation")).select("url").distinct().agg(F.count(F.lit(1)).alias("failed"))
    ok = pages.agg(F.count(F.lit(1)).alias("ok"))
    return ok.crossJoin(failed).select((F.col("ok") + F.col("failed")).alias("completed"), "ok", "failed")  # one row each
