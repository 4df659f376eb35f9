"""Sources: captured tables, manifests, stored files, and the latest run of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "scrape-manifest.json"
PAGE = "struct<url:string,path:string,depth:int,status:int,contentType:string,timestamp:string>"
ASSET = "struct<url:string,path:string,contentType:string,size:bigint,hash:string>"
ERROR = "struct<url:string,error:string,phase:string,timestamp:string>"
MANIFEST_SCHEMA = f"sourceUrl string, startedAt string, finishedAt string, options map<string,string>, pages array<{PAGE}>, assets array<{ASSET}>, errors array<{ERROR}>"


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Captured pages: ``page_id, url, html``."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def responses(spark: SparkSession, path: str) -> DataFrame:
    """Captured responses: ``page_id, seq, url, status, content_type, body``."""
    return spark.read.parquet(path).select("page_id", "seq", "url", "status", "content_type", "body")


def manifest(spark: SparkSession, run_dir: str) -> dict[str, DataFrame]:
    """SRC8: tables ``pages``, ``assets`` and ``errors`` of a manifest; entries without url or path are dropped."""
    doc = spark.read.schema(MANIFEST_SCHEMA).json(f"{run_dir}/{MANIFEST}", multiLine=True)

    def rows(name: str) -> DataFrame:
        return doc.select(F.posexplode(name).alias("ordinal", "e")).select("ordinal", "e.*")

    kept = {k: rows(k).where("url is not null and path is not null") for k in ("pages", "assets")}
    return kept | {"errors": rows("errors")}


def stored_files(spark: SparkSession, run_dir: str) -> DataFrame:
    """SRC9: ``path`` (below the run), ``body`` and ``size`` of all stored files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(run_dir)
    at = spark._jvm.org.apache.hadoop.fs.Path(run_dir)
    root = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at)
    # paths are addresses with their file system; the root as a path is spelled either way
    below = [F.when(F.startswith("path", F.lit(f"{x.rstrip('/')}/")), F.substring("path", len(x.rstrip("/")) + 2, 1 << 20)) for x in (root.toString(), root.toUri().toString())]
    return files.select(F.coalesce(*below).alias("path"), F.col("content").alias("body"), F.col("length").alias("size"))


def latest_run(spark: SparkSession, folder: str) -> str | None:
    """SRC10: the run below ``folder`` whose manifest is newest; one aggregated row reaches the driver."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", MANIFEST).load(folder)
    return found.agg(F.max_by(F.regexp_replace("path", "/[^/]*$", ""), "modificationTime")).first()[0]
