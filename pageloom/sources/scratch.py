"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Temporary folders of local applications whose session names none.
_OWN: dict[str, str] = {}


def scratch_path(spark: SparkSession, what: str) -> str:
    """A fresh path under ``spark.checkpoint.dir`` (a temporary folder where a local master sets none); it is deleted when the
    driver's JVM ends."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        context = spark.sparkContext
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = _OWN.setdefault(context.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="pageloom-")
        _OWN[context.applicationId] = at
    path = f"{at.rstrip('/')}/pageloom/{what}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to a scratch path and read back."""
    path = scratch_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
