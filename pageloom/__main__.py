"""Runs over captured tables: ``python -m pageloom URL --pages TABLE --out FOLDER [--responses TABLE] [--robots TABLE] ...``,
or ``python -m pageloom postprocess FOLDER`` for a stored run."""

from __future__ import annotations

import sys
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from .functions.options import parse_arguments
from .plans import run
from .sources import sinks


def taken(arguments: list[str], name: str) -> str | None:
    """Removes ``--name value`` from the arguments and returns the value."""
    if f"--{name}" not in arguments:
        return None
    at = arguments.index(f"--{name}")
    value = arguments[at + 1]
    del arguments[at : at + 2]
    return value


def main(arguments: list[str]) -> None:
    spark = SparkSession.builder.appName("pageloom").getOrCreate()
    now = lambda: datetime.now(timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")
    if arguments[:1] == ["postprocess"]:
        sinks.save_pages(run.postprocess(spark, arguments[1], single_file="--no-single-file" not in arguments), arguments[1] + "/postprocessed")
        return
    paths = {name: taken(arguments, name) for name in ("pages", "responses", "robots", "snapshots", "out")}
    read = {k: spark.read.parquet(v) for k, v in paths.items() if v and k != "out"}
    began = now()
    run.save(run.process(options=parse_arguments(arguments), **read), paths["out"], began, now())


if __name__ == "__main__":
    main(sys.argv[1:])
