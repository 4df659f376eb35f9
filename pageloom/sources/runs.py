"""Run folders as a data source: ``spark.read.format("pageloom_run").load(folder)`` and ``df.write.format(...).save(folder)``.

A row is a stored file: ``role`` (page or asset), ``ordinal``, ``url``, ``path`` below the folder, ``depth``, ``status``,
``content_type``, ``timestamp``, ``size``, ``hash``, ``stored`` (where its content is, below the folder) and ``body``. Tasks
write the files and a list of what they wrote; the commit, once all tasks are done, puts the lists under one marker,
``_lists/CURRENT``, which is what makes them a run. No file is ever overwritten: one that is there with another content
stays, and the new one is stored under ``.versions``. So a run that is broken off, or a task that is lost, leaves files
that no list names, and the run before stays as it was. A row without ``body`` whose ``stored`` is given is listed anew
as it is. Reading follows the marker: each task reads one list, and the bodies of the chosen entries only.

No row passes the driver: it sees the names of the lists, one a task. Folders are paths that all executors share and that
Arrow's file systems open (local and mounted ones, S3, GCS, HDFS with its library).
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.urls import normalize_url

FORMAT = "pageloom_run"
SCHEMA = "role string, ordinal bigint, url string, path string, depth int, status int, content_type string, timestamp string, size bigint, hash string, stored string, body binary"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
_LISTED = pa.schema([("role", pa.string()), ("ordinal", pa.int64()), ("url", pa.string()), ("path", pa.string()), ("depth", pa.int32()), ("status", pa.int32()), ("content_type", pa.string()), ("timestamp", pa.string()), ("size", pa.int64()), ("hash", pa.string()), ("stored", pa.string())])
_FULL = _LISTED.append(pa.field("body", pa.binary()))
MARKER, LISTS = "_lists/CURRENT", "_lists"
#: Rows of one batch that a reader hands over, and bytes of bodies after which a batch ends.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def _opened(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), os.path.abspath(folder))


def _inside(root: str, path: str) -> str:
    """Where a stored file is; a path that leaves the folder is an error."""
    full = os.path.normpath(f"{root}/{path}")
    if not full.startswith(f"{root.rstrip('/')}/") or full.startswith(f"{root.rstrip('/')}/{LISTS}/"):
        raise ValueError(f"{path} isn't a file of the run")
    return full


def _put(files: pafs.FileSystem, path: str, data: bytes) -> None:
    """Writes a file aside and moves it to its place, so that nobody reads half of it."""
    aside = f"{path}.{uuid.uuid4().hex}.tmp"
    files.create_dir(os.path.dirname(path), recursive=True)
    with files.open_output_stream(aside) as out:
        out.write(data)
    files.move(aside, path)


@dataclass
class Written(WriterCommitMessage):
    """The list that a task wrote."""

    name: str
    rows: int


class RunWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite, self.version = folder, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        """Stores the files of a task's rows, then its list. Equal paths may come from several tasks."""
        files, root = _opened(self.folder)
        listed: list[pa.RecordBatch] = []
        for batch in iterator:
            rows = batch.to_pylist()
            for row in rows:
                body = row.pop("body")
                row["role"] = row["role"] or "asset"
                if body is None and row["stored"]:
                    continue
                body = body or b""
                row["size"], row["hash"] = len(body), hashlib.sha256(body).hexdigest()[:16]
                row["stored"] = self.store(files, root, row["path"], body)
            listed.append(pa.RecordBatch.from_pylist(rows, _LISTED))
        table = pa.Table.from_batches(listed, _LISTED)
        name = f"{self.version}-{uuid.uuid4().hex}.arrow"
        sink = pa.BufferOutputStream()
        with pa.ipc.new_file(sink, table.schema) as out:
            out.write_table(table)
        _put(files, f"{root}/{LISTS}/{name}", sink.getvalue().to_pybytes())
        return Written(name, len(table))

    def store(self, files: pafs.FileSystem, root: str, path: str, body: bytes) -> str:
        """Where a file's content is kept: at its path, unless another content is there already."""
        for place in (path, f".versions/{self.version}/{hashlib.sha256(body).hexdigest()[:16]}/{path}"):
            full = _inside(root, place)
            found = files.get_file_info(full)
            if found.type == pafs.FileType.NotFound:
                _put(files, full, body)
                return place
            if found.size == len(body):
                with files.open_input_stream(full) as data:
                    if data.read() == body:
                        return place
        raise FileExistsError(path)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Makes the lists of all tasks the run (with ``append``, besides those that it has): one file is replaced."""
        files, root = _opened(self.folder)
        names = [m.name for m in messages if m is not None and m.rows]
        _put(files, f"{root}/{MARKER}", json.dumps([*([] if self.overwrite else current_lists(self.folder)), *sorted(names)]).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = _opened(self.folder)
        for m in messages:
            if m is not None:
                files.delete_file(f"{root}/{LISTS}/{m.name}")


def current_lists(folder: str) -> list[str]:
    """Names of the lists that make up the run; none if there is no run yet."""
    files, root = _opened(folder)
    at = f"{root}/{MARKER}"
    if files.get_file_info(at).type == pafs.FileType.NotFound:
        return []
    with files.open_input_stream(at) as data:
        return json.loads(data.read())


@dataclass
class ListPart(InputPartition):
    name: str


class RunReader(DataSourceReader):
    def __init__(self, folder: str, schema: StructType, role: str | None, prefix: str | None):
        self.folder, self.names, self.role, self.prefix = folder, schema.fieldNames(), role, prefix

    def _fits(self, row: dict) -> bool:
        return (not self.role or row["role"] == self.role) and (not self.prefix or (row["path"] or "").startswith(self.prefix))

    def partitions(self) -> list[InputPartition]:
        """One for each list, that is for each task that wrote."""
        return [ListPart(n) for n in current_lists(self.folder)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        files, root = _opened(self.folder)
        if partition is None or not partition.name:
            return
        schema = pa.schema([_FULL.field(n) for n in self.names])
        with files.open_input_file(f"{root}/{LISTS}/{partition.name}") as data:
            listed = pa.ipc.open_file(data).read_all().to_pylist()
        held, size = [], 0
        for row in listed:
            if not self._fits(row):
                continue
            if "body" in self.names:
                with files.open_input_stream(_inside(root, row["stored"])) as data:
                    row["body"] = data.read()
                size += len(row["body"])
            held.append({n: row[n] for n in self.names})
            if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(held, schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)


class RunSource(DataSource):
    """SRC8 to SRC10, SNK1 to SNK4: stored runs. Without ``body`` in the schema only the lists are read; the options ``role``
    and ``prefix`` (of path) choose entries before any body is opened. They are options and no pushed filters, since a
    table of a Python source has one reader, which two filters of one query would share."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return RunReader(self.options["path"], schema, self.options.get("role"), self.options.get("prefix"))

    def writer(self, schema: StructType, overwrite: bool) -> RunWriter:
        if set(schema.fieldNames()) != set(COLUMNS):
            raise ValueError(f"a run has the columns {', '.join(COLUMNS)}")
        return RunWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(RunSource)


def load_run(spark: SparkSession, folder: str, bodies: bool = True, role: str = "", prefix: str = "") -> DataFrame:
    """The rows of a stored run, of one role or below a path only; ``bodies``: with the files' contents."""
    register(spark)
    kinds = SCHEMA if bodies else SCHEMA.rsplit(", ", 1)[0]
    return spark.read.format(FORMAT).schema(kinds).option("role", role).option("prefix", prefix).load(folder)


def save_run(rows: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """Stores rows (some of the columns of ``SCHEMA``; ``role``, ``path`` and ``body`` at least) as a run, or adds them to it."""
    from pyspark.sql import functions as F

    register(rows.sparkSession)
    kinds = dict(c.split() for c in SCHEMA.split(", "))
    full = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])
    full.write.format(FORMAT).mode(mode).save(folder)


def resources_of(run: DataFrame) -> DataFrame:
    """``norm_url, path, kind, seq`` of a run's files, as look-ups need them."""
    from pyspark.sql import functions as F

    return run.select(normalize_url(F.col("url")).alias("norm_url"), "path", F.col("role").alias("kind"), F.col("ordinal").alias("seq")).where("norm_url is not null")
