"""Shared helpers: scratch tables in the shared folder, Arrow word splitting, batch slicing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: UTF-8 bytes of text that one vectorised step handles at a time (a longer document is a step of its own).
SLICE_BYTES = 4 << 20


#: Temporary folders of local applications whose session names none.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is absent, a local master gets a temporary folder; a cluster gets an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="pageloom-")
    return _OWN[context.applicationId]


def scratch_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder; it is deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/pageloom/{what}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def as_row(df: DataFrame) -> Column:
    """All columns as one struct ``row``, beside which helper columns have names of their own."""
    return F.struct(*[df[c] for c in df.columns]).alias("row")


def row_fields(df: DataFrame, **replaced: Column) -> list[Column]:
    """The columns of ``df`` out of ``row``, some replaced."""
    return [replaced[c].alias(c) if c in replaced else F.col("row").getField(c).alias(c) for c in df.columns]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


#: At most so many keys are hot, and a key of fewer rows than LEAST_HOT never is.
MAX_HOT, LEAST_HOT = 20_000, 500


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` joined with one row per key; keys of many rows (column ``size``) meet theirs by a broadcast, all others by a
    shuffle. ``total``: rows of all keys in all, or more. Give it ``groups`` that are cheap to read twice.

    A key is hot from total / MAX_HOT rows on, so there are at most MAX_HOT hot keys whatever the input, and a task of
    the shuffle gets no key with more rows than that (5 million narrow rows of 10^11). One table of the hot keys, a few
    MB if ``groups`` has a few numbers a key, serves both sides.
    """
    least = max(LEAST_HOT, total / MAX_HOT)
    others = [c for c in groups.columns if c != key]
    hot = F.broadcast(groups.where(F.col(size) >= least).select(key, F.struct(*others).alias("_hot")))
    met = rows.join(hot, key, "left")
    few = met.where("_hot is not null").select(*rows.columns, "_hot.*")
    many = met.where("_hot is null").select(*rows.columns).join(groups.where(F.col(size) < least), key).select(*rows.columns, *others)
    return few.unionByName(many)


def load_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_slices(batch: pa.RecordBatch | pa.Table, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.Table, pa.Array]]:
    """Cuts a batch into runs of rows with about ``limit`` bytes of text; nulls become empty texts."""
    table = batch if isinstance(batch, pa.Table) else pa.Table.from_batches([batch])
    text = table.column(column).combine_chunks()
    text = (text if isinstance(text, pa.Array) else text.chunk(0) if text.num_chunks else pa.array([], pa.string())).cast(pa.string())
    text = pc.fill_null(text, "")
    sizes = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)) if len(text) else np.zeros(0, np.int64)
    start = 0
    while start < len(text):
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + limit, side="right")))
        yield table.slice(start, end - start), pa.concat_arrays([text.slice(start, end - start)])
        start = end


def split_words(text: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Codes of all words in order, each row's end in them, and the distinct words that the codes stand for.

    Lower-casing touches A-Z only. Rows without words have an empty range.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(text) if lower else text)
    flat, ends = lists.flatten(), lists.offsets.to_numpy()[1:].astype(np.int64) - lists.offsets[0].as_py()
    full = pc.greater(pc.binary_length(flat), 0)
    if not pc.all(full, min_count=0).as_py():  # leading and trailing space gives empty pieces
        kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
        flat, ends = flat.filter(full), kept[ends]
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), ends, coded.dictionary


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
