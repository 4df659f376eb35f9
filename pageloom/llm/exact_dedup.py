"""Exact de-duplication against a persistent digest index.

The index is a table bucketed and sorted by the SHA-256 of the text. A batch of documents is reduced to
(doc_id, digest), grouped (partial sums first, so a hot text is one row a task), and what the index lacks is
found by a sort-merge anti-join and appended. Texts never leave the scan: only digests are shuffled.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_row, join_groups, row_fields, scratch_path, shuffle_partitions, text_or_empty, written

#: File of an index that holds its number of buckets (Spark's readers pass names with a leading underscore).
MARK = "_buckets"


class DigestIndex:
    """Digests of all texts seen so far: ``digest, keep_id, n, batch``.

    ``path`` names an existing or new index; without it a scratch index in the shared folder is used.
    ``buckets`` is fixed when the index is made (default: the shuffle partitions) and stored in it, so an index that
    is opened again has the number that its files were written with; another one is an error.
    Its name in the catalog goes with ``close`` (or the end of a ``with`` block); the files stay.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark, self.path = spark, path or scratch_path(spark, "digests")
        self.buckets = self._bucket_count(buckets)
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT, n BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION :path",
            args={"path": self.path},
        )

    def __enter__(self) -> DigestIndex:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def _bucket_count(self, wanted: int | None) -> int:
        """The stored number of buckets; of a new index the wanted one, which is stored."""
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        mark = jvm.org.apache.hadoop.fs.Path(at, MARK)
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if files.exists(mark):
            stream = files.open(mark)
            stored = stream.readInt()
            stream.close()
            if wanted and wanted != stored:
                raise ValueError(f"the index at {self.path} has {stored} buckets, not {wanted}")
            return stored
        count = wanted or shuffle_partitions(self.spark)
        if files.exists(at) and any(f.getPath().getName().endswith(".parquet") for f in files.listStatus(at)):
            # made before the number was stored: each row's bucket must be that of its file's name
            rows = self.spark.read.parquet(self.path).select(F.pmod(F.hash("digest"), F.lit(count)).alias("bucket"), F.regexp_extract(F.input_file_name(), r"_(\d+)\.c\d+", 1).cast("int").alias("of"))
            if not rows.where("not bucket <=> of").isEmpty():
                raise ValueError(f"the index at {self.path} was not made with {count} buckets")
        stream = files.create(mark, False)
        stream.writeInt(count)
        stream.close()
        return count

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, groups: DataFrame, batch: str) -> None:
        """Appends what the index lacks; one file a bucket."""
        new = groups.join(self.rows().hint("merge"), "digest", "left_anti").withColumn("batch", F.lit(batch))
        new = new.repartition(self.buckets, "digest").select("digest", "keep_id", "n", "batch")
        new.write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.table)
        self.spark.catalog.refreshTable(self.table)

    def dedup(self, documents: DataFrame, batch: str | None = None) -> DataFrame:
        """Adds a batch; one row per document of it: ``doc_id, digest, keep_id, group_size, kept, copies``.

        Null text counts as empty. Of equal texts in the batch the largest doc_id stays (a null doc_id only
        if the group has no other); a text that an earlier batch brought stays with that batch's keep_id and
        nothing of it is kept now. Rows that repeat a doc_id and its text are each returned, one of them kept.
        An empty batch gives no rows. Columns other than doc_id and text are not read.

        ``batch`` names the batch (default: a new name). A batch that is added again under its name, since a run died
        before its result was stored, gives the result of the first time: its own digests count as new, and what was
        not appended yet is. The same name with other documents is an error.
        """
        batch = batch or uuid.uuid4().hex
        rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text_or_empty().cast("binary"), 256)).alias("digest"))
        rows = written(rows.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("copies")), "digest-rows")
        # written: else the anti-join moves below the aggregation, and a hot digest's rows all meet in one task
        groups = written(rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("n")), "digest-groups")
        self.add(groups, batch)
        here = groups.select("digest", F.col("n").alias("here"), F.col("keep_id").alias("keep_here"))
        total = here.agg(F.sum("here")).first()[0] or 0
        # an index row counts its own batch; later batches add to that what they brought themselves
        found = self.rows().join(here, "digest").select("digest", "here", "keep_here", F.struct("keep_id", "n", "batch", "here").alias("found"))
        found = written(found, "digest-found")
        if not found.where((F.col("found.batch") == batch) & ~(F.col("found.keep_id").eqNullSafe(F.col("keep_here")) & (F.col("found.n") == F.col("here")))).isEmpty():
            raise ValueError(f"batch {batch} was added with other documents")
        new = F.col("found.batch") == batch
        size = F.col("here") + F.when(new, 0).otherwise(F.col("found.n"))
        narrow = found.select("digest", "here", F.col("found.keep_id").alias("keep_id"), size.cast("long").alias("group_size"), new.alias("new"))
        both = join_groups(rows, narrow, "digest", "here", total)
        return both.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
            "doc_id",
            "digest",
            "keep_id",
            "group_size",
            (F.col("new") & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
            "copies",
        )

    def survivors(self, documents: DataFrame, batch: str | None = None) -> DataFrame:
        """Adds a batch and returns the documents that stay, with all their columns."""
        keep = self.dedup(documents, batch).where("kept").select(F.col("doc_id").alias("keep_id"), F.col("digest").alias("keep_digest"), "copies")
        keep = written(keep, "digest-keep")
        found = documents.select(as_row(documents), F.col("doc_id").cast("long").alias("id"), F.unhex(F.sha2(text_or_empty().cast("binary"), 256)).alias("digest"))

        def of(those: DataFrame) -> DataFrame:
            return found.join(those, F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("digest") == F.col("keep_digest")), "left_semi")

        once = of(keep.where("copies = 1"))
        repeated = keep.where("copies > 1")
        if not repeated.isEmpty():  # repeated rows: any one of them
            once = once.unionByName(of(repeated).dropDuplicates(["id", "digest"]))
        return once.select(*row_fields(documents))


def exact_dedup(documents: DataFrame, path: str | None = None, batch: str | None = None) -> DataFrame:
    """Membership of every document after adding ``documents`` to the index at ``path`` (default: a new one)."""
    with DigestIndex(documents.sparkSession, path) as index:
        return index.dedup(documents, batch)


def survivors(documents: DataFrame, path: str | None = None, batch: str | None = None) -> DataFrame:
    """The documents that stay after adding ``documents`` to the index at ``path`` (default: a new one)."""
    with DigestIndex(documents.sparkSession, path) as index:
        return index.survivors(documents, batch)
