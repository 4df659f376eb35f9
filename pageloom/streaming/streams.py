"""Streaming counterparts: links as they are found, running token counts, and the event log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from ..functions import css_tokens as T
from ..operators.crawl import FRONTIER, numbered_in_order
from ..sources.scratch import written

#: Name of the metrics that a query reports.
COUNTERS = "pageloom_counters"
EVENT = "timestamp timestamp, type string, payload string"


def distinct_links(links: DataFrame, watermark: str | None = None, event_time: str = "timestamp") -> DataFrame:
    """STR2: each normalised address once. Without a watermark the state keeps every address, as a crawl does; with one,
    addresses are forgotten after that time."""
    if watermark:
        return links.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(["normalized"])
    return links.dropDuplicates(["normalized"])


def running_tokens(declarations: DataFrame, strict: bool = False) -> DataFrame:
    """STR3: counts by category and key of a stream of declarations (``prop, value``); for update or complete mode."""
    tokens = declarations.select(F.explode(T.declaration_tokens(F.col("prop"), F.col("value"), strict)).alias("t"))
    return tokens.groupBy("t.category", "t.key").agg(F.count(F.lit(1)).alias("n"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """STR4: an event log of JSON lines as a stream; further fields stay in ``payload``."""
    lines = spark.readStream.text(path)
    return lines.select(F.from_json("value", "timestamp timestamp, type string").alias("e"), F.col("value").alias("payload")).select("e.*", "payload")


def append_events(events: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """STR4: the writer that appends a stream of events as JSON lines."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def progress_by_minute(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """STR5: events by type and minute; later ones than ``lateness`` are dropped."""
    return events.withWatermark("timestamp", lateness).groupBy(F.window("timestamp", "1 minute"), "type").agg(F.count(F.lit(1)).alias("n"))


class Counters(StreamingQueryListener):
    """STR5, SNK10: the counts of ``with_counters``, summed over the batches of running queries as these end; a batch that
    is repeated after a restart counts once."""

    def __init__(self) -> None:
        self.batches: dict[tuple[str, int], dict[str, int]] = {}

    @property
    def counts(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for batch in list(self.batches.values()):
            for name, n in batch.items():
                out[name] = out.get(name, 0) + n
        return out

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        found = event.progress.observedMetrics.get(COUNTERS)
        if found is not None:
            self.batches[str(event.progress.id), event.progress.batchId] = found.asDict()

    def onQueryTerminated(self, event) -> None:
        pass


def with_counters(rows: DataFrame, **which: Column) -> DataFrame:
    """``rows``, of which a running query counts those that each predicate names (``ok=..., failed=..., queued=...``)."""
    return rows.observe(COUNTERS, *[F.count_if(c).alias(name) for name, c in which.items()])


#: Links of visited pages as a stream: the page with its depth and place in the frontier, and where the link leads.
LINK_EVENTS = "src string, depth int, seq bigint, link_seq int, dst string"
MET = "depth int, parent_url string, parent_seq bigint, link_seq int"


class FirstMet(StatefulProcessor):
    """Keeps for each address how it was first met, and returns it once: the least by depth, then by the page's place and
    the link's among the rows that come together. With ``keep_ms`` an address is forgotten after that time."""

    def __init__(self, seed: str, keep_ms: int | None = None):
        self.seed, self.keep_ms = seed, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.met = handle.getValueState("met", MET, ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0] == self.seed or self.met.exists():
            return
        best = min((int(r.depth), int(r.seq), int(r.link_seq), r.src) for part in rows for r in part.itertuples())
        depth, seq, link_seq, src = best
        self.met.update((depth + 1, src, seq, link_seq))
        yield pd.DataFrame({"url": [key[0]], "depth": [depth + 1], "parent_url": [src], "parent_seq": [seq], "link_seq": [link_seq]})

    def close(self) -> None:
        pass


def new_addresses(links: DataFrame, seed: str, keep_ms: int | None = None) -> DataFrame:
    """STR1, STR2: each address once, as it is first met (``url`` and ``MET``), from a stream of ``LINK_EVENTS`` with
    normalised addresses. State is kept by address, so it is spread as the addresses are."""
    return links.where("dst is not null").groupBy("dst").transformWithStateInPandas(FirstMet(seed, keep_ms), f"url string, {MET}", "append", "ProcessingTime" if keep_ms else "None")


def start_frontier(spark: SparkSession, path: str, seed: str) -> None:
    """The table of a streamed frontier, which holds the seed only."""
    spark.createDataFrame([(seed, 0, None, 0, True)], FRONTIER).write.mode("overwrite").parquet(f"{path}/batch=-1")


def read_frontier(spark: SparkSession, path: str) -> DataFrame:
    """The frontier so far, with the batch that brought each address (-1: the seed's)."""
    return spark.read.schema(f"{FRONTIER}, batch bigint").parquet(path)


def grow_frontier(links: DataFrame, seed: str, path: str, checkpoint: str, max_pages: int | None = None, keep_ms: int | None = None) -> DataStreamWriter:
    """STR1, CRW2: the frontier of a stream of ``LINK_EVENTS``, appended to the table at ``path`` (``start_frontier``).

    Every batch's new addresses are numbered in order behind those before; from ``max_pages`` on they are queued only.
    A batch has a folder of its own, which a repeated batch overwrites, so a run that died and starts again from its
    checkpoint brings nothing twice. Links of a level should come before those of the next, as they do if pages are
    visited by their place; the result is then that of ``crawl.frontier``. Needs the RocksDB state store.
    """

    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = written(batch, "met")
        used = read_frontier(spark, path).where((F.col("batch") < number) & F.col("visited")).count()
        placed = numbered_in_order(new, ["depth", "parent_seq", "link_seq", "url"], used)
        rows = new.join(placed, "url")
        inside = F.lit(True) if max_pages is None else F.col("seq") < max_pages
        rows = rows.select("url", "depth", "parent_url", F.when(inside, F.col("seq")).alias("seq"), inside.alias("visited"))
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return new_addresses(links, seed, keep_ms).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).outputMode("append")


def with_rocksdb(spark: SparkSession) -> None:
    """Sets the state store that state by key needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def crawl_stream(edges: DataFrame, seed: str, folder: str, max_depth: int, max_pages: int | None = None) -> DataFrame:
    """STR1: a crawl of a link table (``src, link_seq, dst``) by way of streams: the links of each batch of visited pages are
    appended to a folder, from which the frontier's stream grows; each batch starts the stream anew from its checkpoint."""
    spark = edges.sparkSession
    with_rocksdb(spark)
    table, events = f"{folder}/frontier", f"{folder}/links"
    start_frontier(spark, table, seed)
    for depth in range(max_depth):
        level = read_frontier(spark, table).where((F.col("depth") == depth) & F.col("visited")).select(F.col("url").alias("src"), "depth", "seq")
        edges.join(level, "src").select("src", "depth", "seq", F.col("link_seq").cast("int").alias("link_seq"), "dst").write.mode("append").parquet(events)
        links = spark.readStream.schema(LINK_EVENTS).parquet(events)
        query = grow_frontier(links, seed, table, f"{folder}/checkpoint", max_pages).trigger(availableNow=True).start()
        query.awaitTermination()
    return read_frontier(spark, table).drop("batch")
