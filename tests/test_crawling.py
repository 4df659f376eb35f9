"""Crawls that know a site only as they go: by a handler, and by streams with state."""

import random
import time

import pytest
from pyspark.sql import functions as F

from pageloom.operators import crawl
from pageloom.streaming import streams

SEED = "https://a.example/0"
EDGES = "src string, link_seq int, dst string"


@pytest.fixture(scope="module")
def edges(spark):
    rng = random.Random(5)
    page = lambda k: f"https://a.example/{k}"
    rows = [(page(k), i, page(rng.choice([k, 0, rng.randrange(60), rng.randrange(60)]))) for k in range(50) for i in range(rng.randint(0, 4))]
    return spark.createDataFrame(rows, EDGES)


def plain_frontier(edges, max_depth, max_pages):
    """First in, first out, one page at a time."""
    links = {}
    for src, seq, dst in sorted(tuple(r) for r in edges.collect()):
        links.setdefault(src, []).append(dst)
    queue, out, at = [(SEED, 0, None)], [], 0
    while at < len(queue):
        url, depth, parent = queue[at]
        visited = max_pages is None or at < max_pages
        out.append((url, depth, parent, at if visited else None, visited))
        if visited and depth < max_depth:
            queue += [(d, depth + 1, url) for d in dict.fromkeys(links.get(url, [])) if d not in {q[0] for q in queue}]
        at += 1
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("url", "depth", "parent_url", "seq", "visited").collect())


@pytest.mark.parametrize(("max_depth", "max_pages"), [(4, None), (3, 9), (0, None), (5, 1)])
def test_handler_is_asked_for_visited_pages_only(spark, edges, tmp_path, max_depth, max_pages):
    asked = []

    def handler(level):
        pages = [r.url for r in level.collect()]
        asked.append(pages)
        # what isn't asked for isn't known; addresses come as written
        own = edges.where(F.col("src").isin(pages)).withColumn("dst", F.concat("dst", F.lit("/#top"))).withColumn("status", F.lit(200))
        return level.select(F.col("url").alias("src")).join(own, "src", "left")

    made = crawl.explore(spark, SEED, handler, max_depth, max_pages)
    wanted = plain_frontier(edges, max_depth, max_pages)
    assert rows_of(made.frontier) == wanted == rows_of(crawl.frontier(edges, SEED, max_depth, max_pages))
    in_order = [r[0] for r in sorted((r for r in wanted if r[4]), key=lambda r: r[3])]
    assert [p for level in asked for p in level] == in_order  # each once, by its place
    before = len(asked)
    handled = made.handled.collect()
    assert len(asked) == before and {r.src for r in handled} == set(in_order)  # rows are stored: nobody is asked again
    assert all(asked[r.depth].count(r.src) == 1 for r in handled)


def test_scope_of_a_handler(spark, edges):
    inside = ~F.col("dst").endswith("7")
    handler = lambda level: edges.join(level.select(F.col("url").alias("src")), "src")
    assert rows_of(crawl.explore(spark, SEED, handler, 4, 20, inside).frontier) == rows_of(crawl.frontier(edges, SEED, 4, 20, inside))


def test_failing_handler_fails_the_crawl(spark, edges):
    calls = []

    def handler(level):
        calls.append(level.count())
        if len(calls) == 2:
            raise OSError("no answer")
        return edges.join(level.select(F.col("url").alias("src")), "src")

    with pytest.raises(OSError, match="no answer"):
        crawl.explore(spark, SEED, handler, 4)
    assert len(calls) == 2

    def late(level):
        return edges.join(level.select(F.col("url").alias("src")), "src").withColumn("x", F.expr("raise_error('lost page')"))

    with pytest.raises(Exception, match="lost page"):
        crawl.explore(spark, SEED, late, 4)


@pytest.mark.parametrize("max_pages", [None, 12])
def test_stream_grows_the_same_frontier(spark, edges, tmp_path, max_pages):
    found = streams.crawl_stream(edges, SEED, f"file://{tmp_path}/crawl", 4, max_pages)
    assert rows_of(found) == plain_frontier(edges, 4, max_pages)


def test_stream_restarts_and_repeats_bring_nothing_twice(spark, tmp_path):
    streams.with_rocksdb(spark)
    table, links, seen = f"file://{tmp_path}/t", f"file://{tmp_path}/links", lambda: sorted(tuple(r) for r in streams.read_frontier(spark, table).drop("batch").collect())

    def batch(*rows):
        spark.createDataFrame(rows, streams.LINK_EVENTS).coalesce(1).write.mode("append").parquet(links)

    def run():
        source = spark.readStream.schema(streams.LINK_EVENTS).parquet(links)
        streams.grow_frontier(source, "s", table, f"file://{tmp_path}/c", 4).trigger(availableNow=True).start().awaitTermination()

    streams.start_frontier(spark, table, "s")
    batch(("s", 0, 0, 1, "b"), ("s", 0, 0, 0, "a"), ("s", 0, 0, 2, "a"), ("s", 0, 0, 3, "s"), ("s", 0, 0, 4, None))
    run()
    first = [("a", 1, "s", 1, True), ("b", 1, "s", 2, True), ("s", 0, None, 0, True)]
    assert seen() == first
    run()  # nothing new
    assert seen() == first
    batch(("b", 1, 2, 0, "c"), ("a", 1, 1, 5, "c"), ("a", 1, 1, 6, "d"), ("a", 1, 1, 7, "b"))
    run()
    grown = sorted([*first, ("c", 2, "a", 3, True), ("d", 2, "a", None, False)])
    assert seen() == grown
    # the last batch is taken again after a crash before its commit
    commits = sorted((tmp_path / "c" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    run()
    assert seen() == grown


def test_addresses_are_forgotten_in_time(spark, tmp_path):
    streams.with_rocksdb(spark)
    links, out = f"file://{tmp_path}/links", tmp_path / "out"
    row = spark.createDataFrame([("s", 0, 0, 0, "a")], streams.LINK_EVENTS)
    row.write.parquet(links)
    source = spark.readStream.schema(streams.LINK_EVENTS).parquet(links)
    found = streams.new_addresses(source, "s", 1).writeStream.format("json").option("path", f"file://{out}").option("checkpointLocation", f"file://{tmp_path}/c").start()
    try:
        for times in (1, 2):  # such a stream never comes to rest, as it looks for what has expired
            until = time.time() + 60
            while sum(len(f.read_text().splitlines()) for f in out.glob("part-*.json")) < times and time.time() < until:
                time.sleep(0.5)
            assert sum(len(f.read_text().splitlines()) for f in out.glob("part-*.json")) == times
            row.write.mode("append").parquet(links)
    finally:
        found.stop()


def test_counters_of_a_running_query(spark, tmp_path):
    kinds = ["page-saved"] * 5 + ["page-error"] * 2 + ["page-start"] * 9
    spark.createDataFrame([(k, f"u{i}") for i, k in enumerate(kinds)], "type string, url string").repartition(3).write.json(f"{tmp_path}/in")
    kind = F.col("type")
    rows = streams.with_counters(spark.readStream.schema("type string, url string").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in"), ok=kind == "page-saved", failed=kind == "page-error", queued=kind == "page-start")
    counters = streams.Counters()
    spark.streams.addListener(counters)
    try:
        rows.writeStream.format("json").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(60)
        until = time.time() + 20
        while sum(counters.counts.values()) < 16 and time.time() < until:
            time.sleep(0.2)  # events come a little later
    finally:
        spark.streams.removeListener(counters)
    assert counters.counts == {"ok": 5, "failed": 2, "queued": 9} and len(counters.batches) > 1
