"""The crawl frontier: breadth-first over a link table, first come first served, with depth, scope and page budgets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.options import Options
from ..functions.robots import RuleTrie, rules_of
from ..functions.urls import Url, normalize_url, url_parts
from ..sources.scratch import written
from .scope import in_scope


FRONTIER = "url string, depth int, parent_url string, seq bigint, visited boolean"
LINKS = "src string, link_seq int, dst string"
#: A function from the pages of a level (``url, depth, parent_url, seq``, by seq) to their links (``LINKS`` and more).
Handler = Callable[[DataFrame], DataFrame]


def frontier(edges: DataFrame, seed: str, max_depth: int, max_pages: int | None = None, scope: Column | None = None) -> DataFrame:
    """J1, LIM1, FLT6, CRW2 to CRW6: ``url, depth, parent_url, seq, visited``: every address that is queued.

    ``edges``: ``src, link_seq, dst`` with normalised addresses. An address is queued once, when it is first met; order
    is by depth, then the parent's place, then the link's. The first ``max_pages`` queued are visited, and only these
    lead on; ``seq`` is their place (null for the rest). ``scope`` is a predicate on ``dst``; the seed is exempt.
    One join a level, ``max_depth`` levels; the frontier of a level is ranked only as far as the budget goes.
    """
    if scope is not None:
        edges = edges.where(scope)
    return _grown(edges.sparkSession, seed, lambda level: edges.join(level.select(F.col("url").alias("src")), "src", "left_semi"), max_depth, max_pages)


def _grown(spark: SparkSession, seed: str, links_of: Handler, max_depth: int, max_pages: int | None) -> DataFrame:
    """The frontier, level by level; ``links_of`` is asked for the links of each level's visited pages but the last's."""
    level = spark.createDataFrame([(seed, 0, None, 0, True)], FRONTIER)
    done, found, used = [level], level.select("url"), 1
    for depth in range(1, max_depth + 1):
        open_ends = level.where("visited").drop("visited")
        met = links_of(open_ends).join(open_ends.select(F.col("url").alias("src"), F.col("seq").alias("parent_seq")), "src")
        met = met.groupBy("dst").agg(F.min(F.struct("parent_seq", "link_seq", "src")).alias("first"))
        new = met.join(found.withColumnRenamed("url", "dst"), "dst", "left_anti")
        new = new.select(F.col("dst").alias("url"), F.lit(depth).alias("depth"), F.col("first.src").alias("parent_url"), "first")
        # the level's order decides who is the parent of what follows; without a budget it is taken by sorted ranges
        left = max(0, max_pages - used) if max_pages is not None else None
        if left is None:
            chosen = numbered_in_order(new.select("url", "first"), ["first", "url"], used)
        else:
            chosen = new.orderBy("first", "url").limit(left) if left else new.limit(0)
            place = F.row_number().over(Window.orderBy("first", "url")) - 1 + used  # at most max_pages rows
            chosen = F.broadcast(chosen.select("url", place.cast("bigint").alias("seq")))
        ranked = new.join(chosen, "url", "left").withColumn("visited", F.col("seq").isNotNull())
        level = ranked.select("url", "depth", "parent_url", "seq", "visited")
        level = written(level, "level")
        taken = level.where("visited").count()
        done.append(level)
        found = found.unionByName(level.select("url"))
        used += taken
        if not taken:
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


@dataclass(frozen=True)
class Explored:
    """What a crawl by handler came to: its frontier, and all rows that the handler returned, with their level (``depth``)."""

    frontier: DataFrame
    handled: DataFrame


def explore(spark: SparkSession, seed: str, handler: Handler, max_depth: int, max_pages: int | None = None, scope: Column | None = None) -> Explored:
    """UDF4, CRW5: the frontier of a site that is known only as far as ``handler`` is asked.

    ``handler`` is called once a level, with the level's visited pages, and returns a row for each link of these (with
    ``LINKS``; addresses are normalised here), or a row without ``dst`` for a page that has none; any other columns stay
    in ``handled``. Its rows are written before anything reads them, so what it does is done once. If it fails, the crawl
    fails. The last level is handled, too, but leads no further. A handler sees at most ``max_pages`` pages in all.
    """
    levels: list[DataFrame] = []

    def asked(level: DataFrame) -> DataFrame:
        rows = written(handler(level.orderBy("seq")), "handled")
        levels.append(rows.withColumn("depth", F.lit(len(levels))))
        links = rows.where("dst is not null").select(normalize_url(F.col("src")).alias("src"), "link_seq", normalize_url(F.col("dst")).alias("dst"))
        return links if scope is None else links.where(scope)

    start = Url(seed).normalized()
    found = _grown(spark, start, asked, max_depth, max_pages)
    last = found.where(F.col("visited") & (F.col("depth") == max_depth)).drop("visited")
    if len(levels) == max_depth and not last.isEmpty():
        asked(last)
    handled = levels[0]
    for rows in levels[1:]:
        handled = handled.unionByName(rows)
    return Explored(found, handled)


def numbered_in_order(rows: DataFrame, order: list[str], start: int) -> DataFrame:
    """``url, seq``: places from ``start`` on in an order, by ranges: places inside a range, after the rows of those before."""
    ranged = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(F.broadcast(before), "_part").select("url", (F.col("_before") + inside - 1 + start).cast("bigint").alias("seq"))


def crawl(links: DataFrame, options: Options) -> DataFrame:
    """The frontier of captured links (``url, link_seq, normalized``) under a run's options."""
    seed = Url(options.url).normalized()
    edges = links.select(normalize_url(F.col("url")).alias("src"), "link_seq", F.col("normalized").alias("dst"))
    depth = options.max_depth if options.subpages else 0
    return frontier(edges, seed, depth, options.max_pages, in_scope(F.col("dst"), options))


@dataclass(frozen=True)
class Gauges:
    """CRW4."""

    discovered: int
    visited: int
    pending: int


def gauges(front: DataFrame) -> Gauges:
    row = front.agg(F.count(F.lit(1)).alias("n"), F.count_if("visited").alias("v")).first()
    return Gauges(row.n, row.v, row.n - row.v)


def start_times(arrivals: DataFrame, delay_ms: int) -> DataFrame:
    """WIN4: ``seq, arrival_ms, start_ms``: starts at least ``delay_ms`` apart, none before its arrival, in order of seq.

    start_i = max over j <= i of arrival_j + (i - j) * delay: a running maximum of what arrivals are ahead of an even pace.
    It is taken inside ranges of seq, and over one row a range.
    """
    ranged = written(arrivals.select("seq", "arrival_ms").repartitionByRange("seq").withColumn("_part", F.spark_partition_id()), "arrivals")
    order = Window.partitionBy("_part").orderBy("seq")
    rows = ranged.withColumn("_i", F.row_number().over(order).cast("long")).withColumn("_ahead", F.col("arrival_ms") - F.col("_i") * delay_ms)
    rows = rows.withColumn("_most", F.max("_ahead").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = rows.groupBy("_part").agg(F.max("_ahead").alias("_top"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    parts = parts.withColumn("_ahead_before", F.max(F.col("_top") - F.col("_before") * delay_ms).over(earlier)).drop("_top", "_n")
    most = F.greatest(F.col("_ahead_before"), F.col("_most") - F.col("_before") * delay_ms)  # nulls are passed over
    start = most + (F.col("_before") + F.col("_i")) * delay_ms
    return rows.join(F.broadcast(parts), "_part").select("seq", "arrival_ms", start.cast("long").alias("start_ms"))


def robots_rules(robots: DataFrame) -> DataFrame:
    """``origin, agent, allow, pattern``: rules of robots files (``origin, robots_txt``), one row each."""

    def read(batches):
        for rows in batches:
            out = [(site, *rule) for site, text in rows.itertuples(index=False) for rule in rules_of(text or "")]
            yield pd.DataFrame(out, columns=["origin", "agent", "allow", "pattern"])

    return robots.select("origin", "robots_txt").mapInPandas(read, "origin string, agent string, allow boolean, pattern string")


#: Parts that the addresses of one origin are dealt to; its rules go to each.
ROBOTS_PARTS = 64


def robots_filter(pages: DataFrame, robots: DataFrame, user_agent: str) -> DataFrame:
    """FLT7, J6: ``pages`` with ``allowed``: by the longest rule that matches path and query, allowing on a tie.

    Rules of the group that names the agent hold, else those for ``*``; no rule, no robots file: allowed. Distinct
    addresses stand sorted behind the rules of their origin, and a task compiles these once and streams over the
    addresses; an origin's addresses are dealt to ``ROBOTS_PARTS`` parts. No row is made for a pair of address and rule.
    """
    agent = user_agent.split("/")[0].strip().lower()
    rules = robots_rules(robots).where(F.col("agent").isin(agent, "*")).distinct()
    of = rules.groupBy("origin").agg(*[F.collect_list(F.when(F.col("agent") == a, F.struct("pattern", "allow"))).alias(n) for a, n in ((agent, "own"), ("*", "all"))])
    of = of.select("origin", F.when(F.size("own") > 0, F.col("own")).otherwise(F.col("all")).alias("rules"))
    of = of.select("origin", F.explode(F.sequence(F.lit(0), F.lit(ROBOTS_PARTS - 1))).alias("part"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("path"), "rules")
    p = url_parts(F.col("url"))
    site = F.concat(p.scheme, F.lit("://"), p.host, F.when(p.port != "", F.concat(F.lit(":"), p.port)).otherwise(""))
    asked = pages.select("url").distinct().select(site.alias("origin"), F.pmod(F.xxhash64("url"), F.lit(ROBOTS_PARTS)).cast("int").alias("part"), "url", F.concat(p.path, p.search).alias("path"))
    both = of.unionByName(asked.where("path is not null").withColumn("rules", F.lit(None).cast("array<struct<pattern:string,allow:boolean>>")))
    both = both.repartition("origin", "part").sortWithinPartitions("origin", "part", F.col("url").isNotNull())

    def forbidden(batches):
        at, trie = None, None
        for rows in batches:
            out = []
            for origin, part, url, path, found in rows.itertuples(index=False):
                if found is not None:
                    at, trie = (origin, part), RuleTrie((r["pattern"], r["allow"]) for r in found)
                elif (origin, part) == at and not trie.allows(path):
                    out.append(url)
            yield pd.DataFrame({"url": out}, dtype=object)

    no = both.mapInPandas(forbidden, "url string").withColumn("_no", F.lit(True))
    return pages.join(no, "url", "left").withColumn("allowed", F.col("_no").isNull()).select(*pages.columns, "allowed")
