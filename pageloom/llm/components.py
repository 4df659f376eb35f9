"""Connected components of a link table, without collecting it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Up to so many distinct edges (of 16 bytes) are solved by one task; more in rounds over the whole cluster.
ONE_TASK = 200_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", one_task: int | None = None) -> DataFrame:
    """``node, component``: for every node of an edge the smallest node that it reaches.

    Each round hooks every component to the smallest that one of its edges meets (a partial minimum, so a node with
    many edges is no hot group), follows the hooks to their ends by doubling, and contracts the edges. Components
    shrink at least by half a round; each round is a written table, so lost executors cost no more than their tasks.
    What is counted to be at most ``one_task`` edges (at first, or after some rounds) is solved in one task.
    """
    least = ONE_TASK if one_task is None else one_task
    left = written(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct(), "edges")
    labels = None
    while (count := left.count()) > least:
        if labels is None:
            nodes = left.select(F.col("hi").alias("node")).union(left.select("lo")).distinct()
            labels = nodes.withColumn("component", F.col("node"))
        hooks = written(left.groupBy("hi").agg(F.min("lo").alias("lo")), "hooks")
        while True:
            on = hooks.select(F.col("hi").alias("lo"), F.col("lo").alias("further"))
            step = written(hooks.join(on, "lo", "left").select("hi", F.coalesce("further", "lo").alias("lo"), F.col("further").isNotNull().alias("moved")), "hooks")
            hooks = step.select("hi", "lo")
            if step.where("moved").isEmpty():
                break
        labels = written(renamed(labels, "component", hooks), "component-labels")
        left = renamed(renamed(left, "hi", hooks), "lo", hooks).where("hi <> lo")
        left = written(left.select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct(), "edges")
    rest = left.coalesce(1).mapInArrow(solved, "hi bigint, lo bigint")
    if labels is None:
        return rest.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return (renamed(labels, "component", written(rest, "hooks")) if count else labels).select("node", "component")


def renamed(df: DataFrame, column: str, to: DataFrame) -> DataFrame:
    """``df`` with the values ``hi`` of a column replaced by their ``lo``."""
    return df.join(to.select(F.col("hi").alias(column), F.col("lo").alias("_to")), column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")


def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges ``hi, lo`` of a bounded table to nodes and their components."""
    parts = [(batch.column("hi").to_numpy(), batch.column("lo").to_numpy()) for batch in batches]
    if not parts:
        return
    hi, lo = (np.concatenate([p[k] for p in parts]) for k in range(2))
    nodes, places = np.unique(np.concatenate([hi, lo]), return_inverse=True)
    x, y = places[: len(hi)], places[len(hi) :]
    root = np.arange(len(nodes))
    while True:  # places ascend with nodes: the smallest place wins
        least = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, before[x], least)
        np.minimum.at(root, before[y], least)
        while (root != root[root]).any():
            root = root[root]
        if (root == before).all():
            break
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["hi", "lo"])
