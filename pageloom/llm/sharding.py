"""Shard placement by a permutation-filled lookup table.

Every shard has its own preference order over the slots of a table of prime size (an offset and a stride
modulo the prime visit every slot). Shards take turns, each claiming its next free preferred slot, until the
table is full; so shares differ by one slot at most, and a changed set of shards moves few slots. The table
has a fixed size (default 65537 slots), is broadcast (a hash table of slots) and read in constant time for a row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE_SIZE = 65537


def is_prime(n: int) -> bool:
    return n >= 2 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: list[str], size: int = TABLE_SIZE, turns: dict[str, int] | None = None) -> np.ndarray:
    """The table: slot -> place of its shard in ``shards``.

    ``turns`` gives a shard more claims a round (default 1). Needs a prime ``size`` of at least the number of
    shards, and distinct names.
    """
    if not shards or len(set(shards)) < len(shards) or not is_prime(size) or size < len(shards):
        raise ValueError("distinct shards and a prime table size of at least their number are needed")
    seeds = [hashlib.sha256(s.encode()).digest() for s in shards]
    at = [int.from_bytes(s[:8], "big") % size for s in seeds]
    step = [1 + int.from_bytes(s[8:16], "big") % (size - 1) if size > 2 else 1 for s in seeds]
    table, left = np.full(size, -1, np.int32), size
    order = sorted(range(len(shards)), key=lambda i: shards[i])  # turns don't depend on the list's order
    while left:
        for i in order:
            for _ in range((turns or {}).get(shards[i], 1)):
                if not left:
                    break
                while table[at[i]] >= 0:
                    at[i] = (at[i] + step[i]) % size
                table[at[i]] = i
                left -= 1
    return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a key: the first 60 bits of its MD5, modulo the table's size."""
    return (F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 15), 16, 10).cast("long") % size).cast("int")


def place(documents: DataFrame, shards: list[str], key: str = "doc_id", size: int = TABLE_SIZE, turns: dict[str, int] | None = None) -> DataFrame:
    """``documents`` with ``slot`` and ``shard`` (columns of these names are replaced).

    Equal keys share a shard, repeated rows too. A null key is placed by a hash of the text (null: empty), so
    null keys don't meet in one shard. An empty table gives no rows. No shuffle: placement is a projection.
    """
    spark = documents.sparkSession
    filled = fill_table(shards, size, turns)
    table = spark.createDataFrame(pd.DataFrame({"slot": np.arange(size, dtype=np.int32), "shard": np.array(shards, dtype=object)[filled]}), "slot int, shard string")
    hashed = F.col(key).cast("string")
    text = F.coalesce(F.col("text"), F.lit("")) if "text" in documents.columns else F.lit("")
    hashed = F.coalesce(hashed, F.concat(F.lit("null:"), F.xxhash64(text).cast("string")))
    others = [c for c in documents.columns if c.lower() not in ("slot", "shard")]
    left = documents.select(*others, slot_of(hashed, size).alias("slot"))
    # size is fixed and independent of the documents, so the broadcast is bounded
    return left.join(F.broadcast(table), "slot").select(*others, "slot", "shard")
