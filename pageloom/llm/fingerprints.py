"""Document fingerprints: one-permutation MinHash with optimal densification, in DataFrame expressions only.

Each shingle (five words; fewer words are one shingle) is hashed once. The hash's leading 8 bits are its bin, the least
hash of a bin its value. An empty bin borrows the value of a bin that is not, probing bins in an order that is fixed for
each bin and independent of the document. Of each value the low 4 bits are kept; likeness corrects for their chance
matches. A fingerprint is 256 four-bit values: 16 longs, or 256 hex digits.

All of it happens inside a row, without a shuffle. A sentinel for each bin, larger than any of its values, is sorted in
with the hashes, so that the first of each bin is either its value or tells that it is empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions

WORDS, BINS, BITS = 5, 256, 4
#: Largest value of a bin: the sentinel.
NONE = (1 << 56) - 1
#: Probes are tried in tiers that start here (the first at 0).
TIERS = (4, 16, 64)
#: Range buckets for each shuffle partition.
SPREAD = 8


def _probes(name: str) -> list[int]:
    """A start (any bin) or stride (odd, so that all bins are visited) for each bin."""
    numbers = (hashlib.sha256(f"{name}:{b}".encode()).digest()[0] for b in range(BINS))
    return [n | (name == "stride") for n in numbers]


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` reads it."""
    return F.transform(F.array(value), then)[0]


def shingle_hashes(text: Column) -> Column:
    """Hashes of all shingles of a text (not null); an empty array without words."""

    def of(trimmed: Column) -> Column:
        shingles = bound(F.split(trimmed, r"[\x20\x09-\x0D]+"), lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - (WORDS - 1))), lambda i: F.xxhash64(F.slice(w, i, WORDS))))
        return F.when(trimmed == "", F.array().cast("array<bigint>")).otherwise(shingles)

    return bound(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), of)


def least_of_bins(hashes: Column) -> Column:
    """The first of each bin in order: its value, or its sentinel."""
    sentinels = F.array(*(F.lit((b << 56) | NONE) for b in range(-BINS // 2, BINS // 2)))
    ordered = F.sort_array(F.concat(hashes, sentinels))
    return bound(ordered, lambda s: F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, 56) != F.shiftright(F.get(s, F.greatest(i - 1, F.lit(0))), 56))))


def is_value(x: Column) -> Column:
    return x.bitwiseAND(F.lit(NONE)) != NONE


def densified(bins: Column) -> Column:
    """Bins with the empty ones filled (not for documents without any value)."""

    start, stride = _probes("start"), _probes("stride")
    few = F.array(*(F.array(*(F.lit((s + t * d) % BINS) for t in range(TIERS[0]))) for s, d in zip(start, stride, strict=True)))
    starts, strides = F.array(*map(F.lit, start)), F.array(*map(F.lit, stride))

    def borrowed(b: Column) -> Column:
        """The first probed value. Probes go in tiers: a bin of a document with many values seldom needs the second."""

        def later(steps: range) -> Column:
            def place(t: Column) -> Column:
                return (F.get(starts, b) + t * F.get(strides, b)).bitwiseAND(F.lit(BINS - 1))

            step = F.get(F.filter(F.array(*map(F.lit, steps)), lambda t: is_value(F.get(bins, place(t)))), F.lit(0))
            return F.get(bins, place(step))

        first = F.get(bins, F.get(F.filter(F.get(few, b), lambda p: is_value(F.get(bins, p))), F.lit(0)))
        return F.coalesce(first, *(later(range(i, j)) for i, j in zip(TIERS, [*TIERS[1:], BINS], strict=True)))

    return F.transform(bins, lambda x, b: F.when(is_value(x), x).otherwise(borrowed(b)))


def packed(values: Column) -> Column:
    """16 longs of ``BITS`` bits for each bin: bits of its value hashed with the bin's place, so that two documents whose
    few values differ don't match by chance in all bins that borrowed them."""
    bits = F.transform(values, lambda x, i: F.xxhash64(x, i).bitwiseAND(F.lit((1 << BITS) - 1)))
    return bound(bits, lambda v: F.transform(F.sequence(F.lit(0), F.lit(BINS // 16 - 1)), lambda k: F.aggregate(F.slice(v, k * 16 + 1, 16), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, BITS).bitwiseOR(x))))


def fingerprint(text: Column) -> Column:
    """The packed fingerprint of a text (null: as empty), an empty array without words."""
    none = F.array().cast("array<bigint>")
    return bound(least_of_bins(shingle_hashes(F.coalesce(text, F.lit("")))), lambda bins: F.when(F.exists(bins, is_value), bound(densified(bins), packed)).otherwise(none))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two packed fingerprints: 1 for equal ones, 0 if one alone is empty."""
    spread = F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))
    # a nibble that differs leaves one bit
    ones = 0x1111111111111111
    differ = F.aggregate(spread, F.lit(0), lambda n, y: n + F.bit_count((y.bitwiseOR(F.shiftright(y, 1)).bitwiseOR(F.shiftright(y, 2)).bitwiseOR(F.shiftright(y, 3))).bitwiseAND(F.lit(ones))))
    chance = 1.0 / (1 << BITS)
    corrected = F.greatest(F.lit(0.0), (1 - differ / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when(a == b, F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(corrected)


def as_string(name: str) -> Column:
    """256 hex digits, or the empty string."""
    return F.array_join(F.transform(name, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def range_bucket(df: DataFrame, key: str, buckets: int) -> Column:
    """Column: place of ``key`` among about ``buckets`` ranges with as many rows each; null keys have -1.

    The bounds are quantiles of a scan of the key alone, as many as there are buckets. They are looked up in two
    steps, so a row costs about twice the root of their number.
    """
    parts = [i / buckets for i in range(1, buckets)]
    bounds = (df.agg(F.percentile_approx(key, parts, max(10_000, 20 * buckets))).first()[0] if parts else None) or []
    bounds = sorted(set(bounds))
    step = max(1, int(len(bounds) ** 0.5))
    chunks = [bounds[i : i + step] for i in range(0, len(bounds), step)] or [[]]
    heads = ",".join(f"{c[-1]}L" for c in chunks[:-1])
    arrays = ",".join("array(" + ",".join(f"{x}L" for x in c) + ")" for c in chunks) if bounds else "cast(array() as array<bigint>)"
    coarse = f"size(filter(array({heads}), x -> x < {key}))" if heads else "0"
    return F.expr(f"coalesce(transform(array({coarse}), c -> c * {step} + size(filter(get(array({arrays}), c), x -> x < {key})))[0] + 0 * sign({key}), -1)").cast("int")


def with_next(df: DataFrame, key: str, carried: list[str], tie: str) -> DataFrame:
    """Adds ``next_<c>`` for each carried column: its value in the next row by descending ``key`` (nulls last, equal keys
    by descending ``tie``); after the last row comes the first.

    Rows are dealt by range buckets of the key. The head of each bucket is also copied to the end of the bucket before
    it, so one window inside the buckets does.
    """
    buckets = SPREAD * shuffle_partitions(df.sparkSession)
    df = df.withColumn("_bucket", range_bucket(df, key, buckets)).withColumn("_copy", F.lit(0))
    # one row a bucket
    heads = df.groupBy("_bucket").agg(F.max(key).alias("_head"))
    order = Window.orderBy("_bucket")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("_bucket", "_head", F.coalesce(F.lead("_bucket").over(order), F.min("_bucket").over(whole)).alias("_before"))
    heads = F.broadcast(heads.withColumnRenamed("_bucket", "_of"))
    copies = df.join(heads, (F.col("_bucket") == F.col("_of")) & F.col(key).eqNullSafe(F.col("_head")))
    copies = copies.withColumn("_bucket", F.col("_before")).withColumn("_copy", F.lit(1)).select(*df.columns)
    along = Window.partitionBy("_bucket").orderBy("_copy", F.col(key).desc_nulls_last(), F.col(tie).desc_nulls_last())
    both = df.unionByName(copies)
    return both.select("*", *[F.lead(c).over(along).alias(f"next_{c}") for c in carried]).where("_copy = 0").drop("_bucket", "_copy")


def fingerprints(documents: DataFrame) -> DataFrame:
    """``doc_id, text, fingerprint`` (packed) of every document, whole texts; repeated rows are kept. Nothing is shuffled."""
    rows = documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.withColumn("fingerprint", fingerprint(F.col("text")))


def edited_report(documents: DataFrame) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and their likenesses.

    The edited text ends in the first floor(n_chars / 3) code points (or all) of the next document, by descending
    doc_id, in place of its own last as many. A null text is empty; an only document is its own next; an empty table
    gives no rows; equal doc_ids follow by descending text.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    keyed = with_next(rows.withColumn("fingerprint", fingerprint(F.col("text"))), "doc_id", ["text", "fingerprint"], "text")
    n, third = F.char_length("text"), F.floor(F.char_length("text") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    found = keyed.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    found = found.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_string("fingerprint").alias("fingerprint"),
        as_string("edited_fingerprint").alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
