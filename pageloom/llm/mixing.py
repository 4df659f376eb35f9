"""Mixing sources to target weights along a time-varying curriculum.

Sources get targets (words of the mix) by weight, none above ``cap`` times its own size. Each source's rate is a
schedule over training time t in [0, 1]; its integral, scaled to the target, is the source's cumulative demand.
Documents of a source stand in a fixed pseudo-random order, each copy covering a stretch of that demand; inverting
the demand at the start of the stretch gives the copy's training position. Rows are range-sorted by position.

Running sums are taken in two steps (sums by source and leading hash digits, then inside such a group), so a source
with a third of all rows is spread over as many groups as the whole input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, as_row, row_fields, text_or_empty, written

#: Weights by a source's place in code-point order, repeated; and for each the rate at t = 1 less that at t = 0
#: as a part of the mean rate: heavy sources fade, light ones grow.
WEIGHTS = (5, 2, 1)
SLOPES = (-0.5, 0.0, 0.5)
SHARE, CAP = 1.5, 2


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def demand_at(t: Column, slope: Column) -> Column:
    """Integral of the rate 1 + slope * (t - 1/2) from 0 to t: the part of the target that is due by time t."""
    return t + slope / 2 * (t * t - t)


def time_of(part: Column, slope: Column) -> Column:
    """The inverse of ``demand_at``: when a part of the target is due (slope in [-2, 2])."""
    b = 1 - slope / 2
    root = F.sqrt(F.greatest(F.lit(0.0), b * b + 2 * slope * part))
    return F.least(F.lit(1.0), 2 * part / (b + root))


def source_targets(sizes: DataFrame, weights=WEIGHTS, slopes=SLOPES, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``source, source_size`` to targets; one row a source, which streams through one task and is not collected.

    Sources stand in code-point order, null last. The targets are least(cap * size, level * weight) with the one
    level at which they sum up to ``share`` of all sizes - where resharing the excess ends. A source of size 0 gets 0.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights) + 1
    of = sizes.withColumn("place", place).withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), F.col("place").cast("int"))).withColumn("slope", F.element_at(F.array(*map(F.lit, map(float, slopes))), F.col("place").cast("int")))
    limit = cap * F.col("source_size")
    order = Window.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wanted = share * F.sum("source_size").over(everything)
    of = of.withColumn("level", (wanted - F.coalesce(F.sum(limit).over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # a source is capped as long as the level that its turn finds would exceed its limit
    free = F.when(F.col("level") * F.col("weight") <= limit, F.col("level"))
    of = of.withColumn("level", F.coalesce(F.max(free).over(everything), F.lit(float("inf"))))
    return of.select("source", "source_size", "weight", "slope", F.least(limit.cast("double"), F.col("level") * F.col("weight")).alias("target"))


def row_key() -> Column:
    """A hash of doc_id, source and text, which nulls have as well."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in ("doc_id", "source")]
    return F.md5(F.concat(F.md5(F.concat_ws("\n", F.length(parts[1]).cast("string"), *parts).cast("binary")), text_or_empty()).cast("binary"))


def mixing_plan(documents: DataFrame, weights=WEIGHTS, slopes=SLOPES, share: float = SHARE, cap: int = CAP, rows_per_group: int = 20_000, keyed: bool = False) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, taken, starts, position``.

    size: words of the text (null: 0). taken: words that the mix takes, all copies counted; the last copy of a source
    is cut where the source's demand ends, so a source's taken words sum up to its target, rounded. starts: for each
    copy that is taken, ``copy, words, position`` (a copy may be cut); position: the first copy's, null if none.
    A null source is a source of its own; texts without words take nothing. The order within a source is by MD5 of
    doc_id, then by size and text, so reruns agree, repeated rows too. An empty table gives no rows. Only doc_id,
    source and text are read, and no text is shuffled. ``keyed`` adds ``row_key``, which rows share that agree in
    doc_id, source and text.
    """
    text = text_or_empty()
    extra = ["row_key"] if keyed else []
    rows = documents.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")).alias("draw"), F.xxhash64(text).alias("tie"), *([row_key().alias("row_key")] if keyed else []))
    rows = written(rows, "mix-rows")
    count, digits = rows.count(), 2
    while count / 16**digits > rows_per_group and digits < 7:
        digits += 1
    rows = rows.withColumn("slice", F.substring("draw", 1, digits)).withColumn("named", F.col("source").isNotNull()).withColumn("source", F.coalesce("source", F.lit("")))
    key = ["named", "source"]
    parts = written(rows.groupBy(*key, "slice").agg(F.sum("size").alias("part")), "mix-parts")
    parts = parts.withColumn("before", F.sum("part").over(Window.partitionBy(*key).orderBy("slice")) - F.col("part"))
    sizes = parts.groupBy(*key).agg(F.sum("part").alias("source_size")).select(F.when(F.col("named"), F.col("source")).alias("source"), "source_size")
    targets = source_targets(sizes, weights, slopes, share, cap).withColumn("named", F.col("source").isNotNull()).withColumn("source", F.coalesce("source", F.lit("")))
    parts = written(parts.join(targets, key).drop("part"), "mix-offsets")
    inside = Window.partitionBy(*key, "slice").orderBy("draw", F.col("doc_id").asc_nulls_last(), "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
    at = rows.withColumn("run", F.sum("size").over(inside) - F.col("size")).join(parts, [*key, "slice"]).withColumn("start", F.col("before") + F.col("run"))
    due = F.round("target").cast("long")

    def copy(i: int) -> Column:
        first = F.col("start") + i * F.col("source_size")
        words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), due - first))
        part = F.when(F.col("target") > 0, first / F.col("target")).otherwise(0.0)
        return F.struct(F.lit(i).alias("copy"), words.alias("words"), time_of(part, F.col("slope")).alias("position"))

    starts = F.filter(F.array(*[copy(i) for i in range(int(-(-cap // 1)))]), lambda c: c.words > 0)
    at = at.withColumn("starts", starts)
    return at.select(
        "doc_id",
        F.when(F.col("named"), F.col("source")).alias("source"),
        "size",
        "source_size",
        "target",
        F.aggregate("starts", F.lit(0).cast("long"), lambda s, c: s + c.words).alias("taken"),
        "starts",
        F.try_element_at("starts", F.lit(1)).getField("position").alias("position"),
        *extra,
    )


def in_training_order(plan: DataFrame) -> DataFrame:
    """The plan range-sorted by position (documents that are not taken come last)."""
    return plan.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mix(documents: DataFrame, **options) -> DataFrame:
    """The mix itself: a row per taken copy, in training order, with ``documents``' columns.

    A copy that is cut keeps the first ``words`` words with the white space between them. Rows are told apart by doc_id,
    source and text, null and repeated doc_ids included; rows that agree in all of them are numbered.
    """
    plan = mixing_plan(documents, keyed=True, **options).where("size(starts) > 0")
    same = Window.partitionBy("row_key")
    plan = plan.withColumn("place", F.row_number().over(same.orderBy("position"))).withColumn("of", F.count(F.lit(1)).over(same))
    plan = written(plan.select("row_key", "place", "of", "size", "starts"), "mix-plan")
    keyed = documents.select(as_row(documents), row_key().alias("row_key"))
    found = keyed.join(plan.where("of = 1").drop("place", "of"), "row_key")
    repeated = plan.where("of > 1")
    if not repeated.isEmpty():
        several = keyed.join(repeated.select("row_key").distinct(), "row_key", "left_semi")
        several = several.withColumn("place", F.row_number().over(Window.partitionBy("row_key").orderBy(F.to_json("row"))))
        found = found.unionByName(several.join(repeated.drop("of"), ["row_key", "place"]).drop("place"))
    found = found.withColumn("start", F.explode("starts"))
    pieces = F.regexp_extract_all("row.text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col("start.words").cast("int")), "")
    text = F.when(F.col("start.words") < F.col("size"), cut).otherwise(F.col("row.text"))
    return found.orderBy("start.position", "row.doc_id", "start.copy", "row_key").select(*row_fields(documents, text=text))
