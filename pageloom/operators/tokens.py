"""Design-token counts over declarations, and over pre-counted snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import css_tokens as T
from ..sources.scratch import written

#: Categories of counts.
CATEGORIES = (
    "color_all", "color_text", "color_background", "color_border", "color_fill", "color_other", "font_family", "font_size",
    "font_weight", "line_height", "spacing", "border_radius", "media_query", "breakpoint",
)


def ordinal() -> Column:
    """Place of a row in the order of reading."""
    return F.struct("page_id", "source_seq", "rule_seq", "decl_seq")


def declaration_tokens(css_rows: DataFrame, strict: bool = False) -> DataFrame:
    """TOK19: ``category, key, place`` of every token of declarations."""
    decls = css_rows.where("kind = 'decl'").withColumn("_at", ordinal())
    tokens = decls.select("_at", F.posexplode(T.declaration_tokens(F.col("prop"), F.col("value"), strict)).alias("_i", "t"))
    return tokens.select("t.category", "t.key", F.struct("_at.*", F.col("_i").alias("token_seq")).alias("place"))


def media_tokens(css_rows: DataFrame) -> DataFrame:
    """AGG2: media queries and their breakpoints."""
    media = css_rows.where("kind = 'media'")
    place = F.struct("page_id", "source_seq", F.lit(0).alias("rule_seq"), F.lit(0).alias("decl_seq"), F.lit(0).alias("token_seq"))
    queries = media.select(F.lit("media_query").alias("category"), F.col("value").alias("key"), place.alias("place"))
    return queries.unionByName(media.select(F.lit("breakpoint").alias("category"), F.explode(T.breakpoints(F.col("value"))).alias("key"), place.alias("place")))


def count_tokens(tokens: DataFrame) -> DataFrame:
    """AGG1 to AGG3: ``category, value, n``; counts are combined before anything is shuffled.

    Families are counted whatever their case, under the spelling that came first. Rows are counted by spelling first, in
    hash tables of numbers (a minimum of places as such would sort all rows of a task), and only spellings are compared.
    """
    family = F.col("category") == "font_family"
    n = F.sum("n") if "n" in tokens.columns else F.count(F.lit(1))
    near = F.when(family & _fits_number(), _place_number())
    far = F.when(family & ~_fits_number(), F.struct(*[F.col(f"place.{c}").cast("long").alias(c) for c in _PLACE]))
    spelled = tokens.select("category", "key", *[c for c in ("n",) if c in tokens.columns], near.alias("_near"), far.alias("_far"))
    spelled = spelled.groupBy("category", "key", "_far").agg(F.min("_near").alias("_near"), n.cast("long").alias("n"))
    group = F.when(family, F.lower("key")).otherwise(F.col("key"))
    first = F.min_by("key", F.coalesce("_far", _place_of(F.col("_near"))))
    grouped = spelled.groupBy("category", group.alias("_g")).agg(first.alias("_first"), F.sum("n").cast("long").alias("n"))
    return grouped.select("category", F.when(family, F.col("_first")).otherwise(F.col("_g")).alias("value"), "n")


#: Parts of a place in order, and the bits that each has in a place as one number; a page has any 64-bit number.
_PLACE = {"page_id": None, "source_seq": 16, "rule_seq": 20, "decl_seq": 16, "token_seq": 10}
_REST = 1 << 62


def _fits_number() -> Column:
    """Whether a place has no null and no part with more bits than it gets."""
    fits = F.col("place.page_id").isNotNull()
    for name, bits in _PLACE.items():
        if bits:
            fits = fits & F.coalesce(F.col(f"place.{name}").between(0, (1 << bits) - 1), F.lit(False))
    return fits


def _place_number() -> Column:
    """A place as one decimal in the same order: 126 bits, which 38 digits hold."""
    rest = F.lit(0).cast("long")
    for name, bits in _PLACE.items():
        if bits:
            rest = F.shiftleft(rest, bits).bitwiseOR(F.col(f"place.{name}").cast("long"))
    return (F.col("place.page_id").cast("decimal(19,0)") * F.lit(_REST).cast("decimal(19,0)") + rest.cast("decimal(19,0)")).cast("decimal(38,0)")


def _place_of(number: Column) -> Column:
    """The place that a number stands for."""
    rest = F.pmod(number, F.lit(_REST).cast("decimal(38,0)")).cast("long")
    page = F.call_function("div", number - rest.cast("decimal(38,0)"), F.lit(_REST).cast("decimal(38,0)"))
    parts, at = [], 62
    for name, bits in _PLACE.items():
        if bits:
            at -= bits
            parts.append(F.shiftright(rest, at).bitwiseAND(F.lit((1 << bits) - 1)).alias(name))
    return F.struct(page.alias("page_id"), *parts)


def ranked(counts: DataFrame) -> DataFrame:
    """SRT1: with ``rank`` in each category: by count, then by the value's collation.

    Places inside sorted ranges, after the category's rows in the ranges before, so a category of any size is many tasks.
    """
    order = [F.col("n").desc(), F.collate("value", "UNICODE"), "value"]
    ranged = written(counts.repartitionByRange("category", *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("category", "_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each range of a category
    before = sizes.select("category", "_part", (F.sum("_n").over(Window.partitionBy("category").orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("category", "_part").orderBy(*order))
    return ranged.withColumn("rank", inside).join(F.broadcast(before), ["category", "_part"]).select(*counts.columns, (F.col("_before") + F.col("rank")).cast("int").alias("rank"))


def totals(counts: DataFrame) -> DataFrame:
    """AGG9: ``category, n_distinct``."""
    return counts.groupBy("category").agg(F.count(F.lit(1)).alias("n_distinct"))


def selector_stats(css_rows: DataFrame) -> DataFrame:
    """AGG5: one row of sums over rules and their selectors."""
    rules = css_rows.where("kind = 'rule'").select(F.posexplode_outer(T.selectors(F.col("selector"))).alias("_i", "s"))
    n_rules = F.count_if(F.coalesce(F.col("_i"), F.lit(0)) == 0).alias("style_rules")  # a rule has a first selector, or one row without
    return rules.agg(n_rules, F.count("s").alias("selectors"), *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in T.selector_features(F.col("s")).items()])


def heading_tokens(css_rows: DataFrame, strict: bool = False) -> DataFrame:
    """AGG4: ``heading, breakpoint, kind, value, n``; a bucket without tokens has one row with null kind.

    Families are told apart by case here.
    """
    decls = css_rows.where("kind = 'decl'").withColumn("heading", F.explode(F.array_distinct(F.flatten(F.transform(T.selectors(F.col("selector")), T.selector_headings)))))
    decls = decls.where(F.trim("value") != "")
    tokens = F.filter(T.declaration_tokens(F.col("prop"), F.col("value"), strict), lambda t: t.category.isin("font_family", "font_size", "font_weight", "line_height"))
    rows = decls.select("heading", F.col("media").alias("breakpoint"), F.explode_outer(tokens).alias("t"))
    counted = rows.groupBy("heading", "breakpoint", F.col("t.category").alias("kind"), F.col("t.key").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    counted = written(counted, "headings")  # read three times below
    full = counted.where("kind is not null").select("heading", "breakpoint").distinct()
    return counted.where("kind is not null").unionByName(counted.where("kind is null").join(full, ["heading", "breakpoint"], "left_anti"))


def merge_counts(records: DataFrame) -> DataFrame:
    """AGG6: tokens of pre-counted records (``category, key, n, place``): keys normalised again, other than positive finite
    counts ignored, and colours counted for ``color_all`` as well."""
    c, key = F.col("category"), normalized_key(F.col("category"), F.col("key"))
    n = F.col("n").cast("double")
    good = records.withColumn("key", key).where((n > 0) & (n < float("inf")) & F.col("key").isNotNull() & (F.col("key") != ""))
    return good.unionByName(good.where(c.startswith("color_") & (c != "color_all")).withColumn("category", F.lit("color_all")))


def snapshot_records(snapshots: DataFrame) -> DataFrame:
    """``category, key, n, place`` of snapshots (``page_id, used``) whose ``used`` has maps by group, as captured."""
    groups = {
        "color_text": "used.colors.text", "color_background": "used.colors.background", "color_border": "used.colors.border", "color_fill": "used.colors.fill",
        "font_size": "used.typography.fontSizes", "font_weight": "used.typography.fontWeights", "line_height": "used.typography.lineHeights",
        "font_family": "used.typography.fontFamilies", "spacing": "used.layout.spacing", "border_radius": "used.layout.borderRadius",
    }
    out = None
    for i, (name, at) in enumerate(groups.items()):
        place = F.struct("page_id", F.lit(i).alias("source_seq"), F.lit(0).alias("rule_seq"), F.lit(0).alias("decl_seq"), F.col("pos").alias("token_seq"))
        rows = snapshots.select("page_id", F.posexplode(F.map_entries(at)).alias("pos", "e")).select(F.lit(name).alias("category"), F.col("e.key").alias("key"), F.col("e.value").alias("n"), place.alias("place"))
        out = rows if out is None else out.unionByName(rows)
    return out


#: Maps of a heading's snapshot by kind of token.
HEADING_MAPS = {"font_family": "fontFamilies", "font_size": "fontSizes", "font_weight": "fontWeights", "line_height": "lineHeights"}


def normalized_key(category: Column, key: Column) -> Column:
    return (
        F.when(category.startswith("color_"), T.normalize_color(key))
        .when(category == "font_family", T.sanitize_family(key))
        .when(category == "font_weight", T.normalize_weight(key))
        .otherwise(T.normalize_length(key))
    )


def snapshot_headings(snapshots: DataFrame) -> DataFrame:
    """AGG4, AGG6: ``heading, breakpoint, kind, value, n`` of snapshots' ``headings``, as ``heading_tokens`` has them."""

    def entries(kind: str, at: str) -> Column:
        own = F.coalesce(F.map_entries(at), F.expr("cast(array() as array<struct<key:string,value:bigint>>)"))
        return F.transform(own, lambda e: F.struct(F.lit(kind).alias("kind"), e["key"].alias("key"), e["value"].cast("double").alias("n")))

    each = [entries(k, f"h.{m}") for k, m in HEADING_MAPS.items()]
    heads = snapshots.select(F.explode("headings").alias("h"))
    rows = heads.select("h.heading", "h.breakpoint", F.explode_outer(F.concat(*each)).alias("t")).select("heading", "breakpoint", "t.*")
    value = normalized_key(F.col("kind"), F.col("key"))
    good = rows.withColumn("value", value).where("n > 0 and n < double('Infinity') and value is not null and value <> ''")
    counted = good.groupBy("heading", "breakpoint", "kind", "value").agg(F.sum("n").cast("long").alias("n"))
    empty = rows.select("heading", "breakpoint").distinct().join(counted.select("heading", "breakpoint").distinct(), ["heading", "breakpoint"], "left_anti")
    return counted.unionByName(empty.withColumn("kind", F.lit(None).cast("string")).withColumn("value", F.lit(None).cast("string")).withColumn("n", F.lit(0).cast("long")))


def snapshot_stats(snapshots: DataFrame) -> DataFrame:
    """AGG7 of snapshots: one row of sums."""
    names = {"elements": "elements", "external_stylesheets": "externalStylesheets", "inline_style_elements": "inlineStyleElements", "inline_style_attributes": "inlineStyleAttributes"}
    return snapshots.agg(F.count(F.lit(1)).alias("pages"), *[F.coalesce(F.sum(f"html.{c}"), F.lit(0)).alias(n) for n, c in names.items()])


def tokens_of_run(css_rows: DataFrame, snapshots: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """All tokens of a run: of snapshots if there are any (D3), else of declarations; media queries either way."""
    media = media_tokens(css_rows).withColumn("n", F.lit(1).cast("bigint"))
    if snapshots is not None and not snapshots.isEmpty():
        return merge_counts(snapshot_records(snapshots)).select("category", "key", F.col("n").cast("bigint").alias("n"), "place").unionByName(media)
    return declaration_tokens(css_rows, strict).withColumn("n", F.lit(1).cast("bigint")).unionByName(media)
