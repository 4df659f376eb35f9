"""Token reports: picks and scales as DataFrames, and the design document from their few rows."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import css_tokens as T
from ..functions.urls import Url
from ..operators import tokens as K
from ..sources.scratch import written

#: Labels of the radius scale, roles in front matter and in the list, limits of both scales.
ROUNDED_LABELS = ("none", "xs", "sm", "md", "lg", "xl", "2xl", "3xl")
FRONT_ROLES = ("primary", "secondary", "accent", "background", "surface", "text", "textMuted", "border")
LIST_ROLES = ("primary", "secondary", "background", "surface", "text", "textMuted", "border", "accent")
SPACING_LIMIT = 12
FULL = "9999px"


def _best(df: DataFrame, keep: Column, order: Column) -> Column:
    """Aggregate: the value of the row with the least ``order`` among those that ``keep`` names."""
    return F.min_by(F.when(keep, F.col("value")), F.when(keep, order))


def pick_colors(ranked: DataFrame) -> DataFrame:
    """AGG10 to AGG12, REP2: ``role, value`` from ranked counts (``category, value, n, rank``).

    Roles that exclude earlier ones follow in steps; each step is an aggregate of one row. Ties go to the better rank.
    """
    rows = ranked.where(F.col("category").startswith("color_") & T.is_hex_color(F.col("value")))
    rows = rows.withColumn("s", T.saturation(F.col("value"))).withColumn("l", T.luminance(F.col("value"))).withColumn("chromatic", ~T.is_near_neutral(F.col("value")))
    of = {name: F.col("category") == f"color_{name}" for name in ("all", "text", "background", "border")}
    rank = F.struct("rank")
    strong = of["all"] & F.col("chromatic")
    first = rows.agg(
        F.coalesce(_best(rows, strong, F.struct(-F.col("n") * (0.5 + F.col("s")), "rank")), _best(rows, of["all"], rank)).alias("primary"),
        F.coalesce(_best(rows, of["background"] & (F.col("l") > 0.85), rank), _best(rows, of["background"], rank)).alias("background"),
        F.coalesce(_best(rows, of["text"] & (F.col("l") < 0.3), rank), _best(rows, of["text"], rank)).alias("text"),
        _best(rows, of["border"], rank).alias("border"),
    )
    value = F.col("value")
    by_count = F.struct(-F.col("n"), "rank")
    both = rows.crossJoin(F.broadcast(first))  # one row
    second = both.agg(
        *[F.first(c).alias(c) for c in first.columns],
        _best(both, of["background"] & ~value.eqNullSafe(F.col("background")) & (F.col("l") > 0.8), rank).alias("surface"),
        _best(both, of["text"] & ~value.eqNullSafe(F.col("text")) & (F.col("l") > 0.25) & (F.col("l") < 0.65), by_count).alias("textMuted"),
        _best(both, strong & ~value.eqNullSafe(F.col("primary")), by_count).alias("secondary"),
    )
    last = rows.crossJoin(F.broadcast(second))  # one row
    out = last.agg(
        *[F.first(c).alias(c) for c in second.columns],
        _best(last, strong & ~value.eqNullSafe(F.col("primary")) & ~value.eqNullSafe(F.col("secondary")), F.struct(-F.col("s"), -F.col("n"), F.col("rank"))).alias("accent"),
    )
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("value")) for r in FRONT_ROLES]))
    return out.select(pairs.alias("p")).select("p.role", "p.value").where("value is not null")


def _px_ladder(ranked: DataFrame, category: str) -> DataFrame:
    """WIN3: ``place, value, px``: dimensions in ascending pixels, one for each hundredth, none below 0."""
    rows = ranked.where(F.col("category") == category).withColumn("px", T.px_value(F.col("value"))).withColumn("value", T.normalize_dimension(F.col("value"))).where("px is not null and value is not null")
    key = F.floor(F.col("px") * 100 + 0.5)
    first = Window.partitionBy("key").orderBy("px", "rank")
    rows = rows.withColumn("key", key).withColumn("_n", F.row_number().over(first)).where("_n = 1 and px >= 0")
    return rows.withColumn("place", F.row_number().over(Window.orderBy("px", "rank")) - 1).select("place", "value", "px")


def spacing_scale(ranked: DataFrame) -> DataFrame:
    """REP4: ``place, name, value``: the first twelve, named by place."""
    return _px_ladder(ranked, "spacing").where(F.col("place") < SPACING_LIMIT).select("place", F.col("place").cast("string").alias("name"), "value")


def rounded_scale(ranked: DataFrame) -> DataFrame:
    """REP4: ``place, name, value``: the first eight, and ``full`` unless one of them is as large; empty without any."""
    steps = _px_ladder(ranked, "border_radius").where(F.col("place") < len(ROUNDED_LABELS))
    named = steps.select("place", F.element_at(F.array(*map(F.lit, ROUNDED_LABELS)), F.col("place") + 1).alias("name"), "value")
    full = steps.agg(F.count(F.lit(1)).alias("n"), F.max("px").alias("most")).where("n > 0 and most < 9999")
    return named.unionByName(full.select(F.lit(len(ROUNDED_LABELS)).alias("place"), F.lit("full").alias("name"), F.lit(FULL).alias("value")))


def heading_report(headings: DataFrame) -> DataFrame:
    """AGG4, REP0, SRT2: ``heading, breakpoint, kind, value, n, rank, place``: buckets in report order."""
    order = [F.when(F.col("breakpoint") == "base", -1.0).otherwise(T.breakpoint_number(F.col("breakpoint"))), F.col("heading"), F.collate("breakpoint", "UNICODE"), F.col("breakpoint")]
    inside = Window.partitionBy("heading", "breakpoint", "kind").orderBy(F.col("n").desc(), F.collate("value", "UNICODE"), "value")
    return headings.withColumn("rank", F.row_number().over(inside)).withColumn("place", F.dense_rank().over(Window.orderBy(*order)))


def build_report(source_url: str, css_rows: DataFrame, html_stats: DataFrame, snapshots: DataFrame | None = None, generated_at: str = "", strict: bool = False) -> dict:
    """REP1: the whole report. Its rows - distinct tokens of one site - are collected; all counting is done before."""
    # both are read several times below: written, so that pages and sheets are parsed once
    css_rows = written(css_rows, "css-rows")
    ranked = written(K.ranked(K.count_tokens(K.tokens_of_run(css_rows, snapshots, strict))), "ranked")
    items: dict[str, list[dict]] = {c: [] for c in K.CATEGORIES}
    for r in ranked.orderBy("category", "rank").toLocalIterator():
        items[r.category].append({"value": r.value, "count": r.n})
    heads: dict[tuple, dict] = {}
    seen = snapshots is not None and not snapshots.isEmpty()  # then styles count as computed, not as declared (D3)
    if seen:
        html_stats = K.snapshot_stats(snapshots)
    for r in heading_report(K.snapshot_headings(snapshots) if seen else K.heading_tokens(css_rows, strict)).orderBy("place", "kind", "rank").toLocalIterator():
        bucket = heads.setdefault((r.heading, r.breakpoint), {"font_family": [], "font_size": [], "font_weight": [], "line_height": []})
        if r.kind:
            bucket[r.kind].append({"value": r.value, "count": r.n})
    generic = lambda i: i["value"].lower() in T.GENERIC_FAMILIES
    return {
        "source_url": source_url,
        "generated_at": generated_at,
        "stats": {"html": html_stats.first().asDict(), "selectors": K.selector_stats(css_rows).first().asDict()},
        **items,
        "fonts": {"all": items["font_family"], "brand": [i for i in items["font_family"] if not generic(i)], "generic": [i for i in items["font_family"] if generic(i)]},
        "headings": [{"heading": h, "breakpoint": b} | v for (h, b), v in heads.items()],
        "colors": {r.role: r.value for r in pick_colors(ranked).collect()},
        "spacing_scale": [(r.name, r.value) for r in spacing_scale(ranked).orderBy("place").collect()],
        "rounded_scale": [(r.name, r.value) for r in rounded_scale(ranked).orderBy("place").collect()],
    }


def _dimension(value: str | None) -> str | None:
    v = (value or "").strip().lower()
    if v == "0":
        return "0px"
    if re.fullmatch(r"-?(?:\d+|\d*\.\d+)(?:px|rem|em)", v):
        return v
    return v + "px" if re.fullmatch(T.UNITLESS[1:-1], v) else None


def _height(value: str | None) -> str | float | None:
    v = (value or "").strip().lower()
    if v and re.fullmatch(T.UNITLESS[1:-1], v):
        return int(float(v)) if float(v).is_integer() else float(v)
    return None if v == "normal" else _dimension(v)


def _weight(value: str | None) -> str | None:
    v = {"normal": "400", "bold": "700"}.get((value or "").strip().lower(), (value or "").strip().lower())
    return v if re.fullmatch("[1-9]00", v) else None


def _value(items: Iterable[dict], pattern: str = "") -> str | None:
    return next((i["value"] for i in items if re.fullmatch(pattern or ".*", i["value"], re.S)), None)


def _size_between(items: Iterable[dict], least: int, most: int) -> str | None:
    """The first size in whole pixels within bounds."""
    return next((i["value"] for i in items if re.fullmatch(r"\d+px", i["value"]) and least <= int(i["value"][:-2]) <= most), None)


def typography(report: dict) -> dict[str, dict]:
    """REP3: tokens by name; one is left out if all its fields are."""
    families = report["fonts"]["brand"] or report["fonts"]["all"]
    brand = families[0]["value"].strip("'\"") if families else None

    def of_heading(level: str) -> dict:
        buckets = [h for h in report["headings"] if h["heading"] == level]
        own = next((h for h in buckets if h["breakpoint"] == "base"), buckets[0] if buckets else None)
        if own is None:
            return {}
        family = _value(own["font_family"])
        return {"family": family and family.strip("'\""), "size": _dimension(_value(own["font_size"])), "weight": _weight(_value(own["font_weight"])), "height": _height(_value(own["line_height"]))}

    sizes, weights = report["font_size"], report["font_weight"]
    body = {
        "family": brand,
        "size": _dimension(_size_between(sizes, 14, 18)) or _dimension(_value(sizes)),
        "weight": _weight(_value(weights, "400|normal")) or _weight(_value(weights)),
        "height": _height(_value(report["line_height"])),
    }
    caption = body | {"size": _dimension(_size_between(sizes, 11, 13))}
    out = {}
    for name, token, fallback in (("headline-display", of_heading("h1"), brand), ("headline-md", of_heading("h2"), brand), ("body-md", body, None), ("body-sm", caption, None)):
        if any(token.values()):
            out[name] = token | {"family": token.get("family") or fallback}
    return out


def yaml_text(value: str | int | float) -> str:
    if not isinstance(value, str):
        return str(value)
    if re.fullmatch(r"[A-Za-z0-9._/-]+", value) and value.lower() not in ("true", "false", "null", "yes", "no"):
        return value
    return '"' + value.replace("\\", "\\\\").replace('"', '\\"') + '"'


def site_name(url: str) -> str:
    try:
        return re.sub(r"^www\.", "", Url(url).host) or url
    except ValueError:
        return url


def _mapping(label: str, entries: Iterable[tuple[str, str | None]]) -> list[str]:
    lines = [f"  {yaml_text(k)}: {yaml_text(v)}" for k, v in entries if v]
    return [f"{label}:", *lines] if lines else []


#: The text of the document around the tokens, and the fields of a typography token.
FIELDS = (("family", "fontFamily", "family"), ("size", "fontSize", "size"), ("weight", "fontWeight", "weight"), ("height", "lineHeight", "line-height"))
NO_COLORS, NO_TYPOGRAPHY, NO_VALUES, NO_BREAKPOINTS = "_No reliable color tokens detected._", "_No typography tokens detected._", "_No values detected._", "_No breakpoints detected._"
NO_SHADOWS = "_No shadow tokens were extracted in this pass._"
NO_COMPONENTS = "_Component tokens are not auto-derived. Map these against the colors and typography above as you build._"
ADVICE = (
    "- **Do** use `colors.primary` for primary actions and links.",
    "- **Do** pair `typography.headline-display` with hero copy and `typography.body-md` for prose.",
    "- **Don't** introduce colors outside the palette without updating this file.",
    "- **Don't** use raw pixel values for spacing — pick from the `spacing` scale.",
)


def design_markdown(report: dict) -> str:
    """REP5: front matter and eight sections, from the few rows of a report."""
    url, name, colors, types = report["source_url"], site_name(report["source_url"]), report["colors"], typography(report)
    front = ["version: alpha", f"name: {yaml_text(name)}", f"description: {yaml_text(f'Design tokens auto-extracted from {url} on {report["generated_at"]}')}"]
    front += _mapping("colors", [(r, colors.get(r)) for r in FRONT_ROLES])
    if types:
        front.append("typography:")
        for key, token in types.items():
            front.append(f"  {yaml_text(key)}:")
            front += [f"    {yaml}: {yaml_text(token[f])}" for f, yaml, _ in FIELDS if token.get(f) or (f == "height" and token.get(f) == 0)]
    front += _mapping("rounded", report["rounded_scale"]) + _mapping("spacing", report["spacing_scale"]) + ["components: {}"]

    def listed(lines: list[str], none: str) -> str:
        return "\n".join(lines) or none

    def scale(entries: list[tuple[str, str]]) -> str:
        return listed([f"- `{k}` — `{v}`" for k, v in entries], NO_VALUES)

    families = report["fonts"]["brand"] or report["fonts"]["all"]
    counts = {c: len(report[c]) for c in ("color_all", "font_family", "font_size")}
    overview = [
        f"Design tokens were auto-extracted from `{url}`.",
        f"Detected {counts['color_all']} colors, {counts['font_family']} font families, and {counts['font_size']} distinct font sizes across {report['stats']['html']['pages']} page(s).",
    ]
    if families:
        brand = families[0]["value"].strip("'\"")
        overview.append(f"The dominant brand font appears to be **{brand}**.")
    typed = [f"- **{k}** — " + ", ".join(f"{label}: `{t[f]}`" for f, _, label in FIELDS if t.get(f) is not None) for k, t in types.items()]
    points = [f"- {b['value']} ({b['count']})" for b in report["breakpoint"][:8]]
    sections = [
        f"# {name}", "## Overview", "\n".join(overview), "## Colors", listed([f"- **{r}** — `{colors[r]}`" for r in LIST_ROLES if colors.get(r)], NO_COLORS),
        "## Typography", listed(typed, NO_TYPOGRAPHY), "## Layout", "### Spacing scale", scale(report["spacing_scale"]), "### Breakpoints", listed(points, NO_BREAKPOINTS),
        "## Elevation & Depth", NO_SHADOWS, "## Shapes", "### Rounded scale", scale(report["rounded_scale"]), "## Components", NO_COMPONENTS, "## Do's and Don'ts", "\n".join(ADVICE),
    ]
    return "\n".join(["---", *front, "---", "", "\n\n".join(sections), ""])
