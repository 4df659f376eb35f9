"""Generators: links, assets, styles, declarations and counts of captured pages."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import css, dom
from ..functions.text import normalize_text
from ..functions.urls import absolute_url, is_http_url, is_skipped, normalize_url, resolved
from ..sources.scratch import written
from ..sources.slices import map_in_slices

#: Parts of a page that hold no markup of their own.
MASKED = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"
HREF = r"""(?is)<a\b[^>]*?\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
#: Attributes that hold an asset before a script runs.
LAZY_ATTRIBUTES = (
    "data-src", "data-lazy", "data-lazy-src", "data-original", "data-bg", "data-bg-src", "data-background",
    "data-background-image", "data-nectar-img-src", "data-srcset", "data-lazy-srcset", "data-nectar-img-srcset",
)


def masked(html: Column) -> Column:
    """HTML without comments, scripts and style bodies."""
    return F.regexp_replace(html, MASKED, " ")


def unescaped(value: Column) -> Column:
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        value = F.replace(value, F.lit(entity), F.lit(plain))
    return value


def hrefs(html: Column) -> Column:
    """Targets of all anchors in order, as written, entities resolved."""
    m = masked(html)
    groups = [F.regexp_extract_all(m, F.lit(HREF), F.lit(i)) for i in (1, 2, 3)]
    return F.transform(F.arrays_zip(*[g.alias(n) for g, n in zip(groups, "xyz", strict=True)]), lambda t: unescaped(F.concat(F.coalesce(t["x"], F.lit("")), F.coalesce(t["y"], F.lit("")), F.coalesce(t["z"], F.lit("")))))


def links(pages: DataFrame) -> DataFrame:
    """HTM1: ``page_id, url, link_seq, href, absolute, normalized``: http(s) targets, each once a page, in order.

    Targets are resolved against the page's address (a base element doesn't count). Rows are made by expressions alone.
    """
    found = pages.select("page_id", "url", F.posexplode(hrefs(F.col("html"))).alias("link_seq", "href"))
    found = found.where((F.col("href") != "") & ~is_skipped(F.col("href"))).withColumn("absolute", absolute_url(F.col("href"), F.col("url")))
    found = found.where(F.coalesce(is_http_url(F.col("absolute")), F.lit(False)))
    first = found.groupBy("page_id", "url", "absolute").agg(F.min(F.struct("link_seq", "href")).alias("f"))
    return first.select("page_id", "url", F.col("f.link_seq").alias("link_seq"), F.col("f.href").alias("href"), "absolute", normalize_url(F.col("absolute")).alias("normalized"))


def start_tags(pages: DataFrame) -> DataFrame:
    """HTM7, HTM8 as markup has them: ``page_id, tag, n`` over start tags outside comments, scripts and styles' bodies."""
    bare = F.regexp_replace(F.regexp_replace(F.col("html"), "(?s)<!--.*?-->", " "), r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>", "<$1>")
    tags = F.regexp_extract_all(bare, F.lit(r"<([A-Za-z][A-Za-z0-9-]*)"), F.lit(1))
    return pages.select("page_id", F.explode(tags).alias("tag")).groupBy("page_id", F.lower("tag").alias("tag")).agg(F.count(F.lit(1)).alias("n"))


def title_of(html: Column) -> Column:
    m = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script>", " ")
    title = normalize_text(unescaped(F.regexp_extract(m, r"(?is)<title\b[^>]*>(.*?)</title>", 1)))
    return F.when(title != "", title)


def titles(pages: DataFrame) -> DataFrame:
    """HTM5: ``page_id, title`` (null if none or blank)."""
    return pages.select("page_id", title_of(F.col("html")).alias("title"))


def unique_limit(values: Column, limit: int) -> Column:
    """WIN1: distinct non-empty values in order of first occurrence, ``limit`` at most."""
    return F.slice(F.array_distinct(F.filter(values, lambda v: v != "")), 1, limit)


def headings_of(html: Column, limit: int = 6) -> Column:
    texts = F.regexp_extract_all(masked(html), F.lit(r"(?is)<h[1-3]\b[^>]*>(.*?)</h[1-3]>"), F.lit(1))
    plain = F.transform(texts, lambda t: normalize_text(unescaped(F.regexp_replace(t, r"(?s)<[^>]*>", ""))))
    return unique_limit(plain, limit)


def headings(pages: DataFrame, limit: int = 6) -> DataFrame:
    """HTM5: ``page_id, headings``: texts of h1 to h3 in order, each once."""
    return pages.select("page_id", headings_of(F.col("html"), limit).alias("headings"))


def style_blocks(pages: DataFrame) -> DataFrame:
    """HTM9: ``page_id, style_seq, css`` of style elements that aren't blank."""
    m = F.regexp_replace(F.col("html"), r"(?is)<!--.*?-->|<script\b.*?</script>", " ")
    bodies = F.regexp_extract_all(m, F.lit(r"(?is)<style\b[^>]*>(.*?)</style>"), F.lit(1))
    return pages.select("page_id", F.posexplode(bodies).alias("style_seq", "css")).where(F.trim(F.regexp_replace("css", r"\s", "")) != "")


# --- generators over parsed documents -------------------------------------------------------------------------------

FACTS = (
    "page_id bigint, title string, headings array<string>, stylesheets array<string>, n_elements bigint, n_external bigint, "
    "n_stylesheets bigint, n_images bigint, n_scripts bigint, n_style_elements bigint, n_style_attributes bigint, "
    "styles array<string>, style_attributes array<string>, assets array<string>, links array<string>, css_files array<string>"
)


def srcset_urls(value: str) -> list[str]:
    """HTM4: the first token of each candidate."""
    return [c.split(None, 1)[0] for c in value.split(",") if c.strip()]


def asset_references(document: dom.Node | dom.Index) -> list[str]:
    """HTM2: references as written, in the order of the passes."""
    out: list[str | None] = []

    def attribute(selector: str, *names: str) -> None:
        for n in document.select(selector):
            out.append(next((n.get(x) for x in names if n.get(x)), None))

    attribute('link[rel="stylesheet"][href]', "href")
    attribute('link[rel="preload"][href], link[rel="modulepreload"][href]', "href")
    attribute("script[src]", "src")
    attribute('link[rel~="icon"][href], link[rel="apple-touch-icon"][href], link[rel="mask-icon"][href]', "href")
    attribute("img[src], source[src], video[poster]", "src", "poster")
    for n in document.select("[srcset]"):
        out += srcset_urls(n.get("srcset"))
    for name in LAZY_ATTRIBUTES:
        attribute(f"[{name}]", name)
    for n in document.select("[style]"):
        out += [ref for _, _, ref, _ in css.top_references(n.get("style"))]
    for n in document.select("style"):
        for refs in css.references(n.text()):
            out += refs
    return [r for r in out if r]


def collapse(text: str) -> str:
    return " ".join(text.replace("﻿", " ").split())


def local_sheets(path: str, hrefs: list[str]) -> list[str]:
    """HTM6: files of linked sheets, relative to the output folder, each once, twelve at most."""
    out = []
    for href in hrefs:
        plain = href.split("#")[0].split("?")[0]
        if not plain or plain.startswith(("http://", "https://", "//", "data:")):
            continue
        joined = plain.lstrip("/") if plain.startswith("/") else posixpath.join(posixpath.dirname(path), plain)
        out.append(posixpath.normpath(joined))
    return list(dict.fromkeys(out))[:12]


def facts_of(page_id: int, url: str, html: str, path: str | None = None) -> dict:
    d = dom.Index(dom.parse(html or ""))
    title = d.first("title")
    heads = [collapse(n.text()) for n in d.select("h1, h2, h3")]
    sheets = d.select('link[rel~="stylesheet"][href]')
    styles = d.select("style")
    hrefs = [n.get("href").strip() for n in sheets]
    assets = dict.fromkeys(r for r in (resolved(x, url, skip_fragments=False) for x in asset_references(d)) if r)
    return {
        "page_id": page_id,
        "title": (collapse(title.text()) or None) if title else None,
        "headings": list(dict.fromkeys(h for h in heads if h))[:6],
        "stylesheets": hrefs,
        "n_elements": len(d.elements()),
        "n_external": len(sheets),
        "n_stylesheets": len(sheets) + len(styles),
        "n_images": len(d.select("img[src], picture source[srcset], svg image")),
        "n_scripts": len(d.select("script")),
        "n_style_elements": len(styles),
        "n_style_attributes": len(d.select("[style]")),
        "styles": [s for s in (n.text() for n in styles) if s.strip()],
        "style_attributes": [n.get("style") for n in d.select("[style]") if n.get("style").strip()],
        "assets": list(assets),
        "links": [n.get("href") for n in d.select("a[href]")],
        "css_files": local_sheets(path, hrefs) if path is not None else [],
    }


def page_facts(pages: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """HTM1, HTM2, HTM5 to HTM9 of parsed documents: one parse a page, one row a page (``FACTS``, and the columns ``carry``).

    Pages are dealt to tasks by page_id first, since a table of pages may be one file, which would be one task.
    Where pages have a ``path``, ``css_files`` (HTM6) are the files of their sheets.
    """
    path = [F.col("path") if "path" in pages.columns else F.lit(None).cast("string")]
    rows = pages.repartition("page_id").select("page_id", "url", "html", path[0].alias("_path"), *[F.col(c).alias(f"_{k}") for k, c in enumerate(carry)])
    names = [c.split()[0] for c in FACTS.split(", ")]
    kinds = "".join(f", {c} {pages.schema[c].dataType.simpleString()}" for c in carry)

    def facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            found = pd.DataFrame([facts_of(*r) for r in part.iloc[:, :4].itertuples(index=False)], columns=names)
            yield found.assign(**{c: part[f"_{k}"].to_numpy() for k, c in enumerate(carry)})

    return map_in_slices(rows, facts, FACTS + kinds)


def asset_urls(pages: DataFrame) -> DataFrame:
    """HTM2: ``page_id, asset_seq, asset_url`` each once a page, in order of discovery."""
    return page_facts(pages).select("page_id", F.posexplode("assets").alias("asset_seq", "asset_url"))


def html_stats(pages: DataFrame) -> DataFrame:
    """AGG7: one row of sums over pages."""
    names = {"elements": "n_elements", "external_stylesheets": "n_external", "inline_style_elements": "n_style_elements", "inline_style_attributes": "n_style_attributes"}
    return page_facts(pages).agg(F.count(F.lit(1)).alias("pages"), *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in names.items()])


def css_sources(pages: DataFrame) -> DataFrame:
    """HTM9 of parsed documents: ``page_id, source_seq, css``; style elements, then attributes as rules of ``x``."""
    both = F.concat("styles", F.transform("style_attributes", lambda s: F.concat(F.lit("x{"), s, F.lit("}"))))
    return page_facts(pages).select("page_id", F.size("styles").alias("_n"), F.posexplode(both).alias("source_seq", "css")).select("page_id", "source_seq", "css", (F.col("source_seq") >= F.col("_n")).alias("is_attribute"))


CSS_ROWS = "page_id bigint, source_seq int, kind string, rule_seq int, decl_seq int, selector string, media string, prop string, value string"


def css_rows(sources: DataFrame) -> DataFrame:
    """CSS1 to CSS4: rules, declarations and media queries of sheets (``page_id, source_seq, css``); broken sheets have none."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for sheets in batches:
            out = [(p, s, *row) for p, s, text in sheets.itertuples(index=False) for row in css.rows(text or "")]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CSS_ROWS.split(", ")]).astype({"rule_seq": "Int32", "decl_seq": "Int32"})

    return map_in_slices(sources.select("page_id", "source_seq", "css"), read, CSS_ROWS)


def css_references(sheets: DataFrame) -> DataFrame:
    """HTM3: ``sheet_url, kind, ref_seq, url`` (kind ``asset`` or ``import``) of sheets (``sheet_url, css``)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for url, text in rows.itertuples(index=False):
                for kind, refs in zip(("asset", "import"), css.references(text or ""), strict=True):
                    out += [(url, kind, k, r) for k, r in enumerate(dict.fromkeys(r for r in (resolved(x, url, skip_fragments=False) for x in refs) if r))]
            yield pd.DataFrame(out, columns=["sheet_url", "kind", "ref_seq", "url"])

    return map_in_slices(sheets.select("sheet_url", "css"), read, "sheet_url string, kind string, ref_seq int, url string")


def import_closure(roots: DataFrame, responses: DataFrame, max_assets: int = 500, max_depth: int = 5) -> DataFrame:
    """J8, J9: ``page_id, url, css_depth, seq``: what a page's assets (``page_id, asset_seq, asset_url``) lead to.

    Sheets among ``responses`` (``url, content_type, body``) are followed breadth-first; an import is one deeper than its
    sheet, other references as deep; sheets deeper than ``max_depth`` aren't followed. Only found responses count, each
    once, and ``max_assets`` of them at most a page, in order of discovery.
    """
    known = responses.select("url", "content_type", F.col("body").cast("string").alias("css"))
    path = F.lower(F.regexp_extract("url", r"^[^?]*", 0))
    sheets = known.where(F.coalesce(F.lower("content_type").contains("text/css"), F.lit(False)) | path.endswith(".css"))
    refs = css_references(sheets.select(F.col("url").alias("sheet_url"), "css"))
    # imports come before assets in the order of discovery; written, so that every sheet is parsed once for all steps and pages
    refs = written(refs.withColumn("at", F.when(F.col("kind") == "import", F.col("ref_seq")).otherwise(F.col("ref_seq") + (1 << 20))), "references")
    known = written(known.select("url"), "responses")
    level = roots.select("page_id", F.col("asset_url").alias("url"), F.lit(0).alias("css_depth"), F.array(F.col("asset_seq").cast("long")).alias("order"))
    found = None
    # assets of a sheet may be sheets again at the same depth, so a level is a step of discovery; each url is met once a
    # page, and a page that has max_assets goes no further: at most max_assets steps
    while True:
        first = Window.partitionBy("page_id", "url").orderBy("order")
        level = level.join(known, "url", "left_semi").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
        if found is not None:
            level = level.join(found.select("page_id", "url"), ["page_id", "url"], "left_anti")
        level = written(level, "level")
        if level.isEmpty():
            break
        found = level if found is None else found.unionByName(level)
        full = found.groupBy("page_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= max_assets)
        step = level.join(full, "page_id", "left_anti").where(F.col("css_depth") <= max_depth).join(refs.withColumnRenamed("url", "to"), level.url == F.col("sheet_url"))
        level = step.select("page_id", F.col("to").alias("url"), (F.col("css_depth") + (F.col("kind") == "import").cast("int")).alias("css_depth"), F.concat("order", F.array(F.col("at").cast("long"))).alias("order"))
    if found is None:
        found = level.limit(0)
    # breadth-first: shorter ways first, then by place
    seq = F.row_number().over(Window.partitionBy("page_id").orderBy(F.size("order"), "order")) - 1
    return found.withColumn("seq", seq).where(F.col("seq") < max_assets).select("page_id", "url", "css_depth", "seq")
