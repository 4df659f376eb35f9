"""Table functions for SQL: ``SELECT ... FROM pages, LATERAL page_links(html, url)``."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from . import css, dom
from .urls import Url, resolved


class PageLinks:
    """HTM1: anchors of a document with http(s) targets, each target once, in order."""

    def eval(self, html: str, url: str):
        seen = set()
        try:
            base = Url(url or "")
        except ValueError:
            return
        for seq, node in enumerate(dom.parse(html or "").select("a[href]")):
            href = node.get("href")
            target = resolved(href, url)
            if target is None:
                continue
            absolute = str(base.join(href))
            if absolute not in seen:
                seen.add(absolute)
                yield seq, href, absolute, target


class SheetReferences:
    """HTM3: what a sheet names, imports and other references apart, each once, in order."""

    def eval(self, sheet: str, url: str):
        for kind, refs in zip(("asset", "import"), css.references(sheet or ""), strict=True):
            found = (resolved(r, url or "", skip_fragments=False) for r in refs)
            yield from ((kind, k, r) for k, r in enumerate(dict.fromkeys(r for r in found if r)))


class SheetRows:
    """CSS1 to CSS4: rules, declarations and media queries of a sheet; a broken one has none."""

    def eval(self, sheet: str):
        yield from css.rows(sheet or "")


#: Name in SQL, function, columns.
TABLES = (
    ("page_links", PageLinks, "link_seq int, href string, absolute string, normalized string"),
    ("sheet_references", SheetReferences, "kind string, ref_seq int, url string"),
    ("sheet_rows", SheetRows, "kind string, rule_seq int, decl_seq int, selector string, media string, prop string, value string"),
)


def register_tables(spark: SparkSession) -> None:
    """Makes the table functions known to the session's SQL. Rows cross to the workers pickled, many at once: an Arrow table
    function makes a table of its own of each row's few results."""
    for name, function, columns in TABLES:
        spark.udtf.register(name, udtf(function, returnType=columns, useArrow=False))
