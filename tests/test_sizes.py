"""What keeps tasks, workers and the driver small on large tables, and results the same."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pageloom import queries as Q
from pageloom.functions import dom, tables
from pageloom.operators import crawl, extract, rewrite, tokens
from pageloom.plans import context
from pageloom.sources.slices import SLICE_ROWS, map_in_slices

SF = "/root/testdata/sf0.001"
PAGE = '<title>a &amp;&amp</title><h1>b&amp</h1><style>h1,h2{font-size:1px} p{margin:0}</style><img src="/x.png"><a href="y">z</a>'
PLACE = "struct<page_id:bigint,source_seq:int,rule_seq:int,decl_seq:int,token_seq:int>"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def passes(df):
    """Python steps in a plan."""
    return plan(df).count("MapIn")


def pages(spark, n=3):
    return spark.createDataFrame([(k, f"https://a.org/{k}", PAGE) for k in range(n)], "page_id bigint, url string, html string")


def test_context_from_markup(spark):
    rows = pages(spark, 1).selectExpr("*", "'p/index.html' as path", "1 as depth", "200 as status", "'text/html' as content_type")
    read = lambda **k: context.page_context(rows, **k).select("title", F.array_join("headings", "|")).first()
    assert tuple(read(from_markup=True)) == ("a &&amp", "b&amp")
    assert tuple(read()) == ("a &&", "b&")


def test_the_first_spelling_of_any_place(spark):
    rng = random.Random(3)
    near = lambda: (rng.randrange(-2, 3), rng.randrange(2), rng.randrange(2), rng.randrange(2), rng.randrange(1000))
    far = lambda: tuple(rng.choice([None, x, 2**31 - 1, -1]) for x in near()[1:])
    ends = [(p, *near()[1:]) for p in (-(2**63), 2**63 - 1, 2**63 - 2)]
    for _ in range(3):
        spots = [near() for _ in range(60)] + [(rng.choice([None, 0, 1]), *far()) for _ in range(20)] + ends
        rows = [("font_family", "".join(rng.choice([c, c.upper()]) for c in rng.choice(["ab", "xy", "é"])), p) for p in dict.fromkeys(spots)] + [("color_all", "AB", near()), ("color_all", "ab", near())]
        first = {}
        for c, key, at in sorted(rows, key=lambda r: [(x is not None, x or 0) for x in r[2]]):
            first.setdefault((c, key.lower() if c == "font_family" else key), key)
        found = tokens.count_tokens(spark.createDataFrame(rows, f"category string, key string, place {PLACE}"))
        assert {(r.category, r.value) for r in found.collect()} == {(c, v) for (c, _), v in first.items()}
        assert found.agg(F.sum("n")).first()[0] == len(rows)


def test_tokens_are_counted_by_hash(spark):
    found = plan(Q.length_tokens_synthetic(spark, SF))
    lowest = [line for line in found.split("== Initial Plan ==")[0].splitlines() if "Aggregate(" in line][-1]
    assert "HashAggregate(" in lowest and "hashpartitioning(p_partkey" in found


def test_slices_are_small_and_exact(spark):
    rows = spark.range(3000, numPartitions=1).selectExpr("if(id = 5, null, 9007199254740993 + id) as page_id", "array(named_struct('a', id, 'b', cast('x' as binary))) as known")

    def make(parts):
        for part in parts:
            assert len(part) <= SLICE_ROWS
            yield pd.DataFrame([(i, k[0]["a"], bytes(k[0]["b"])) for i, k in part.itertuples(index=False)], columns=["page_id", "a", "b"], dtype=object)

    found = map_in_slices(rows, make, "page_id bigint, a bigint, b binary").collect()
    assert sorted((r.a, r.page_id, r.b) for r in found) == [(k, None if k == 5 else 9007199254740993 + k, b"x") for k in range(3000)]


def test_pages_are_dealt_and_sliced(spark):
    """A table of pages in one file isn't one task."""
    p = pages(spark)
    known = spark.createDataFrame([("https://a.org/x.png", "x.png")], "norm_url string, path string")
    for df in (extract.page_facts(p), rewrite.rewrite_pages(p.withColumn("path", F.lit("i.html")), known)):
        assert "hashpartitioning(page_id" in plan(df) and "MapInArrow" in plan(df) and "MapInPandas" not in plan(df)
    sheets = spark.createDataFrame([("https://a.org/s.css", "s.css", "a{background:url(x.png)}")], "url string, path string, css string")
    made = rewrite.rewrite_sheets(sheets, known)
    assert "REPARTITION_BY_COL" in plan(made) and made.first().css == "a{background:url(x.png)}"


def test_pages_are_parsed_once(spark):
    p = pages(spark)
    css = extract.css_rows(extract.css_sources(p))
    assert passes(tokens.selector_stats(css)) == passes(css)
    assert tuple(tokens.selector_stats(css).first())[:3] == (6, 9, 9)
    assert tuple(tokens.selector_stats(css.limit(0)).first()) == (0,) * 7
    assert passes(tokens.heading_tokens(css)) == 0
    assert passes(Q.uncaptured_assets(spark, SF)) == passes(Q.css_imports_closure(spark, SF)) == 0


def test_links_are_not_broadcast(spark, monkeypatch):
    """What a handler returns comes from the links of the level alone, not from a join that could broadcast all links."""
    plans, write = [], crawl.written
    monkeypatch.setattr(crawl, "written", lambda df, what: (plans.append((what, plan(df))), write(df, what))[1])
    Q.crawl_handled(spark, SF)
    handled = [text for what, text in plans if what == "handled"]
    assert handled and not any("customer.parquet" in text for text in handled)


def test_table_functions_are_plain(spark):
    tables.register_tables(spark)
    found = plan(Q.sheet_rows_by_lateral(spark, SF))
    assert "BatchEvalPythonUDTF" in found and "hashpartitioning(p_partkey" in found


@pytest.mark.parametrize("selector", ["*", "a", "a[href]", ".c", "div .c", "#i, p", "[src], img", 'link[rel~="x"][href], p *', "ul li a"])
def test_an_index_selects_like_its_document(selector):
    d = dom.parse('<ul><li class=c><a href=1>x</a><p id=i><b>y</b><link rel="x z" href=2></ul><div><img src=1><p class="c d">z<a>w</a></div>')
    assert dom.Index(d).select(selector) == d.select(selector)
    assert dom.Index(d).elements() == list(d.elements())
