from pageloom.functions.tables import register_tables
from pageloom.operators import extract

PAGES = [
    (1, "https://a.org/x/y", '<a href="z">1</a><a href="z#t">2</a><a href="mailto:a@b">3</a><a href="/?q=1&amp;r">4</a><a href="z">5</a><a>6</a><a href="">7</a>'),
    (2, "https://a.org/", '<!-- <a href="no"> --><script>"<a href=\'no\'>"</script><A HREF="HTTP://B.org:80/p/">x</A><a href="//c.org">y</a>'),
    (3, "not an address", '<a href="z">1</a>'),
    (4, None, None),
]
SHEET = "@import 'b.css'; @import url(b.css); a{background:url(x.png) url('x.png') , url(data:,a); color:red} @media print{p,q{margin:0}}"


def test_links_from_sql(spark):
    register_tables(spark)
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    pages.createOrReplaceTempView("some_pages")
    found = spark.sql("SELECT page_id, url, l.* FROM some_pages, LATERAL page_links(html, url) AS l")
    want = extract.links(pages)
    assert found.columns == want.columns
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.count() == 5


def test_sheets_from_sql(spark):
    register_tables(spark)
    sheets = spark.createDataFrame([(1, 0, "https://a.org/css/m.css", SHEET), (2, 0, "https://a.org/", "a{"), (3, 0, "https://a.org/", None)], "page_id bigint, source_seq int, url string, css string")
    sheets.createOrReplaceTempView("some_sheets")
    found = spark.sql("SELECT s.url AS sheet_url, r.* FROM some_sheets s, LATERAL sheet_references(s.css, s.url) AS r")
    want = extract.css_references(sheets.select(sheets.url.alias("sheet_url"), "css"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.count() > 1
    rows = spark.sql("SELECT page_id, source_seq, r.* FROM some_sheets, LATERAL sheet_rows(css) AS r")
    assert sorted(map(tuple, rows.collect()), key=str) == sorted(map(tuple, extract.css_rows(sheets).collect()), key=str) and rows.count() > 2
