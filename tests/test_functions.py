import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pageloom.functions import css, css_tokens as T, dom, text as X, urls as U
from pageloom.functions.options import Options, at_least, parse_arguments, parse_int_option
from pageloom.operators import rewrite
from pageloom.operators.scope import glob_to_regex, in_scope

URLS = [
    ("https://example.com/path/#section", "https://example.com/path"),
    ("HTTP://Example.COM:80/a/../b/./c/?q=1#f", "http://example.com/b/c?q=1"),
    ("https://h.com:443", "https://h.com/"),
    ("https://h.com:8443/x//", "https://h.com:8443/x/"),
    ("http://h.com/für, x", "http://h.com/f%C3%BCr,%20x"),
    ("http:\\\\h.com\\a", "http://h.com/a"),
    ("http://h.com/?", "http://h.com/"),
    ("ftp://h.com/", None),
    ("nonsense", None),
    ("", None),
]


def test_normalize_url(evaluate):
    assert evaluate(U.normalize_url, *[u for u, _ in URLS]) == [n for _, n in URLS]
    assert [U.normalized(u) for u, _ in URLS] == [n for _, n in URLS]


REFERENCES = [
    ("../x?q#f", "https://a.b/c/d/e", "https://a.b/c/x?q"),
    ("//o.com/p/", "https://a.b/", "https://o.com/p"),
    ("/r", "https://a.b:99/c", "https://a.b:99/r"),
    ("?z", "http://h/p/q?r", "http://h/p/q?z"),
    ("#top", "http://h/p", None),
    ("mailto:x@y", "http://h/", None),
    ("data:,", "http://h/", None),
    ("x/./y/..", "http://h/p/q", "http://h/p/x"),
    ("", "http://h/", None),
]


def test_resolve_url(evaluate):
    got = evaluate(U.resolve_url, *[(v, b) for v, b, _ in REFERENCES], schema="v string, b string")
    assert got == [r for *_, r in REFERENCES]
    assert [U.resolved(v, b) for v, b, _ in REFERENCES] == got
    assert U.resolved("#top", "http://h/p", skip_fragments=False) == "http://h/p"


@settings(max_examples=200, deadline=None)
@given(st.from_regex(r"https?://[a-z]{1,5}\.com(/[a-zA-Z%ü ]{1,5}){0,4}/?(\?[a-z=&]{0,6})?(#[a-z]{0,3})?", fullmatch=True))
def test_normalize_is_idempotent(url):
    once = U.normalized(url)
    assert once is not None and U.normalized(once) == once


def test_column_and_python_urls_agree(evaluate):
    made = [f"http{s}://{h}{p}{q}" for s in ("", "s") for h in ("A.com", "b.org:80", "u@c.net") for p in ("", "/", "/x/../y/", "/ä/%2e/z") for q in ("", "?", "?a b#c")]
    assert evaluate(U.normalize_url, *made) == [U.normalized(u) for u in made]


def test_paths(evaluate):
    page = lambda u: U.page_path(u, "example.com")
    assert evaluate(page, "https://example.com/", "https://example.com/a b/c/", "https://other.org/x?y=1", "no") == [
        "pages/index.html", "pages/a_20b/c/index.html", "pages/other.org/x/__q_" + __import__("hashlib").sha1(b"?y=1").hexdigest()[:10] + "/index.html", None,
    ]
    pairs = [("pages/a/index.html", "pages/b/c.css"), ("pages/index.html", "pages/index.html"), ("a/b/c.html", "x.css"), ("x.html", "y/z.png")]
    got = evaluate(U.relative_path, *pairs, schema="a string, b string")
    assert got == ["../b/c.css", "index.html", "../../x.css", "y/z.png"] == [U.relative(*p) for p in pairs]
    assert evaluate(lambda v: U.safe_join("/srv", v), "/a/b%20c", "/../x", "/a/../b", "/%zz", "/a+b") == ["/srv/a/b c", None, "/srv/b", None, "/srv/a+b"]
    assert evaluate(U.derive_name, "https://www.x.com/y", "bad") == ["x.com", "bad"]
    assert evaluate(lambda v: U.url_and_fragment(v).fragment, "a#b#c", "a") == ["#b#c", ""]
    assert evaluate(U.is_local_relative, "a.css", "/a", "//b", "http://c", "#d", "", "data:,") == [True, False, False, False, False, False, False]


def test_int_option(evaluate):
    assert evaluate(lambda v: parse_int_option(v, 5, 1), None, "abc", "0", "-3", "7", "7abc", "") == [5, 5, 5, 5, 7, 7, 5]


def test_options():
    o = parse_arguments(["https://x.com", "--max-pages", "0", "--scope", "odd", "--single-file", "--no-single-file", "--include", "a", "--include", "b"])
    assert (o.max_pages, o.scope, o.single_file, o.include) == (1, "same-origin", False, ("a", "b"))
    assert [at_least(v) for v in (2.9, -1, float("inf"), float("nan"))] == [2, 1, 1, 1]


def test_globs():
    cases = {
        "https://example.com/blog/**": (["https://example.com/blog/post-1", "https://example.com/blog/a/b", "https://example.com/blog/"], ["https://example.com/shop/x"]),
        "**/draft/**": (["https://example.com/blog/draft/post-2"], ["https://example.com/blog/post"]),
        "https://*.com/{a,b}/?.html": (["https://x.com/a/1.html"], ["https://x.com/c/1.html", "https://x.y/a/1.html"]),
        "a/*.js": (["a/x.js"], ["a/b/x.js", "a/.x.js"]),
        "[!a]b": (["xb"], ["ab"]),
        "@(x|y)+(z)": (["xzz", "yz"], ["z", "xy"]),
    }
    for glob, (good, bad) in cases.items():
        assert all(re.search(glob_to_regex(glob), g) for g in good), glob
        assert not any(re.search(glob_to_regex(glob), b) for b in bad), glob


def test_scope(evaluate):
    same = Options("https://example.com/")
    assert evaluate(lambda v: in_scope(v, same), "https://example.com/about", "https://cdn.example.com/", "ftp://example.com/", None) == [True, False, False, False]
    sub = Options("https://example.com/", scope="subdomains")
    assert evaluate(lambda v: in_scope(v, sub), "http://cdn.example.com:8/x", "https://notexample.com/") == [True, False]
    own = Options("https://example.com/", scope="custom", include=("https://example.com/blog/**",), exclude=("**/draft/**",))
    assert evaluate(lambda v: in_scope(v, own), "https://example.com/blog/post-1", "https://example.com/blog/draft/post-2", "https://example.com/shop/product") == [True, False, False]


def test_text(evaluate):
    both = "u string, c string"
    assert evaluate(X.asset_kind, ("a.css?x", None), ("a.css", "image/png"), ("a.MJS", None), ("a.woff2", ""), ("a", "text/html"), ("a", "application/javascript"), schema=both) == ["css", "img", "other", "other", None, "other"]
    assert evaluate(lambda u, c: X.mime_type(c, u), ("a.png?x", None), ("a", " text/css ; q"), ("a", None), schema=both) == ["image/png", "text/css", "application/octet-stream"]
    assert evaluate(lambda u, c: X.file_extension(c, u), ("http://h/a.b", "image/jpeg"), ("http://h/x/a.b?c", "odd/type"), ("http://h/a", None), schema=both) == [".jpg", ".b", ""]
    assert evaluate(lambda v: X.data_url(v.cast("binary"), X.F.lit("text/plain")), "x" * 100)[0] == "data:text/plain;base64," + __import__("base64").b64encode(b"x" * 100).decode()
    assert evaluate(X.normalize_text, " a\xa0\n b﻿") == ["a b"]
    assert evaluate(X.escape_html, '<a href="x">&') == ["&lt;a href=&quot;x&quot;&gt;&amp;"]
    assert evaluate(X.yaml_string, "a-b", "true", 'a"b\\', "#fff") == ["a-b", '"true"', '"a\\"b\\\\"', '"#fff"']
    assert evaluate(X.is_placeholder_src, "", "#", "data:image/gif;x", "a.png", "data:image/png;" + "x" * 3000, None) == [True, True, True, False, False, True]


def test_colors(evaluate):
    got = evaluate(T.color_tokens, "#abc", "#abcd", "#AABBCCDD", "rgb(255 0 0)", "rgba(0,0,0,0)", "rgba(1,2,3,.5)", "hsl(1, 2%, 3%)", "url(#fff)", "var(--x)", "rgb(300,-5,1.5) red")
    assert got == [["#aabbcc"], ["#aabbcc"], ["#aabbcc"], [], [], ["#010203"], ["hsl(1,2%,3%)"], [], [], ["#ff0002"]]


def test_lengths(evaluate):
    assert evaluate(T.length_tokens, "1.5rem", "-0.5em", "calc(100% - 10px)", "var(--s-4)") == [["1", ".5rem"], ["0", ".5em"], ["100%", "10px"], ["-4"]]
    assert evaluate(lambda v: T.length_tokens(v, strict=True), "1.5rem -0.5em") == [["1.5rem", "-0.5em"]]


def test_fonts(evaluate):
    got = evaluate(T.font_shorthand, 'italic bold 16px/1.5 "Open Sans", serif', "12px Arial", "inherit")
    assert [(g and (g["size"], g["line_height"], g["weight"], g["families"])) for g in got] == [("16px", "1.5", "bold", ["Open Sans", "serif"]), ("12px", None, None, ["Arial"]), None]
    assert evaluate(T.family_list, "'Times', var(--f, x), inherit, FontAwesome, A  B") == [["serif", "x)", "A B"]]


def test_breakpoints_and_selectors(evaluate):
    assert evaluate(T.breakpoints, "(MIN-width: 40em) and (max-width:768px)") == [["min-width 40em", "max-width 768px"]]
    assert evaluate(T.breakpoint_number, "base", "viewport <= 480px", "@media (max-width: 10em)", "print") == [-1.0, 480.0, 160.0, float("inf")]
    assert evaluate(T.selector_headings, "h1", ".a>h2.b", "thh3", "h1,h1:hover") == [["h1"], ["h2"], [], ["h1"]]
    assert evaluate(lambda v: T.selector_features(v)["class_selectors"], ".a .b#c") == [2]


def test_report_values(evaluate):
    assert evaluate(T.normalize_dimension, "0", "1PX", "3", "5%") == ["0px", "1px", "3px", None]
    assert [v and v["text"] for v in evaluate(T.normalize_line_height, "normal", "1.5", "20px", "2")] == [None, "1.5", "20px", "2"]
    assert evaluate(T.normalize_report_weight, "bold", "normal", "450", "600") == ["700", "400", None, "600"]
    assert evaluate(T.is_near_neutral, "#fefefe", "#ff0000", "hsl(1,2%,3%)") == [True, False, True]


def test_css_reader():
    rows = list(css.rows("@font-face{font-family:x} @media screen{ .a, h1{margin:0;/* c */color:red !important} } .b{ &:hover{top:1px} } "))
    assert [r[3:] for r in rows if r[0] == "decl"] == [
        (".a, h1", "@media screen", "margin", "0"), (".a, h1", "@media screen", "color", "red"), (".b", "base", "top", "1px"), ("&:hover", "base", "top", "1px"),
    ]
    for broken in ("a{", "a}", "a{b:c}}", "/* x"):
        with pytest.raises(css.BrokenCss):
            css.parse(broken)
    assert css.references("a{b:url(x)") == (["x"], [])


def test_dom_round_trip():
    d = dom.parse('<p class="a b">x<b>y</p><img src=1><script>if(a<b){}</script>')
    assert d.html() == '<html><head></head><body><p class="a b">x<b>y</b></p><b><img src="1"><script>if(a<b){}</script></b></body></html>'
    assert dom.parse(d.html()).html() == d.html()
    assert len(d.select("p.a.b b")) == 1 and not d.select("b p")


def test_selectors_by_index_find_what_a_plain_walk_finds():
    d = dom.parse(
        '<div id="klaro" class="a b"><p class="b" title="">x<a href="/y" CLASS="cc-banner">y</a></p></div><p>z</p>'
        '<template id="brlbs-1"></template><div id="brlbs-2" aria-label="Our COOKIES" lang="en-GB"></div>'
    )
    several = ("*", "p", "div p a", "html, body", ".b", "p.b, .a", "#klaro", "a[href]", '[class*="banner"]', 'template[id^="brlbs-"]', '[aria-label*="cookie" i]', '[lang|="en"]', '[href$="y"], p', '[title=""]', '[title*=""]')
    for selector in several:
        assert d.select(selector) == [n for n in d.elements() if any(dom.matches(n, c) for c in dom.compiled(selector))], selector
    assert [len(d.select(s)) for s in ('template[id^="brlbs-"]', '[aria-label*="cookie" i]', '[title=""]', '[title*=""]', "p.b, .a")] == [1, 1, 1, 0, 2]


def test_consent_goes_with_all_that_is_in_it():
    d = dom.parse('<body class="x"><div class="klaro"><p id="klaro">a</p><b>b</b></div><p>c</p><i class="modal-backdrop">d</i></body>')
    rewrite.strip_consent(d)
    assert [n.tag for n in d.first("body").elements()] == ["p"]
    assert d.first("p").text() == "c"
