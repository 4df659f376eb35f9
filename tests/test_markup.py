"""Trees of markup that is left open, nested wrongly or loose in tables, as browsers build them."""

import random

import pytest

from pageloom.functions import dom

#: A document's body, by its markup.
BODIES = {
    "<p><b>a<br><p>c<p>d": "<p><b>a<br></b></p><p><b>c</b></p><p><b>d</b></p>",
    "<table><tr><td>x": "<table><tbody><tr><td>x</td></tr></tbody></table>",
    "<table><b>x<tr><td>y</table>z": "<b>x</b><table><tbody><tr><td>y</td></tr></tbody></table><b>z</b>",
    "<a href=1>x<a href=2>y": '<a href="1">x</a><a href="2">y</a>',
    "<b><i>x</b>y</i>z": "<b><i>x</i></b><i>y</i>z",
    "<b>1<p>2</b>3</p>": "<b>1</b><p><b>2</b>3</p>",
    "<p>1<div>2</p>3": "<p>1</p><div>2<p></p>3</div>",
    "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>": "<ul><li>a</li><li>b<ul><li>c</li></ul></li><li>d</li></ul>",
    "<dl><dt>a<dd>b<dt>c": "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>",
    "<select><option>a<option>b<optgroup><option>c</select>d": "<select><option>a</option><option>b</option><optgroup><option>c</option></optgroup></select>d",
    "<table>text<tr><td>1<td>2<tr><th>3</table>": "text<table><tbody><tr><td>1</td><td>2</td></tr><tr><th>3</th></tr></tbody></table>",
    "<table> <tr> <td>1</table>": "<table> <tbody><tr> <td>1</td></tr></tbody></table>",
    "<table><caption>c<tr><td>x": "<table><caption>c</caption><tbody><tr><td>x</td></tr></tbody></table>",
    "<table><col><col><tr><td>": "<table><colgroup><col><col></colgroup><tbody><tr><td></td></tr></tbody></table>",
    "<table><thead><tr><td>a<tbody><td>b<tfoot>": "<table><thead><tr><td>a</td></tr></thead><tbody><tr><td>b</td></tr></tbody><tfoot></tfoot></table>",
    "<table><table><tr><td>x": "<table></table><table><tbody><tr><td>x</td></tr></tbody></table>",
    "<h1>a<h2>b</h1>c": "<h1>a</h1><h2>b</h2>c",
    "<button>a<button>b": "<button>a</button><button>b</button>",
    "<nobr>a<nobr>b": "<nobr>a</nobr><nobr>b</nobr>",
    "<p>a</b>b": "<p>ab</p>",
    "</br>x</p>y": "<br>x<p></p>y",
    "<svg><path/><g></svg><p>x": "<svg><path></path><g></g></svg><p>x</p>",
    "<svg><p>x": "<svg></svg><p>x</p>",
    "<svg><style>a>b</style></svg>": "<svg><style>a>b</style></svg>",
    "<b><b><b><b>x</b></b></b></b>y": "<b><b><b><b>x</b></b></b></b>y",
    "<p><b><b><b><b><p>x": "<p><b><b><b><b></b></b></b></b></p><p><b><b><b>x</b></b></b></p>",
    "<a><p>x</a>y": "<a></a><p><a>x</a>y</p>",
    "<div><a>x<div>y</a>z": "<div><a>x</a><div><a>y</a>z</div></div>",
    "<table><tr><td><table><tr><td>x</table>y</table>z": "<table><tbody><tr><td><table><tbody><tr><td>x</td></tr></tbody></table>y</td></tr></tbody></table>z",
    "<form><form>x</form>y": "<form>x</form>y",
    "<li>a<p>b<li>c": "<li>a<p>b</p></li><li>c</li>",
    "<table><tr><p>x<td>y": "<p>x</p><table><tbody><tr><td>y</td></tr></tbody></table>",
    "<!doctype html><p>a<table><tr><td>x": "<p>a</p><table><tbody><tr><td>x</td></tr></tbody></table>",
    "<p>a<table><tr><td>x": "<p>a<table><tbody><tr><td>x</td></tr></tbody></table></p>",
    "<ruby>a<rt>b<rt>c</ruby>": "<ruby>a<rt>b</rt><rt>c</rt></ruby>",
    "<b>a<table><td>b</b>c": "<b>a<table><tbody><tr><td>bc</td></tr></tbody></table></b>",
    "<font><p>a</font>b": "<font></font><p><font>a</font>b</p>",
    "<table><input type=hidden name=a><input name=b>": '<input name="b"><table><input type="hidden" name="a"></table>',
    "<object><b>x</object>y": "<object><b>x</b></object>y",
    "<pre>\n\nx</pre>": "<pre>\nx</pre>",
    "<p>a<hr>b": "<p>a</p><hr>b",
    "<textarea>a<b>&lt;</textarea>c": "<textarea>a&lt;b&gt;&lt;</textarea>c",
    "<iframe><p>a</iframe>b": "<iframe><p>a</iframe>b",
    "<svg><title>a<b>c": "<svg><title>a<b>c</b></title></svg>",
    "<image src=a>": '<img src="a">',
    "<body a=1><body a=2 b=3>x": "x",
    "x</body>y<!--c--></html> ": "xy<!--c--> ",
    "<cite><b><cite><i><cite><i>x</cite></b>y": "<cite><b><cite><i><cite><i>x</i></cite></i></cite></b><i><i>y</i></i></cite>",
}


@pytest.mark.parametrize("markup", BODIES)
def test_body(markup):
    body = dom.parse(markup).first("body")
    assert body.html() == "<body" + (' a="1" b="3"' if "b=3" in markup else "") + f">{BODIES[markup]}</body>"


def test_head():
    d = dom.parse("<!doctype html>\n<title>a</title><meta charset=x><noscript><link href=n></noscript>\n<p>b<title>c</title>")
    assert d.html() == '<!doctype html><html><head><title>a</title><meta charset="x"><noscript><link href="n"></noscript>\n</head><body><p>b<title>c</title></p></body></html>'
    d = dom.parse("<html lang=en><head><title>a</title></head><link rel=x><body class=y>z")
    assert d.html() == '<html lang="en"><head><title>a</title><link rel="x"></head><body class="y">z</body></html>'
    assert dom.parse("").html() == "<html><head></head><body></body></html>"


def test_any_markup_gives_a_tree():
    """Trees of random markup are whole: parents and children agree, text is kept in some order, and a second parse changes
    only what serialising can't say."""
    rng = random.Random(3)
    tags = "a b i p div table tr td th tbody caption col select option li ul h1 svg path button form span nobr template br input hr title style".split()
    for _ in range(1500):
        parts = [rng.choice([f"<{t}>", f"<{t}>", f"</{t}>", f"w{k} ", f"<{t} x={k}>", "<!--c-->"]) for k, t in enumerate(rng.choices(tags, k=rng.randint(1, 25)))]
        d = dom.parse("".join(parts))
        todo, seen = [d], set()
        while todo:
            node = todo.pop()
            assert id(node) not in seen
            seen.add(id(node))
            for child in node.children:
                assert child.parent is node
                todo.append(child)
        assert [n.tag for n in d.children if n.tag[0] != "#"] == ["html"]
        assert [n.tag for n in d.first("html").children if n.tag in ("head", "body")] == ["head", "body"]
        again = dom.parse(d.html())
        assert dom.parse(again.html()).html() == dom.parse(dom.parse(again.html()).html()).html()


def test_deep_and_long_markup():
    assert sum(1 for _ in dom.parse("<div>" * 3000 + "x").elements()) == 3003
    assert sum(1 for _ in dom.parse("<b><p>x" * 300).elements()) == 3 + 300 + 300 + sum(min(3, k) for k in range(300))
