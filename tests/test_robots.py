import random
import re

from pageloom.functions.robots import RuleTrie, rules_of
from pageloom.operators import crawl


def plain(rules, path):
    """Every pattern as an expression; the longest, then the kinder."""
    best = (0, True)
    for pattern, allow in rules:
        ends = pattern.endswith("$")
        steps = "".join(".*" if c == "*" else re.escape(c) for c in (pattern[:-1] if ends else pattern))
        if pattern and re.match(steps + ("$" if ends else ""), path):
            best = max(best, (len(pattern), allow))
    return best[1]


def test_trie_against_every_pattern():
    rng = random.Random(4)
    text = lambda n, letters: "/" + "".join(rng.choice(letters) for _ in range(rng.randint(0, n)))
    for _ in range(300):
        rules = [(text(5, "ab/*$.?"), rng.random() < 0.5) for _ in range(rng.randint(0, 12))]
        trie = RuleTrie(rules)
        for _ in range(30):
            path = text(8, "ab/.?$")
            assert trie.allows(path) == plain(rules, path), (rules, path)


def test_rules_of():
    text = "# x\nUser-agent: A\nuser-agent: b\nDisallow: /x # no\nAllow:/y\nUser-agent: c\nDisallow:\nSitemap: /s\nnonsense"
    assert list(rules_of(text)) == [("a", False, "/x"), ("b", False, "/x"), ("a", True, "/y"), ("b", True, "/y"), ("c", False, "")]


def test_filter(spark):
    """One origin with many addresses and rules, groups by agent, origins without a file, nulls and repeated rows."""
    rng = random.Random(9)
    rules = [(f"/{rng.choice('abc')}/{rng.choice(['', '*', '*.x$'])}{k % 40}", rng.random() < 0.4) for k in range(500)]
    body = "User-agent: *\n" + "".join(f"{'Allow' if a else 'Disallow'}: {p}\n" for p, a in rules)
    sites = {
        "https://a.org": body,
        "https://b.org": "User-agent: *\nDisallow: /\nUser-agent: Me\nDisallow: /no\n",
        "https://c.org": "User-agent: *\nDisallow: /\n\nUser-agent: me\nDisallow:\n",
        "https://e.org": None,
    }
    rows = [f"https://a.org/{rng.choice('abcd')}/{rng.randint(0, 60)}{rng.choice(['', '.x', '?q=1'])}" for _ in range(3000)]
    rows += ["https://b.org/yes", "https://b.org/no/1", "https://b.org/no/1", "https://c.org/x", "https://d.org/no", "https://e.org/", None, "nonsense"]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(rows)], "page_id int, url string")
    found = crawl.robots_filter(pages, spark.createDataFrame(list(sites.items()), "origin string, robots_txt string"), "Me/2.0")
    got = {r.page_id: r.allowed for r in found.collect()}
    want = {k: plain(rules, u[len("https://a.org") :]) if u and u.startswith("https://a.org") else u not in ("https://b.org/no/1",) for k, u in enumerate(rows)}
    assert got == want and 100 < sum(not v for v in got.values()) < 2900
    assert crawl.robots_filter(pages.limit(0), spark.createDataFrame([], "origin string, robots_txt string"), "Me").count() == 0
