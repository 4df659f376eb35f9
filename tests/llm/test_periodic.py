"""Periodic runs against a plain search, and the report against a plain version."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from pageloom.llm import periodic as P

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string"


def plain_runs(words, least=6, exponent=4):
    """All runs: for each period the stretches in which words that far apart are equal, smallest periods only."""
    n, out = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, exponent * q) and not any(all(words[k] == words[k + d] for k in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def words_of(rng):
    kinds = rng.choice([1, 2, 2, 3, 5])
    words = [rng.randrange(kinds) for _ in range(rng.randint(0, 60))]
    for _ in range(rng.randint(0, 2)):
        unit = [rng.randrange(3) for _ in range(rng.randint(1, 9))]
        at = rng.randint(0, len(words))
        words = words[:at] + unit * rng.randint(2, 7) + unit[: rng.randint(0, len(unit))] + words[at:]
    return words


@pytest.mark.parametrize(("least", "exponent"), [(6, 4), (2, 2), (3, 3)])
def test_runs_equal_search(least, exponent):
    rng = random.Random(least)
    for _ in range(120):
        texts = [words_of(rng) for _ in range(rng.randint(1, 6))]
        codes, ends = np.array([w for t in texts for w in t], np.int64), np.cumsum([len(t) for t in texts])
        found = list(zip(*[x.tolist() for x in P.runs_of(codes, ends, least, exponent)], strict=True))
        assert found == [(i, *r) for i, t in enumerate(texts) for r in plain_runs(t, least, exponent)]


def test_repeats_of_repeats():
    """Words whose runs nest and overlap: Fibonacci words have about a run a word."""
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    found = list(zip(*[x.tolist() for x in P.runs_of(np.array(b), np.array([len(b)]), 2, 2)], strict=True))
    assert [r[1:] for r in found] == plain_runs(b, 2, 2) and len(found) > 200


def plain_report(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    kept = " ".join(w for k, w in enumerate(words) if k not in gone)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    digests = [hashlib.sha256(x.encode()).hexdigest() for x in (listed, kept)]
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *digests)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_report_equals_plain(spark):
    rng = random.Random(7)
    spell = lambda words: "".join(f"{'été x Y7 .'.split()[w % 4]}{rng.choice([' ', ' ', chr(10), chr(9) + ' '])}" for w in words)
    rows = [(k, spell(words_of(rng))) for k in range(400)] + [(401, None), (402, ""), (403, " \n\t"), (None, "a b " * 9), (3, "z " * 50), (3, "z " * 50)]
    tenth = [k for k, _ in rows if k is not None and zlib.crc32(str(k).encode()) % 10 == 0]
    assert len(tenth) > 25
    table = spark.createDataFrame(rows, SCHEMA)
    wanted = sorted((plain_report(*r) for r in rows), key=repr)
    assert rows_of(P.runs_report(table)) == wanted
    assert any(r[1] > 1 for r in wanted)
    extra = table.selectExpr("doc_id", "text", "1 as _h", "'x' as runs", "2 as _words")
    assert rows_of(P.runs_report(extra)) == wanted
    assert P.with_repeats(extra).columns == extra.columns


def test_hashed_texts_without_words(spark):
    """A tenth of all texts is repeated, and some of these have no words."""
    tenth = [k for k in range(200) if zlib.crc32(str(k).encode()) % 10 == 0]
    rows = [(k, ("", " \n\t", None)[i % 3]) for i, k in enumerate(tenth)] + [(None, ""), (1, "a b")]
    assert len(tenth) > 10
    assert rows_of(P.runs_report(spark.createDataFrame(rows, SCHEMA))) == sorted((plain_report(*r) for r in rows), key=repr)


def test_long_and_empty(spark):
    assert P.runs_report(spark.createDataFrame([], SCHEMA)).count() == 0
    unit = [f"w{k * k % 997}" for k in range(3000)]
    row = P.periodic_runs(spark.createDataFrame([(1, " ".join(unit * 6 + ["end"] * 100_000))], SCHEMA)).first()
    assert [tuple(r) for r in row.runs][-1] == (18_000, 100_000, 1)
    assert row.collapsed.split().count("end") == 1
