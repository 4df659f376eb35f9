"""Secret scans: fixed patterns, and a battery of randomness tests for tokens that no pattern names.

A candidate is a long run of code-like characters. Its encoding is inferred (digits, hex, letters, base32, letters and
digits, base64), and three tests are taken in two directions. Against "random": uniformity of its alphabet
(chi-squared), number of runs, and serial correlation; a counter or a repeated character fails some badly and is no
candidate for a discovery. Against "ordinary text": chi-squared of its letters, runs of its classes of characters and
serial correlation of its vowels give p-values under a stated null, which are combined (Fisher). False discoveries are
controlled over all candidates of the table (Benjamini-Hochberg on a fixed grid of p-values), with each length class
weighing its own share.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from math import erfc, exp, factorial, lgamma, log, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices, written

#: The base patterns and least lengths.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
KINDS = ("assign", "access", "hex", "random")

_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{%d,}" % HEX_LEAST)  # a run has this length or none of its matches counts
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
_ANY = r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{14}|[0-9a-f]{16}|[A-Za-z0-9+/_-]{20}"

#: Least and largest length of each class of candidates, by its lower end.
LENGTH_CLASSES = (20, 24, 32, 48, 64)
#: Grid of -log10 p: bins of this width, so many of them.
BIN, BINS = 0.05, 400
FALSE_DISCOVERIES = 0.01

#: Encodings by their alphabets, narrowest first.
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = (
    ("digits", _DIGITS),
    ("hex", "0123456789abcdef"),
    ("hex", "0123456789ABCDEF"),
    ("letters", _LOWER),
    ("letters", _UPPER),
    ("base32", _UPPER + "234567"),
    ("base36", _LOWER + _DIGITS),
    ("base36", _UPPER + _DIGITS),
    ("letters", _UPPER + _LOWER),
    ("base62", _UPPER + _LOWER + _DIGITS),
    ("base64", _UPPER + _LOWER + _DIGITS + "+/_-"),
)
_SETS = [(frozenset(a), a) for _, a in ENCODINGS]


def _upper_normal(z: float) -> float:
    return 0.5 * erfc(z / sqrt(2))


def infer_encoding(token: str) -> int:
    """Place of the narrowest encoding that spells the token (base64 at last)."""
    chars = set(token.rstrip("="))
    return next((i for i, (a, _) in enumerate(_SETS) if chars <= a), len(_SETS) - 1)


def bodies(token: str) -> list[str]:
    """What of a token is tested: without padding, signs that join groups (``-`` and ``_``) and the date that leads a
    number; parts between slashes by themselves where base64 would rarely have so many of these. Parts are candidates by
    themselves, so those under LENGTH_CLASSES[0] characters go."""
    token = token.rstrip("=")
    slashes = token.count("/")
    parts = token.split("/") if _at_least(slashes, len(token), 1 / 64) < 0.02 else [token]
    parts = [_DATE.sub("", p) if p.isdigit() else p for p in (re.sub("[-_]", "", p) for p in parts)]
    return [p for p in parts if len(p) >= LENGTH_CLASSES[0]]


def _places(token: str, alphabet: str) -> np.ndarray:
    table = np.zeros(128)
    for i, c in enumerate(alphabet):
        table[ord(c)] = i if len(alphabet) <= 64 else {"-": 62, "_": 63}.get(c, i)  # either spelling of base64
    return table[np.frombuffer(token.encode("ascii"), np.uint8)]


def randomness_tests(token: str) -> tuple[float, float, float]:
    """p-values of chi-squared uniformity, runs and serial correlation if the token were random (small: it is not)."""
    alphabet = _SETS[infer_encoding(token)][1]
    x = _places(token.rstrip("="), alphabet)
    n, k = len(x), min(len(alphabet), 64)
    counts = np.bincount(x.astype(int), minlength=k)
    chi = float(((counts - n / k) ** 2).sum() / (n / k))
    # few expected in a cell: the statistic's own mean and variance under uniformity, one-sided
    mean, var = k - 1.0, 2.0 * (k - 1) * (1 - 1.0 / n)
    uniform = _upper_normal((chi - mean) / np.sqrt(var))
    high = x >= np.median(x)
    n1, n0 = int(high.sum()), int((~high).sum())
    runs = 1 + int((high[1:] != high[:-1]).sum())
    expect = 1 + 2 * n1 * n0 / n
    spread = max(1e-9, 2 * n1 * n0 * (2 * n1 * n0 - n) / (n * n * max(1, n - 1)))
    run_p = 2 * _upper_normal(abs(runs - expect) / np.sqrt(spread))
    d = x - x.mean()
    serial = float((d[1:] * d[:-1]).sum() / max(1e-9, (d * d).sum()))
    serial_p = 2 * _upper_normal(abs(serial + 1 / n) * np.sqrt(n))
    return uniform, min(1.0, run_p), min(1.0, serial_p)


#: The ordinary-text null: letters are drawn by these parts of prose (each at least 0.01, for other languages), the class
#: of characters changes with this probability a character, and so does a letter from vowel to consonant or back.
_PROSE = np.maximum(0.01, np.array([82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1]) / 1000)
ORDINARY = _PROSE / _PROSE.sum()
CLASS_CHANGE, VOWEL_CHANGE = 0.15, 0.6
#: Numbers written as text (counters, dates, amounts) repeat digits or step by one with this probability a digit.
SMOOTH_DIGITS = 0.64
#: A date, and maybe a time, at the start of a number.
_DATE = re.compile(r"(?:19|20)\d\d(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])(?:(?:[01]\d|2[0-3])(?:[0-5]\d){0,2})?")
#: Binomial tails of more trials are taken from the normal distribution.
EXACT_TRIALS = 2000


def _at_least(k: int, n: int, p: float) -> float:
    """Probability of k or more of n; terms are summed as logarithms, a long tail is the normal one (corrected for steps)."""
    if k <= 0:
        return 1.0
    if n > EXACT_TRIALS:
        return _upper_normal((k - 0.5 - n * p) / sqrt(n * p * (1 - p)))
    terms = [lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log(1 - p) for i in range(k, n + 1)]
    top = max(terms)
    return min(1.0, exp(top) * sum(exp(t - top) for t in terms))


def ordinary_tests(token: str) -> list[float]:
    """p-values of chi-squared, runs and serial correlation if the token were ordinary text (small: it looks random).

    Chi-squared: letters against ``ORDINARY``, by a scaled chi-squared of the statistic's own mean and variance. Runs:
    changes of class (lower, upper, digit) beyond those of words; signs that join words are passed, and a word's
    capital belongs to it. Serial correlation: of neighbouring letters few pairs are a vowel and a consonant. Both are
    binomial under the null. A test that has nothing to look at is left out. Of digits alone only serial correlation
    tells anything: how many differ by more than one from the digit before.
    """
    if token.isdigit():
        digits = np.frombuffer(token.encode("ascii"), np.uint8).astype(int)
        return [max(_at_least(int((np.abs(np.diff(digits)) > 1).sum()), len(digits) - 1, 1 - SMOOTH_DIGITS), 1e-300)]
    chars = np.frombuffer(re.sub(r"[+/_=-]", "", token).encode("ascii"), np.uint8)
    lower, upper = (chars >= 97) & (chars <= 122), (chars >= 65) & (chars <= 90)
    letter = lower | upper
    out = []
    letters = (chars[letter] | 32).astype(int) - 97
    n, k = len(letters), len(ORDINARY)
    if n > 1:
        chi = float(((np.bincount(letters, minlength=k) - n * ORDINARY) ** 2 / (n * ORDINARY)).sum())
        mean = k - 1.0
        var = 2 * mean + ((1 / ORDINARY).sum() - k * k - 2 * k + 2) / n
        free = 2 * mean * mean / var
        out.append(_upper_normal(((chi / mean) ** (1 / 3) - 1 + 2 / (9 * free)) / np.sqrt(2 / (9 * free))))
    classes = np.where(lower, 1, np.where(upper, 2, 3))
    changes = (classes[1:] != classes[:-1]) & ~((classes[:-1] == 2) & (classes[1:] == 1))
    if (classes != classes[:1]).any():
        out.append(_at_least(int(changes.sum()), len(chars) - 1, CLASS_CHANGE))
    vowel = np.isin(chars | 32, np.frombuffer(b"aeiou", np.uint8))
    pairs = letter[1:] & letter[:-1]
    if pairs.any():
        out.append(_at_least(int((pairs & (vowel[1:] == vowel[:-1])).sum()), int(pairs.sum()), 1 - VOWEL_CHANGE))
    return [max(p, 1e-300) for p in out]


def surprise(token: str) -> float:
    """-log10 of the combined p-value of ``ordinary_tests`` (Fisher), the largest of the token's ``bodies``; 0 if there is
    none or a test against "random" rejects it. Tokens of any length cost time in proportion."""
    return max((_surprise(b) for b in bodies(token)), default=0.0)


def _surprise(body: str) -> float:
    if min(randomness_tests(body)) < 1e-3:
        return 0.0
    tests = ordinary_tests(body)
    half = -sum(map(log, tests))  # half of Fisher's statistic, a chi-squared of twice as many degrees as tests
    return max(0.0, (half - log(sum(half**i / factorial(i) for i in range(len(tests))))) / log(10)) if tests else 0.0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``start, end, kind`` of what the fixed patterns find, by start, then kind as listed; leftmost, not overlapping within a kind."""
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, float]]:
    """``start, end, surprise`` of candidates that no base span overlaps and no test rejects, and of all others 0."""
    starts, furthest = [s for s, _, _ in base], []
    for _, e, _ in base:  # the furthest end of this span and those before
        furthest.append(max(e, furthest[-1]) if furthest else e)
    out = []
    for m in _CANDIDATE.finditer(text):
        before = bisect_right(starts, m.end() - 1)  # spans that start before the candidate ends
        if not before or furthest[before - 1] <= m.start():
            out.append((m.start(), m.end(), surprise(m[0])))
    return out


SPANS = "array<struct<start:bigint,end:bigint,kind:string>>"
TRIED = "array<struct<start:bigint,end:bigint,length_class:int,bin:int>>"


def scan(documents: DataFrame) -> DataFrame:
    """``doc_id, base, tried`` for every document: base spans, and candidates with length class and bin of surprise."""
    kinds = [pa.field("doc_id", pa.int64()), pa.field("base", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))), pa.field("tried", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("length_class", pa.int32()), ("bin", pa.int32())])))]

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, text in text_slices(batch):
                hit = pc.match_substring_regex(text, _ANY).to_numpy(zero_copy_only=False)
                base, tried = [[]] * len(text), [[]] * len(text)
                for i in np.flatnonzero(hit):
                    own = text[int(i)].as_py()
                    base[i] = (found := base_spans(own)) and [{"start": s, "end": e, "kind": k} for s, e, k in found]
                    tried[i] = [{"start": s, "end": e, "length_class": sum(e - s >= c for c in LENGTH_CLASSES) - 1, "bin": min(BINS - 1, int(p / BIN))} for s, e, p in candidates(own, found)]
                cells = [rows["doc_id"].combine_chunks().cast(pa.int64()), pa.array(base, kinds[1].type), pa.array(tried, kinds[2].type)]
                yield pa.RecordBatch.from_arrays(cells, ["doc_id", "base", "tried"])

    return documents.select("doc_id", "text").mapInArrow(spans, f"doc_id bigint, base {SPANS}, tried {TRIED}")


def thresholds(tried: DataFrame, rate: float = FALSE_DISCOVERIES) -> dict[int, int]:
    """For each length class the least bin that is a discovery (``BINS``: none).

    Benjamini-Hochberg within a class at ``rate``, over counts by bin - a table of fixed size, so exact for p-values
    rounded up to the grid. Longer classes don't pay for the many short candidates, nor the other way round.
    """
    counts = np.zeros((len(LENGTH_CLASSES), BINS))
    for row in tried.select(F.explode("tried").alias("t")).groupBy("t.length_class", "t.bin").count().collect():
        counts[row.length_class, row.bin] = row["count"]
    out = {}
    for c in range(len(LENGTH_CLASSES)):
        m, above = counts[c].sum(), np.cumsum(counts[c][::-1])[::-1]
        good = [b for b in range(1, BINS) if above[b] and 10 ** (-b * BIN) <= rate * above[b] / m]
        out[c] = min(good, default=BINS)
    return out


def find_secrets(documents: DataFrame, rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """``doc_id, base, spans``: base spans, and these with the discoveries (kind ``random``), by start, then kind.

    Offsets are code points, ends exclusive. Null and empty texts have no spans; each repeated row is scanned as any
    other; an empty table gives no rows. Whole texts are read; only counts by bin reach the driver.
    """
    found = written(scan(documents), "secret-spans")
    least = F.array(*[F.lit(b) for b in thresholds(found, rate).values()])
    new = F.filter("tried", lambda t: t["bin"] >= F.element_at(least, t["length_class"] + 1))
    new = F.transform(new, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.lit("random").alias("kind")))
    # base spans are never overlapped by others, so order by start alone is enough between the two
    order = F.array(*map(F.lit, KINDS))
    both = F.array_sort(
        F.concat("base", new),
        lambda a, b: F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"])).when(a["kind"] != b["kind"], F.signum(F.array_position(order, a["kind"]) - F.array_position(order, b["kind"]))).otherwise(F.signum(a["end"] - b["end"])).cast("int"),
    )
    return found.select("doc_id", "base", both.alias("spans"))


def joined(spans: str):
    """Column: ``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(documents: DataFrame, rate: float = FALSE_DISCOVERIES) -> DataFrame:
    found = find_secrets(documents, rate)

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))
