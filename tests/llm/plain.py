"""Plain versions of operators, text by text, for comparison."""

import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from pageloom.llm import quality

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORDS.findall(text or "")


def statistics(text):
    data = (text or "").encode()
    if not data:
        return [0.0] * quality.N_STATS
    w = words_of(text)
    n = max(len(w), 1)
    sizes = np.array([len(x) for x in w], float)
    pairs = set(zip([None, *w], w, strict=False))
    shares = [sum(b in chars for b in data) / len(data) for chars in quality.BYTE_CLASSES.values()]
    return [
        np.log1p(len(data)), np.log1p(len(w)), sizes.sum() / n / 10, (sizes.std() if w else 0) / 10,
        sum(a == b for a, b in zip(w, w[1:], strict=False)) / n, len(set(w)) / n, len(pairs) / n,
        sum(x != x.lower() and x == x.upper() for x in w) / n, sum(bool(set(x) & set("#$%&*@^~|<>{}=+_")) for x in w) / n,
        np.log1p(data.count(b"\n")), float(bool(w)), *shares, sum(b > 127 for b in data) / len(data),
    ]


def isotonic(score, label):
    """Levels of distinct scores: the largest over starts of the least mean up to any end."""
    xs = sorted(set(score))
    total = np.array([sum(y for s, y in zip(score, label, strict=True) if s == x) for x in xs])
    count = np.array([sum(s == x for s in score) for x in xs])
    mean = lambda a, b: total[a : b + 1].sum() / count[a : b + 1].sum()
    return xs, [max(min(mean(a, b) for b in range(i, len(xs))) for a in range(i + 1)) for i in range(len(xs))]


def quality_scores(spark, rows, labels):
    """Scores of ``rows`` (doc_id, text) after a fit to ``labels`` (doc_id, quality), in one piece and in NumPy alone."""
    known = {}
    for i, q in labels:
        if i is not None and q is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            known.setdefault(i, []).append(q)
    drawn = [(i, t, np.mean(known[i])) for i, t in rows if i in known]
    fold = F.pmod(F.xxhash64("i", F.lit(quality.SEED + 1)), F.lit(quality.FOLDS)).alias("fold")
    folds = {r.i: r.fold for r in spark.createDataFrame([(i,) for i in known], "i bigint").select("i", fold).collect()}
    x = np.array([statistics(t) for _, t, _ in drawn])
    y, f = np.array([q for *_, q in drawn]), np.array([folds[i] for i, *_ in drawn])
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    rng = np.random.default_rng(quality.SEED)
    waves, phases = rng.normal(0, 1 / np.sqrt(quality.N_STATS), (quality.N_STATS, quality.FEATURES)), rng.uniform(0, 2 * np.pi, quality.FEATURES)

    def features(stats):
        z = np.cos(np.clip((stats - mean) / scale, -8, 8) @ waves + phases) * np.sqrt(2 / quality.FEATURES)
        return np.hstack([z, np.ones((len(z), 1))])

    def ridge(rows, target):
        """Least squares of the rows under rows that stand for the penalty (of the intercept nearly none)."""
        penalty = np.sqrt(quality.RIDGE * len(rows) / quality.FEATURES * np.append(np.ones(quality.FEATURES), 1e-9))
        return np.linalg.lstsq(np.vstack([rows, np.diag(penalty)]), np.append(target, np.zeros(len(penalty))), rcond=None)[0]

    a = features(x)
    raw = np.zeros(len(y))
    for k in range(quality.FOLDS):
        raw[f == k] = a[f == k] @ ridge(a[f != k], y[f != k])
    xs, levels = isotonic(raw, y)
    got = features(np.array([statistics(t) for _, t in rows])) @ ridge(a, y)
    return np.clip(0.999 * np.interp(got, xs, levels) + 0.001 / (1 + np.exp(-4 * (got - 0.5))), 0, 1)


def near_components(rows, shingle=5, percent=80):
    """The smallest doc_id that each doc_id reaches over similar sets of shingles."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = words_of((t or "").translate(lower))
        sets[i] = {tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))} if w else set()
    least = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    return least
