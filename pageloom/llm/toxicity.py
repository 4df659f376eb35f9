"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

The n-grams are those of a text's words, lower-cased (A-Z) and with a space on either side, each counted once a text. From
labelled texts come, for each n-gram, the numbers of toxic and of other texts that have it; the logarithm of their ratio
scales the n-gram's feature. N-grams that few texts have, or whose ratio is near 1, are no features. A logistic regression
with a ridge penalty is fitted on the scaled features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, split_words, text_slices, written

#: At most about this many labelled documents are fitted (drawn by a hash of doc_id); the rest of the labels is unused.
MAX_FIT = 20_000
SIZES = (4, 5, 6)
#: A feature is in so many labelled texts, and its log-count ratio is at least so far from 0; at most so many features.
LEAST_TEXTS, LEAST_RATIO, MAX_FEATURES = 5, 1.0, 200_000
SMOOTHING, RIDGE, STEPS, SEED = 1.0, 0.5, 200, 20240702
THRESHOLD = 0.5
_FILTER = 20


def word_ngrams(words: pa.Array, sizes: tuple[int, ...] = SIZES) -> tuple[np.ndarray, np.ndarray]:
    """Place of the word and 64-bit hash of each n-gram (of bytes) of each word with a space on either side."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    spaced = pc.binary_join_element_wise(" ", words, " ", "")
    ends = np.frombuffer(spaced.buffers()[1], np.int32)[: len(spaced) + 1].astype(np.int64)
    data = np.frombuffer(spaced.buffers()[2], np.uint8)[: ends[-1]].astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), np.diff(ends))
    own, hashed = [], []
    rolled = np.zeros(len(data), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, max(sizes) + 1):
            m = max(0, len(data) - n + 1)
            rolled = rolled[:m] * np.uint64(0x100000001B3) + data[n - 1 : n - 1 + m] + np.uint64(1)
            if n in sizes:
                inside = owner[:m] == owner[n - 1 : n - 1 + m]
                own.append(owner[:m][inside])
                hashed.append(mix64(rolled[inside] + np.uint64(n)))
    return np.concatenate(own), np.concatenate(hashed)


def distinct_words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Text and word of each distinct pair, by text, and the words."""
    codes, ends, words = split_words(text, lower=True)
    of = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
    pairs = np.unique(of * max(1, len(words)) + codes)
    return pairs // max(1, len(words)), pairs % max(1, len(words)), words


def text_features(text: pa.Array, known: np.ndarray | None = None, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text and n-gram of each distinct pair, by text, and the n-grams' hashes.

    ``known``: sorted hashes; others are left out, and n-grams are their places in it.
    """
    of, word, words = distinct_words(text)
    owner, grams = word_ngrams(words)
    if known is not None:
        if table is None:
            table = filter_table(known)
        near = table[(grams & np.uint64((1 << _FILTER) - 1)).astype(np.int64)]
        owner, grams = owner[near], grams[near]
        at = np.searchsorted(known, grams)
        found = known[np.minimum(at, max(0, len(known) - 1))] == grams if len(known) else np.zeros(len(grams), bool)
        owner, place, grams = owner[found], at[found], known
    else:
        grams, place = np.unique(grams, return_inverse=True)
    order = np.argsort(owner, kind="stable")
    owner, place = owner[order], place[order]
    first = np.searchsorted(owner, np.arange(len(words) + 1))
    count = np.diff(first)[word] if len(word) else np.zeros(0, np.int64)
    rows = np.repeat(first[word], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) if len(word) else np.zeros(0, np.int64)
    pairs = np.unique(np.repeat(of, count) * max(1, len(grams)) + place[rows])
    return pairs // max(1, len(grams)), pairs % max(1, len(grams)), grams


def filter_table(known: np.ndarray) -> np.ndarray:
    """Which low bits any known hash has."""
    table = np.zeros(1 << _FILTER, bool)
    table[(known & np.uint64((1 << _FILTER) - 1)).astype(np.int64)] = True
    return table


@dataclass
class ToxicityModel:
    """A fitted classifier: hashes of n-grams in order, the weight of each (its ratio times its coefficient), an intercept."""

    grams: np.ndarray
    weights: np.ndarray
    intercept: float

    def score(self, text: pa.Array, table: np.ndarray | None = None) -> np.ndarray:
        of, gram, _ = text_features(text, self.grams, table)
        return _logistic(np.bincount(of, weights=self.weights[gram], minlength=len(text)) + self.intercept)


def _logistic(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))


def is_held_out() -> Column:
    """crc32(doc_id as text) mod 5 is 0 (a null doc_id is not held out)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(documents: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> DataFrame:
    """``text, label``: documents with a label, at most about ``max_fit``, drawn by a hash of doc_id; never held-out rows.

    Labels that disagree are averaged, null ones ignored. The drawn labels are bounded by ``max_fit``, hence the broadcast.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~is_held_out())
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.avg("toxic").alias("label"))
    draw = F.pmod(F.xxhash64(F.col("id"), F.lit(SEED)), F.lit(1 << 20))
    usable = usable.where(draw < int((1 << 20) * min(1.0, max_fit / max(usable.count(), 1))))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.join(F.broadcast(usable), F.col("doc_id") == F.col("id")).select("text", "label")


def gram_counts(sample: DataFrame) -> DataFrame:
    """``gram, toxic, other``: in how many labelled texts of either kind an n-gram is; summed in each slice first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, text in text_slices(batch):
                label = rows["label"].to_numpy()
                of, place, grams = text_features(text)
                toxic = np.bincount(place, weights=label[of], minlength=len(grams))
                both = np.bincount(place, minlength=len(grams))
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(toxic), pa.array(both - toxic)], ["gram", "toxic", "other"])

    return sample.mapInArrow(count, "gram bigint, toxic double, other double").groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def log_count_ratio(toxic, other, n_toxic: float, n_other: float):
    """Logarithm of the smoothed part of toxic texts with an n-gram by that of the others (columns or arrays)."""
    log = np.log if isinstance(toxic, np.ndarray) else F.log
    return log((toxic + SMOOTHING) / (n_toxic + 2 * SMOOTHING)) - log((other + SMOOTHING) / (n_other + 2 * SMOOTHING))


def logistic_fit(of: np.ndarray, gram: np.ndarray, ratios: np.ndarray, labels: np.ndarray, ridge: float = RIDGE, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Coefficients of features ``ratios[gram]`` (text ``of`` has ``gram``), and an unpenalised intercept, by accelerated descent."""
    n, k = len(labels), len(ratios)

    def forward(x: np.ndarray) -> np.ndarray:
        return np.bincount(of, weights=(ratios * x[:-1])[gram], minlength=n) + x[-1]

    def backward(z: np.ndarray) -> np.ndarray:
        return np.append(ratios * np.bincount(gram, weights=z[of], minlength=k), z.sum())

    probe = np.ones(k + 1)
    for _ in range(20):  # the largest curvature, by power iteration
        probe = backward(forward(probe))
        curve = np.linalg.norm(probe)
        probe /= max(curve, 1e-12)
    step = 1 / (1.05 * curve / 4 + ridge + 1e-9)
    penalty = np.append(np.full(k, ridge), 0.0)
    x = ahead = np.append(np.zeros(k), np.log((labels.sum() + SMOOTHING) / ((1 - labels).sum() + SMOOTHING)))
    pace = 1.0
    for _ in range(steps):
        new = ahead - step * (backward(_logistic(forward(ahead)) - labels) + penalty * ahead)
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        x, ahead, pace = new, new + (pace - 1) / faster * (new - x), faster
    return x[:-1], float(x[-1])


def fit(documents: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> ToxicityModel:
    """Fits on labelled documents. Without any usable label every text scores 0 (nothing is known against it)."""
    sample = written(labelled_sample(documents, labels, max_fit), "toxic-sample")
    totals = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("toxic")).first()
    if not totals.n:
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), -np.inf)
    ratio = log_count_ratio(F.col("toxic"), F.col("other"), totals.toxic, totals.n - totals.toxic)
    counts = gram_counts(sample).where(F.col("toxic") + F.col("other") >= LEAST_TEXTS).withColumn("ratio", ratio).where(F.abs("ratio") >= LEAST_RATIO)
    chosen = counts.select("gram", "ratio").orderBy(F.abs("ratio").desc(), "gram").limit(MAX_FEATURES).toPandas()
    order = np.argsort(chosen.gram.to_numpy().view(np.uint64))
    grams, ratios = chosen.gram.to_numpy().view(np.uint64)[order], chosen.ratio.to_numpy()[order]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = filter_table(grams)
        for batch in batches:
            for rows, text in text_slices(batch):
                of, gram, _ = text_features(text, grams, table)
                ends = np.searchsorted(of, np.arange(len(text) + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(gram.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([rows["label"].combine_chunks().cast(pa.float64()), lists], ["label", "grams"])

    rows = sample.mapInArrow(features, "label double, grams array<int>").toArrow()  # at most about max_fit rows of chosen n-grams
    label, lists = rows["label"].to_numpy(), rows["grams"].combine_chunks()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    of, gram = np.repeat(np.arange(len(label)), sizes), lists.flatten().to_numpy()
    coefficients, intercept = logistic_fit(of, gram, ratios, label)
    return ToxicityModel(grams, ratios * coefficients, intercept)


def score(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, score`` for every document; null and empty texts have no n-gram. Texts are read whole, nothing is shuffled."""
    kept = documents.select("doc_id", "text")
    kind = kept.schema["doc_id"].dataType.simpleString()

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = filter_table(model.grams)
        for batch in batches:
            for rows, text in text_slices(batch):
                yield pa.RecordBatch.from_arrays([rows["doc_id"].combine_chunks(), pa.array(model.score(text, table))], ["doc_id", "score"])

    return kept.mapInArrow(scores, f"doc_id {kind}, score double")


def classify(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document, repeated rows too; an empty table gives no rows."""
    scored = score(documents, fit(documents, labels))
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
