"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Random Fourier features approximate a Gaussian kernel over statistics of the whole text. Each partition of labelled
documents sums its part of the normal equations (by fold); the sums, whose size is fixed, are added up and solved.
Out-of-fold scores give the isotonic map from score to probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import fresh_name, split_words, text_slices, written

#: At most about this many labelled documents are fitted (drawn by a hash of doc_id); the rest of the labels is unused.
MAX_FIT = 30_000
FEATURES, FOLDS, RIDGE, SEED = 192, 4, 1e-2, 20240601
THRESHOLD = 0.7

#: Classes of bytes whose shares in the text are statistics.
BYTE_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "space": b" ",
    "newline": b"\n",
    "stop": b".,;:",
    "shout": b"!?",
    "symbol": b"#$%&*@^~|<>{}[]\\/=+_",
}
N_STATS = len(BYTE_CLASSES) + 12


def statistics(text: pa.Array) -> np.ndarray:
    """A row of ``N_STATS`` numbers for each text; an empty text has zeros."""
    n = len(text)
    if not n:
        return np.zeros((0, N_STATS))
    codes, ends, words = split_words(text)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    doc = np.repeat(np.arange(n), ends - starts)
    n_words = np.maximum(ends - starts, 1).astype(float)

    def per_doc(values: np.ndarray) -> np.ndarray:
        return np.bincount(doc, weights=values, minlength=n)

    size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(float)[codes] if len(words) else np.zeros(0)
    mean = per_doc(size) / n_words
    spread = np.sqrt(np.maximum(per_doc(size * size) / n_words - mean * mean, 0))
    same = np.zeros(len(codes))
    if len(codes) > 1:
        same[1:] = (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])
    pair = np.zeros(len(codes), np.int64)
    pair[1:] = codes[:-1] * max(len(words), 1) + codes[1:] if len(codes) > 1 else 0
    pair[starts[ends > starts]] = -1  # a first word follows none, whatever text stands before

    def distinct(values: np.ndarray) -> np.ndarray:
        order = np.lexsort((values, doc))
        first = np.ones(len(order))
        first[1:] = (values[order][1:] != values[order][:-1]) | (doc[order][1:] != doc[order][:-1])
        return np.bincount(doc[order], weights=first, minlength=n) / n_words

    spelled = [words, pc.utf8_lower(words)]
    shouted = (pc.not_equal(spelled[0], spelled[1]).to_numpy(zero_copy_only=False) & pc.equal(pc.utf8_upper(words), words).to_numpy(zero_copy_only=False)) if len(words) else np.zeros(0, bool)
    odd = pc.match_substring_regex(words, r"[#$%&*@^~|<>{}=+_]").to_numpy(zero_copy_only=False) if len(words) else np.zeros(0, bool)

    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + n + 1].astype(np.int64)
    data = np.frombuffer(text.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if text.buffers()[2] is not None else np.zeros(0, np.uint8)
    cuts, sizes = offsets[:-1] - offsets[0], np.diff(offsets)
    full = sizes > 0
    shares = []
    kinds = np.zeros(256, np.uint8)
    for k, chars in enumerate(BYTE_CLASSES.values(), 1):
        kinds[list(chars)] = k
    kinds[128:] = len(BYTE_CLASSES) + 1
    kind = kinds[data]
    for k in range(1, len(BYTE_CLASSES) + 2):
        got = np.zeros(n)
        if full.any():
            got[full] = np.add.reduceat((kind == k).astype(np.int32), cuts[full])
        shares.append(got / np.maximum(sizes, 1))
    stats = [
        np.log1p(sizes),
        np.log1p(ends - starts),
        mean / 10,
        spread / 10,
        per_doc(same) / n_words,
        distinct(codes),
        distinct(pair),
        per_doc(shouted[codes].astype(float)) / n_words if len(words) else np.zeros(n),
        per_doc(odd[codes].astype(float)) / n_words if len(words) else np.zeros(n),
        np.log1p(np.where(full, shares[3] * sizes, 0)),
        (ends > starts).astype(float),
    ]
    out = np.column_stack([*stats, *shares])
    out[~full] = 0
    return out


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing step fit (pool adjacent violators); equal scores are pooled first."""
    knots, place = np.unique(score, return_inverse=True)
    weight = np.bincount(place).astype(float)
    value = np.bincount(place, weights=label) / weight
    blocks: list[list[float]] = []  # value, weight, first knot, last knot
    for x, v, w in zip(knots, value, weight, strict=True):
        blocks.append([v, w, x, x])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, _, last = blocks.pop()
            v1, w1, first, _ = blocks[-1]
            blocks[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, first, last]
    xs = np.array([x for b in blocks for x in (b[2], b[3])])
    return xs, np.array([v for b in blocks for v in (b[0], b[0])])


@dataclass
class QualityModel:
    """A fitted classifier; its size doesn't depend on the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        waves = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.frequencies + self.phases)
        return np.column_stack([waves, np.ones(len(z))])

    def score(self, stats: np.ndarray) -> np.ndarray:
        """The calibrated probability of label 1, pulled very slightly towards the raw score, which breaks ties."""
        raw = self.features(stats) @ self.weights
        level = np.interp(raw, self.knots, self.levels)
        return np.clip(0.999 * level + 0.001 / (1 + np.exp(-4 * (raw - 0.5))), 0, 1)


def labelled_sample(documents: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> DataFrame:
    """``doc_id, text, label, fold``: documents with a label, at most about ``max_fit``, drawn by a hash of doc_id.

    Rows whose crc32(doc_id) mod 4 is 2 are held out and never drawn. Labels that disagree are averaged, null ones
    ignored. The drawn labels are bounded by ``max_fit``, hence the broadcast.
    """
    usable = labels.where("doc_id is not null and quality is not null and pmod(crc32(cast(cast(doc_id as string) as binary)), 4) <> 2")
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("_doc_id")).agg(F.avg("quality").alias("label"))
    count = usable.count()
    draw = F.pmod(F.xxhash64(F.col("_doc_id"), F.lit(SEED)), F.lit(1 << 20))
    usable = usable.where(draw < int((1 << 20) * min(1.0, max_fit / max(count, 1))))
    usable = usable.withColumn("fold", F.pmod(F.xxhash64(F.col("_doc_id"), F.lit(SEED + 1)), F.lit(FOLDS)).cast("int"))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.join(F.broadcast(usable), F.col("doc_id") == F.col("_doc_id")).select("doc_id", "text", "label", "fold")


def fit(documents: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT, features: int = FEATURES) -> QualityModel:
    """Fits on labelled documents. Without any usable label every text scores 1 (nothing is known against it)."""
    stats_type = "label double, fold int, stats array<double>"

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, text in text_slices(batch):
                stats = statistics(text)
                yield pa.RecordBatch.from_arrays([rows["label"].combine_chunks().cast(pa.float64()), rows["fold"].combine_chunks().cast(pa.int32()), pa.array(list(stats), pa.list_(pa.float64()))], ["label", "fold", "stats"])

    sample = written(labelled_sample(documents, labels, max_fit).select("text", "label", "fold").mapInArrow(summarise, stats_type), "quality-stats")
    moments = sample.select(F.posexplode("stats").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).toPandas().sort_values("i")
    rng = np.random.default_rng(SEED)
    zero = np.zeros(N_STATS)
    if moments.empty:
        return QualityModel(zero, zero + 1, np.zeros((N_STATS, 1)), np.zeros(1), np.array([0.0, 1.0]), np.array([0.0, 1.0]), np.array([1.0, 1.0]))
    model = QualityModel(moments.m.to_numpy(), np.maximum(moments.s.to_numpy(), 1e-3), rng.normal(0, 1 / np.sqrt(N_STATS), (N_STATS, features)), rng.uniform(0, 2 * np.pi, features), zero, zero, zero)

    def equations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((FOLDS, features + 1, features + 2))
        for rows in batches:
            x, y = model.features(np.stack(rows.stats)) if len(rows) else np.zeros((0, features + 1)), rows.label.to_numpy()
            for f in range(FOLDS):
                of = rows.fold.to_numpy() == f
                sums[f] += np.column_stack([x[of].T @ x[of], x[of].T @ y[of]])
        for f in range(FOLDS):
            yield pd.DataFrame({"fold": f, "i": range(features + 1), "sums": list(sums[f])})

    # the sample is bounded, and so is the number of its partitions; each sends (features + 1)^2 sums a fold
    parts = sample.coalesce(8).mapInPandas(equations, "fold int, i int, sums array<double>")
    sums = np.zeros((FOLDS, features + 1, features + 2))
    for row in parts.toLocalIterator():
        sums[row.fold, row.i] += row.sums
    eye = np.eye(features + 1)
    eye[-1, -1] = 1e-9

    def solve(total: np.ndarray) -> np.ndarray:
        count = max(total[-1, -2], 1)
        return np.linalg.solve(total[:, :-1] / count + RIDGE * eye / features, total[:, -1] / count)

    folds = [solve(sums.sum(0) - sums[f]) for f in range(FOLDS)]
    drawn = sample.toPandas()  # at most about max_fit rows of N_STATS numbers
    x = model.features(np.stack(drawn.stats))
    raw = np.einsum("ij,ij->i", x, np.stack(folds)[drawn.fold.to_numpy()])
    model.weights = solve(sums.sum(0))
    model.knots, model.levels = isotonic(raw, drawn.label.to_numpy())
    return model


def score(documents: DataFrame, model: QualityModel, keep_all: bool = False, name: str = "score") -> DataFrame:
    """``doc_id, score`` for every document (with ``keep_all``, all columns and ``name``, which replaces one of that name).

    Null and empty texts are scored by their zero statistics. Whole texts are read; nothing is shuffled.
    """
    kept = documents.drop(name) if keep_all else documents.select("doc_id", "text")
    fields = kept.schema.fields if keep_all else kept.select("doc_id").schema.fields
    schema = StructType([*fields, StructField(name, DoubleType())])

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, text in text_slices(batch):
                got = rows if keep_all else rows.select(["doc_id"])
                got = got.append_column(name, pa.array(model.score(statistics(text))))
                yield from got.combine_chunks().to_batches()

    return kept.mapInArrow(scores, schema)


def is_held_out():
    """Column: crc32(doc_id as text) mod 4 is 2 (a null doc_id is not held out)."""
    return F.expr("coalesce(pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2, false)")


def classify(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document, repeated rows too; an empty table gives no rows."""
    scored = score(documents, fit(documents, labels))
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches ``threshold``, with their columns."""
    name = fresh_name(documents, "score")
    return score(documents, fit(documents, labels), keep_all=True, name=name).where(F.col(name) >= threshold).select(*documents.columns)
