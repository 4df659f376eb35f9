"""Packing: order-preserving dynamic programming over cut places.

Documents stand in doc_id order, or another that is given, as one stream of ids. A sequence is a window of at most
``width`` ids between two cut places: ends of documents and of sentences, and places inside only of sentences so long
that a window without them would be padded much. The cheapest division minimises padding plus penalties of the cuts:
none at a document's end, little at a sentence's, more inside one. With g(i) = cost(i) + place(i), the best start of a window that ends at j is the least g
over the places that the window reaches, so a monotone queue makes each transition constant-time.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, text_slices, written
from .tokens import piece_encoder, vocabulary

WIDTH = 2048
#: Cost of a cut, in ids of padding.
AT_SENTENCE, INSIDE = 1.0, 6.0
#: Sentences of more than so many ids may be cut inside, at each STRIDE ids: no end lies in reach there.
REACH, STRIDE = 64, 32
#: A stretch of the stream that is divided at once: whole documents up to the first with which it has so many ids. Its
#: last sequence is left open for what follows. So the division depends on a partition's documents alone.
SPAN = 400_000
#: UTF-8 bytes of text a partition has at least; each partition pads one sequence at its end.
PARTITION_BYTES = 2 << 20


def best_cuts(places: np.ndarray, penalties: np.ndarray, width: int = WIDTH, more: bool = False) -> tuple[list[int], float]:
    """Ends of windows that divide 0..places[-1], and the cost. ``places`` ascend strictly, start above 0, and steps are at most ``width``.

    With ``more`` to follow, the last window stays open and costs nothing: the cheapest end within ``width`` of the last place.
    """
    at, cost_of = [0, *places.tolist()], [0.0, *penalties.tolist()]
    n = len(at)
    came, g = [0] * n, [0.0] * n
    queue = deque([0])
    cost = 0.0
    for j in range(1, n):
        p = at[j]
        least = p - width
        while at[queue[0]] < least:
            queue.popleft()
        i = queue[0]
        came[j] = i
        cost = g[i] + width - p + cost_of[j]
        v = cost + p
        g[j] = v
        while queue and g[queue[-1]] > v:
            queue.pop()
        queue.append(j)
    j = n - 1
    if more:
        j = min((k for k in range(bisect_left(at, at[-1] - width), n)), key=lambda k: g[k] - at[k])
        cost = g[j] - at[j]
    cuts = []
    while j:
        cuts.append(at[j])
        j = came[j]
    return cuts[::-1], cost


def merged(*sorted_places: np.ndarray) -> np.ndarray:
    """The distinct places of several arrays, ascending."""
    places = np.sort(np.concatenate(sorted_places), kind="stable")
    return places[np.diff(places, prepend=-1) > 0]


def is_among(places: np.ndarray, those: np.ndarray) -> np.ndarray:
    """Which places are among ``those``; both ascend."""
    at = np.searchsorted(those, places)
    return np.append(those, -1)[at] == places


def cut_places(sentence_ends: np.ndarray, document_ends: np.ndarray, stride: int = STRIDE, reach: int = REACH) -> tuple[np.ndarray, np.ndarray]:
    """All cut places of a stream and their penalties; the stream ends with the last document."""
    places = merged(sentence_ends[sentence_ends > 0], document_ends)
    gaps = np.diff(places, prepend=0)
    wide = np.flatnonzero(gaps > reach)
    if len(wide):
        begin = places[wide] - gaps[wide]
        k = (gaps[wide] - 1) // stride
        within = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + 1
        places = merged(places, np.repeat(begin, k) + within * stride)
    penalties = np.full(len(places), INSIDE)
    penalties[is_among(places, sentence_ends)] = AT_SENTENCE
    penalties[is_among(places, document_ends)] = 0.0
    return places, penalties


class _Stream:
    """Ids of one partition so far, of which what is not in a sequence yet is held."""

    def __init__(self, width: int):
        self.width, self.sequence = width, 0
        self.ids = [np.zeros(0, "<u4")]
        self.sentences, self.documents = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        self.names: list[tuple] = []  # of each document held: doc_id, ids before those held, ids in all
        self.n = 0

    def add(self, ids, sentence_ends, document_ends, names) -> None:
        sizes = np.diff(document_ends, prepend=0)
        self.ids.append(ids)
        self.sentences.append(sentence_ends + self.n)
        self.documents.append(document_ends + self.n)
        self.names += [(name, 0, int(s)) for name, s in zip(names, sizes, strict=True)]
        self.n += len(ids)

    def divide(self, last: bool) -> list[tuple]:
        """Pieces of all sequences, but for the open one unless ``last``."""
        ids, sentences, documents = np.concatenate(self.ids), np.concatenate(self.sentences), np.concatenate(self.documents)
        if not len(ids):
            return []
        cuts, _ = best_cuts(*cut_places(sentences, documents), self.width, not last)
        ends = np.array([*cuts], np.int64)
        done = int(ends[-1]) if len(ends) else 0
        out = []
        marks = merged(ends, documents[documents <= done])
        doc_of = np.searchsorted(documents, marks, side="left")
        seq_of = np.searchsorted(ends, marks, side="left")
        begin = 0
        view = memoryview(ids.tobytes())
        starts = np.concatenate([[0], documents[:-1]])
        for end, d, s in zip(marks.tolist(), doc_of.tolist(), seq_of.tolist(), strict=True):
            name, before, total = self.names[d]
            base = int(ends[s - 1]) if s else 0
            out.append((name, before + begin - int(starts[d]), end - begin, zlib.crc32(view[4 * begin : 4 * end]), total, self.sequence + s, begin - base))
            begin = end
        self.sequence += len(ends)
        # what stays open
        keep = int(np.searchsorted(documents, done, side="right"))
        self.names = self.names[keep:]
        if self.names and int(starts[keep]) < done:
            name, before, total = self.names[0]
            self.names[0] = (name, before + done - int(starts[keep]), total)
        self.ids, self.n = [ids[done:]], len(ids) - done
        self.sentences, self.documents = [sentences[sentences > done] - done], [documents[keep:] - done]
        return out


def stream_ids(pieces, end_id: int):
    """Ids with ``end_id`` after each text, ends of sentences, ends of texts."""
    n = pieces.count[pieces.codes]
    after = np.cumsum(n)
    ends = np.concatenate([[0], after])[pieces.ends]
    ids = np.insert(pieces.ids(), ends, end_id).astype("<u4")
    stops = np.flatnonzero(pieces.stops[pieces.codes]) if len(n) else np.zeros(0, np.int64)
    doc = np.searchsorted(pieces.ends, stops, side="right")
    # a text's last sentence ends with the text, its end id included
    inner = stops + 1 < pieces.ends[doc] if len(stops) else np.zeros(0, bool)
    return ids, (after[stops] + doc)[inner] if len(stops) else stops, ends + 1 + np.arange(len(ends))


def stored_order(documents: DataFrame) -> list[Column]:
    """The order of rows as their files hold them, part by part; without files that of the table's partitions."""
    stored = [F.col("_metadata.file_name"), F.col("_metadata.row_index")]
    try:
        documents.select(*stored).schema  # noqa: B018
    except AnalysisException:
        return [F.monotonically_increasing_id()]
    return stored


def pack(documents: DataFrame, width: int = WIDTH, tokenizer: str | None = None, end_id: int = 1, order: list[Column] | None = None) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Each document's ids with ``end_id`` at its end lie in pieces of sequences of at most ``width`` ids, in doc_id
    order (null doc_ids first, equal ones by text) or that of ``order``, which should tell rows apart. Null text counts as empty, which leaves the end id alone.
    sequence_id counts from 0 without gaps. An empty table gives no rows; repeated rows are packed each. Texts are
    range-partitioned once and streamed; a partition holds one stretch of ids at a time, or one long document.
    """
    spark = documents.sparkSession
    path = tokenizer or vocabulary("word_bpe_49k.json")
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(c.alias(f"order_{i}") for i, c in enumerate(order or [])))
    by = [f"order_{i}" for i in range(len(order or []))]
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, min(shuffle_partitions(spark), math.ceil(size / PARTITION_BYTES)))
    ranged = source.repartitionByRange(parts, *(by or ["doc_id"])).sortWithinPartitions(*(by or ["doc_id", "text"]))
    ranged = ranged.select("doc_id", "text", F.spark_partition_id().alias("part"))
    names = ["part", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "local_sequence", "offset"]
    types = [pa.int32(), *[pa.int64()] * 7]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, stream, part = piece_encoder(path), _Stream(width), 0

        def rows(last: bool) -> pa.RecordBatch:
            out = stream.divide(last)
            return pa.RecordBatch.from_arrays([pa.array([part] * len(out), types[0]), *(pa.array([r[k] for r in out], types[k + 1]) for k in range(7))], names)

        for batch in batches:
            for table, text in text_slices(batch):
                part = table["part"][0].as_py()
                ids, sentences, ends = stream_ids(encoder.pieces(text), end_id)
                doc_ids, at = table["doc_id"].to_pylist(), 0
                while at < len(ends):
                    base = int(ends[at - 1]) if at else 0
                    upto = min(len(ends), int(np.searchsorted(ends, base + SPAN - stream.n, side="left")) + 1)
                    last = int(ends[upto - 1])
                    stream.add(ids[base:last], sentences[(sentences > base) & (sentences < last)] - base, ends[at:upto] - base, doc_ids[at:upto])
                    at = upto
                    if stream.n >= SPAN:
                        yield rows(False)
        yield rows(True)

    pieces = written(ranged.mapInArrow(packed, "part int, " + ", ".join(f"{n} bigint" for n in names[1:])), "packed")
    # one row a partition
    counts = pieces.groupBy("part").agg((F.max("local_sequence") + 1).alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    pieces = pieces.join(F.broadcast(before), "part")
    return pieces.select(*names[1:6], (F.col("before") + F.col("local_sequence")).alias("sequence_id"), "offset")
