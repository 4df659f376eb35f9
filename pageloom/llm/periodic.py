"""Periodic runs of words, by partition refinement.

Positions of a text are in one class at length l if the l words from each on are equal. Classes of length l + 1 come from
those of length l by splitting each by the classes of the positions behind. Only positions before members of all but the
largest part of a class split before have to be looked at (smaller half), so a position is looked at about log n times.
Members of a class are linked in order; where two neighbours at length q are q apart, the q words of the first are repeated
at once, and they are no power of anything shorter. Such squares at following positions merge into a run of period q.

Many texts are refined together, each by itself: a class never holds positions of two texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, fresh_name, split_words, text_or_empty, text_slices

#: A run has at least so many words, and so many times its period.
LEAST_LENGTH, LEAST_EXPONENT = 6, 4
#: Bytes of text that are refined together: every length costs a step, whatever the number of texts.
TOGETHER = 8 << 20


class Refinement:
    """Classes of the positions of several texts, each followed by an end mark that equals nothing.

    ``members`` holds each class in one stretch (``first``, ``size``), ``place`` says where a position stands in it, and
    ``before`` and ``after`` link a class in order of position (-1: none).
    """

    def __init__(self, codes: np.ndarray, ends: np.ndarray, exponent: int):
        n_texts, sizes = len(ends), np.diff(np.concatenate([[0], ends]))
        total = len(codes) + n_texts
        text = np.repeat(np.arange(n_texts), sizes + 1)
        marks = ends + np.arange(n_texts)
        word = np.zeros(total, np.int64)
        inner = np.ones(total, bool)
        inner[marks] = False
        width = int(codes.max(initial=0)) + 2
        word[inner] = codes + 1  # 0 is the end mark
        self.starts = np.zeros(total, bool)
        self.starts[marks - sizes] = True
        #: the largest period that a run can have here
        self.most = (sizes // exponent)[text]
        key = text * width + word
        self.members = np.argsort(key, kind="stable")
        new = np.ones(total, bool)
        new[1:] = key[self.members][1:] != key[self.members][:-1]
        self.first, self.size = np.zeros(total, np.int64), np.zeros(total, np.int64)
        heads = np.flatnonzero(new)
        self.classes = len(heads)
        self.first[: len(heads)] = heads
        self.size[: len(heads)] = np.diff(np.concatenate([heads, [total]]))
        self.of, self.place = np.empty(total, np.int64), np.empty(total, np.int64)
        self.of[self.members] = np.cumsum(new) - 1
        self.place[self.members] = np.arange(total)
        self.before, self.after = np.full(total, -1), np.full(total, -1)
        self.marked = np.zeros(total, bool)
        joined = ~new[1:]
        self.after[self.members[:-1][joined]] = self.members[1:][joined]
        self.before[self.members[1:][joined]] = self.members[:-1][joined]
        # a text is the class of length 0; all its parts but the largest split
        by_size = np.lexsort((-self.size[: len(heads)], text[self.members[heads]]))
        largest = by_size[np.unique(text[self.members[heads]][by_size], return_index=True)[1]]
        splits = np.ones(len(heads), bool)
        splits[largest] = False
        self.splitters = np.flatnonzero(splits[self.of])
        self.length = 1
        self.waiting: dict[int, list[np.ndarray]] = {}
        self.wait(np.flatnonzero(self.after >= 0))

    def wait(self, positions: np.ndarray) -> None:
        """Notes positions by the distance to their neighbour, where a run can have it as its period."""
        gap = self.after[positions] - positions
        fits = (gap >= self.length) & (gap <= self.most[positions])
        positions, gap = positions[fits], gap[fits]
        if not len(gap):
            return
        if len(gap) > 8:
            order = np.argsort(gap, kind="stable")
            positions, gap = positions[order], gap[order]
        cuts = [0, *(np.flatnonzero(gap[1:] != gap[:-1]) + 1).tolist(), len(gap)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            self.waiting.setdefault(int(gap[a]), []).append(positions[a:b])

    def squares(self) -> np.ndarray:
        """Positions, in order, whose neighbour is as far as the classes' length."""
        noted = self.waiting.pop(self.length, None)
        if noted is None:
            return np.zeros(0, np.int64)
        at = np.unique(np.concatenate(noted))
        return at[self.after[at] - at == self.length]

    def part_lone(self, at: np.ndarray) -> None:
        """Makes each of some positions, one of a class, a class of its own: what most steps of long lengths do."""
        old = self.of[at]
        self.size[old] -= 1
        slots = self.first[old] + self.size[old]
        there, into = self.members[slots], self.place[at]
        self.members[into], self.place[there] = there, into
        self.members[slots], self.place[at] = at, slots
        names = np.arange(self.classes, self.classes + len(at))
        self.classes += len(at)
        self.first[names], self.size[names], self.of[at] = slots, 1, names
        left, right = self.before[at], self.after[at]
        self.before[at] = self.after[at] = -1
        self.after[left[left >= 0]] = right[left >= 0]
        self.before[right[right >= 0]] = left[right >= 0]
        self.wait(left[(left >= 0) & (right >= 0)])
        self.splitters = at

    def refine(self) -> None:
        """From classes of one length to those of the next."""
        of, size, first, members, place = self.of, self.size, self.first, self.members, self.place
        self.length += 1
        at = self.splitters[~self.starts[self.splitters]] - 1
        at = at[(size[of[at]] > 1) & (self.most[at] >= self.length)]
        self.splitters = at[:0]
        if not len(at):
            return
        if len(at) < 64 and len(set(of[at].tolist())) == len(at):
            self.part_lone(at)
            return
        old, behind = of[at], of[at + 1]
        order = np.lexsort((at, behind, old))
        at, old, behind = at[order], old[order], behind[order]
        new_class = np.ones(len(at), bool)
        new_class[1:] = old[1:] != old[:-1]
        new_part = new_class.copy()
        new_part[1:] |= behind[1:] != behind[:-1]
        heads, parts = np.flatnonzero(new_class), np.flatnonzero(new_part)
        part_size = np.diff(np.concatenate([parts, [len(at)]]))
        parent = np.cumsum(new_class)[parts] - 1  # of each part, among the classes met
        met = old[heads]
        touched = np.diff(np.concatenate([heads, [len(at)]]))
        rest = size[met] - touched

        # the met positions of a class go to the end of its stretch, part by part
        slots = np.repeat(first[met] + rest, touched) + np.arange(len(at)) - np.repeat(heads, touched)
        there = members[slots]
        self.marked[at] = True
        inside, ours = place[at] >= np.repeat(first[met] + rest, touched), self.marked[there]
        self.marked[at] = False
        out, into = there[~ours], place[at[~inside]]  # as many of either in each class, both in its order
        members[into], place[out] = out, into
        members[slots], place[at] = at, slots

        # the largest part of a class keeps quiet; what is left of it counts as a part
        biggest = np.lexsort((-part_size, parent))[new_class[parts].nonzero()[0]] if len(parts) > len(met) else np.arange(len(parts))
        rest_quiet = rest >= part_size[biggest]
        quiet = np.zeros(len(parts), bool)
        quiet[biggest[~rest_quiet]] = True
        stays = np.zeros(len(parts), bool)
        stays[biggest[rest == 0]] = True  # without a rest the largest part keeps the class's name
        names = np.where(stays, met[parent], 0)
        made = int((~stays).sum())
        names[~stays] = self.classes + np.arange(made)
        self.classes += made
        size[met], part_first = rest, slots[parts]
        first[names], size[names] = part_first, part_size
        of[at] = np.repeat(names, part_size)

        # what leaves a class is taken out of its chain, stretch by stretch
        moved = np.repeat(~stays, part_size)
        leaves = at[moved]
        order = np.lexsort((leaves, old[moved]))
        leaves = leaves[order]
        if len(leaves):
            cut = np.ones(len(leaves), bool)
            cut[1:] = self.after[leaves[:-1]] != leaves[1:]
            left = self.before[leaves[cut]]
            right = self.after[leaves[np.concatenate([np.flatnonzero(cut)[1:] - 1, [len(leaves) - 1]])]]
            self.after[left[left >= 0]] = right[left >= 0]
            self.before[right[right >= 0]] = left[right >= 0]
            self.wait(left[(left >= 0) & (right >= 0)])
            mine, named = at[moved], of[at[moved]]
            same = named[1:] == named[:-1]
            self.before[mine] = self.after[mine] = -1
            self.after[mine[:-1][same]] = mine[1:][same]
            self.before[mine[1:][same]] = mine[:-1][same]
            self.wait(mine[:-1][same])

        # all parts but the largest split what stands before them; a class that was met whole and stays whole splits nothing
        whole = (rest == 0) & (np.bincount(parent, minlength=len(met)) == 1)
        splits = ~quiet & ~whole[parent]
        again = [at[np.repeat(splits, part_size)]]
        small = np.flatnonzero((rest > 0) & ~rest_quiet)
        if len(small):
            lengths = rest[small]
            again.append(members[np.repeat(first[met[small]], lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)])
        self.splitters = np.concatenate(again)


def runs_of(codes: np.ndarray, ends: np.ndarray, least_length: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start, length and smallest period of all maximal runs, by text, start and period.

    ``codes`` are the words of all texts in order, ``ends`` each text's end in them.
    """
    if not len(codes):
        return (np.zeros(0, np.int64),) * 4
    r = Refinement(codes, ends, exponent)
    found = []
    while True:
        q = r.length
        at = r.squares()
        if len(at):
            cut = np.flatnonzero(np.diff(at) != 1)
            start, last = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]
            length = last - start + 2 * q
            good = length >= max(least_length, exponent * q)
            if good.any():
                found.append(np.stack([start[good], length[good], np.full(int(good.sum()), q)]))
        if not r.waiting and not len(r.splitters):
            break
        r.refine()
    if not found:
        return (np.zeros(0, np.int64),) * 4
    start, length, period = np.concatenate(found, axis=1)
    begins = np.concatenate([[0], ends[:-1]]) + np.arange(len(ends))  # of texts, end marks counted
    text = np.searchsorted(begins, start, side="right") - 1
    order = np.lexsort((period, start, text))
    return text[order], (start - begins[text])[order], length[order], period[order]


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(documents: DataFrame, least_length: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT) -> DataFrame:
    """``doc_id, runs, collapsed`` for every document: its runs (``RUNS``, by start, then period), and its words without
    those that a run repeats, joined by one space.

    A run is a stretch of words in which words a period apart are equal, of at least ``least_length`` words and
    ``exponent`` times its smallest period, that can't be longer on either side. Of a run's words the first period stays;
    a word that any run repeats goes. Null and empty texts, and texts of white space, have no runs and an empty result;
    repeated rows are read each; an empty table gives no rows. Texts are read whole, nothing is shuffled, other columns
    are not read.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, text in text_slices(batch, limit=TOGETHER):
                codes, ends, words = split_words(text)
                of, start, length, period = runs_of(codes, ends, least_length, exponent)
                begins = np.concatenate([[0], ends[:-1]])[of] if len(of) else of
                edge = np.zeros(len(codes) + 1, np.int64)
                np.add.at(edge, begins + start + period, 1)
                np.add.at(edge, begins + start + length, -1)
                kept = np.cumsum(edge[:-1]) == 0
                offsets = np.concatenate([[0], np.cumsum(kept)[ends - 1] * (ends > 0)]) if len(codes) else np.zeros(len(text) + 1)
                strings = words.take(pa.array(codes[kept]))
                collapsed = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets.astype(np.int64)), strings), " ")
                per_text = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(text)))])
                runs = pa.ListArray.from_arrays(pa.array(per_text.astype(np.int32)), pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], fields=list(_RUN)))
                yield pa.RecordBatch.from_arrays([rows["doc_id"].combine_chunks().cast(pa.int64()), runs, collapsed.cast(pa.string())], ["doc_id", "runs", "collapsed"])

    return documents.select("doc_id", "text").mapInArrow(find, f"doc_id bigint, runs {RUNS}, collapsed string")


def longest_exponent(runs: Column) -> Column:
    """The run of the greatest length by period (compared exactly; the first of equals), null without runs."""
    better = lambda best, run: F.when(best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best)
    return F.aggregate(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)


def with_repeats(documents: DataFrame) -> DataFrame:
    """``documents`` in which every tenth text, by crc32 of its doc_id, repeats its words from some word on.

    With h the hash, g = floor(h / 10) and n words, where h % 10 = 0 and n > 0 each word i >= a becomes the word
    a + (i - a) % p, a = g % n, p = 1 + floor((n - a) / (3 + g % 8)). A null doc_id has no hash: its text stays, as one
    without words does (n is null then, so nothing is divided by 0).
    """
    h, words, g, n, a, p = (fresh_name(documents, f"_{x}") for x in ("h", "words", "g", "n", "a", "p"))
    out = documents.withColumn(h, F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")))
    out = out.withColumn(words, F.when(F.col(h) % 10 == 0, F.regexp_extract_all(text_or_empty(), F.lit(WORD), F.lit(0))))
    out = out.withColumn(n, F.nullif(F.size(words), F.lit(0))).withColumn(g, F.floor(F.col(h) / 10)).withColumn(a, F.col(g) % F.col(n))
    out = out.withColumn(p, 1 + F.floor((F.col(n) - F.col(a)) / (3 + F.col(g) % 8)))
    repeated = F.array_join(F.transform(words, lambda w, i: F.when(i < F.col(a), w).otherwise(F.get(words, (F.col(a) + (i - F.col(a)) % F.col(p)).cast("int")))), " ")
    return out.withColumn("text", F.when(F.coalesce(F.col(n) > 0, F.lit(False)), repeated).otherwise(F.col("text"))).select(*documents.columns)


def runs_report(documents: DataFrame) -> DataFrame:
    """The runs of ``with_repeats(documents)`` as numbers and digests."""
    found = periodic_runs(with_repeats(documents)).withColumn("best", longest_exponent(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    milli = F.expr("1000 * best.length div best.period")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best, milli.cast("long").alias("exponent_milli"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
