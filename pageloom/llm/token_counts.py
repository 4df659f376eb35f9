"""Edit-aware token counts: segment trees over a document's pre-token pieces, kept in a table.

A tree holds the lengths (in code points) and numbers of ids of a document's leaves of about ``LEAF`` pieces, under a
binary tree of sums of both. ``make_trees`` encodes whole texts once; its rows are a table to be written.
``edit_trees`` takes rows of that table with edits and returns the next table: an edit descends to the leaves that it
touches, encodes these and a piece of context on either side, where pieces can merge or part, and updates the sums on
the paths to the root. Leaves take up what an edit adds until they are twice their size; only then is the tree laid
out anew, from kept numbers and without encoding.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices, written
from .tokens import piece_encoder, tokenizer, vocabulary

LEAF = 32
#: Pieces: white space with the run after it. The tokenizer cuts before white space that follows other characters, so
#: the ids of a text are those of its pieces in turn. (``\s`` is Unicode white space here as there.)
PIECE = re.compile(r"\s*\S+|\s+")


@dataclass
class CountTree:
    """Counts of one text. ``chars``, ``tokens``: binary trees of sums in heap order (the root at 1, at 0 the number of
    leaves); the lower half are the leaves' lengths and numbers of ids."""

    text: str
    chars: list[int] = field(default_factory=lambda: [0, 0])
    tokens: list[int] = field(default_factory=lambda: [0, 0])

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def leaves(self) -> int:
        return self.tokens[0]

    def leaf_values(self, tree: list[int]) -> list[int]:
        half = len(tree) // 2
        return tree[half : half + self.leaves]

    def lay_out(self, chars: list[int], tokens: list[int]) -> None:
        """All sums from the leaves."""
        size = 1
        while size < max(1, len(tokens)):
            size *= 2
        for tree, values in (("chars", chars), ("tokens", tokens)):
            sums = [0] * size + values + [0] * (size - len(values))
            for i in range(size - 1, 0, -1):
                sums[i] = sums[2 * i] + sums[2 * i + 1]
            sums[0] = len(values)
            setattr(self, tree, sums)

    def set_leaf(self, leaf: int, chars: int, tokens: int) -> None:
        """Updates a leaf and its path to the root."""
        for tree, value in ((self.chars, chars), (self.tokens, tokens)):
            i = len(tree) // 2 + leaf
            change = value - tree[i]
            while i and change:
                tree[i] += change
                i //= 2

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds the code point at ``place`` (the last one beyond), and where it starts."""
        i, half, start = 1, len(self.chars) // 2, 0
        last = half + self.leaves - 1
        while i < half:
            i *= 2
            if place - start >= self.chars[i] and (i + 1) << (half.bit_length() - (i + 1).bit_length()) <= last:
                start += self.chars[i]
                i += 1
        return i - half, start

    def prefix(self, leaves: int) -> int:
        """Ids of the first ``leaves`` leaves, from the tree."""
        if leaves >= self.leaves:
            return self.total
        i, total = len(self.tokens) // 2 + leaves, 0
        while i > 1:
            if i % 2:
                total += self.tokens[i - 1]
            i //= 2
        return total


class Counter:
    """Makes and edits trees with one tokenizer; ``count`` gives the numbers of ids of texts."""

    def __init__(self, count):
        self.count = count

    @staticmethod
    def cut(text: str, leaves: int = 0) -> list[str]:
        """The text in leaves of ``LEAF`` pieces; with ``leaves``, in so many if none then has more than twice that."""
        ends = [m.end() for m in PIECE.finditer(text)]
        n = len(ends)
        if leaves and leaves <= n <= 2 * LEAF * leaves:
            ends = [ends[n * (k + 1) // leaves - 1] for k in range(leaves)]
        elif n:
            ends = ends[LEAF - 1 :: LEAF] if n % LEAF == 0 else [*ends[LEAF - 1 :: LEAF], ends[-1]]
        return [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []

    def trees(self, texts: list[str]) -> list[CountTree]:
        """Trees of texts, encoded together."""
        leaves = [self.cut(t) for t in texts]
        counts = iter(self.count([x for own in leaves for x in own]))
        out = []
        for text, own in zip(texts, leaves, strict=True):
            tree = CountTree(text)
            tree.lay_out([len(x) for x in own], [next(counts) for _ in own])
            out.append(tree)
        return out

    def edit(self, tree: CountTree, start: int, end: int, new: str) -> int:
        """Replaces code points ``start`` to before ``end``; returns how many code points were encoded again."""
        (size,) = self.edit_many([(tree, start, end, new)])
        return size

    def edit_many(self, edits: list[tuple[CountTree, int, int, str]]) -> list[int]:
        """One edit in each of several trees, encoded together."""
        plans, wanted = [], []
        for tree, start, end, new in edits:
            size = len(tree.text)
            start = max(0, min(start, size))
            end = max(start, min(end, size))
            # a piece of context on either side: the leaf of the character before the edit, and of the second one after
            # its leaf ends
            first, begin = tree.find(max(0, start - 1))
            if first and start <= begin + 1:
                first, begin = tree.find(begin - 1)
            last, stop = tree.find(end)
            stop = min(size, stop + tree.chars[len(tree.chars) // 2 + last])
            if last + 1 < tree.leaves:
                last += 1
                stop += tree.chars[len(tree.chars) // 2 + last]
            region = tree.text[begin:start] + new + tree.text[end:stop]
            tree.text = tree.text[:start] + new + tree.text[end:]
            span = last + 1 - first if tree.leaves else 0
            own = self.cut(region, span)
            plans.append((tree, first, span, own, len(region)))
            wanted += own
        counts = iter(self.count(wanted))
        for tree, first, span, own, _ in plans:
            got, sizes = [next(counts) for _ in own], [len(x) for x in own]
            if len(own) == span:
                for k in range(span):
                    tree.set_leaf(first + k, sizes[k], got[k])
            else:
                chars, tokens = tree.leaf_values(tree.chars), tree.leaf_values(tree.tokens)
                chars[first : first + span], tokens[first : first + span] = sizes, got
                tree.lay_out(chars, tokens)
        return [p[-1] for p in plans]


def exact_counter(path: str):
    """Numbers of ids by the tokenizer itself (for single texts and tests)."""
    t = tokenizer(path)
    return lambda texts: [len(e.ids) for e in t.encode_batch_fast(texts, add_special_tokens=False)]


def piece_counter(path: str):
    """Numbers of ids through the store of known pieces."""
    encoder = piece_encoder(path)

    def count(texts: list[str]) -> list[int]:
        return np.diff(encoder.pieces(pa.array(texts, pa.string())).text_ends(), prepend=0).tolist()

    return count


TREE = "doc_id {kind}, text string, chars array<int>, tokens array<int>, recoded_chars bigint"
EDIT = "array<struct<start:bigint,end:bigint,text:string>>"


def _rows(ids: pa.Array, trees: list[CountTree], recoded: list[int]) -> pa.RecordBatch:
    kind = pa.list_(pa.int32())
    cells = [ids, pa.array([t.text for t in trees], pa.string()), pa.array([t.chars for t in trees], kind), pa.array([t.tokens for t in trees], kind), pa.array(recoded, pa.int64())]
    return pa.RecordBatch.from_arrays(cells, ["doc_id", "text", "chars", "tokens", "recoded_chars"])


def make_trees(documents: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """A table of trees: ``doc_id, text, chars, tokens, recoded_chars`` (here all of the text's), a row for each document.

    Null and empty texts have an empty text and no leaves; repeated rows have a tree each; an empty table gives none.
    """
    path = tokenizer_path or vocabulary("byte_bpe_50k.json")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(piece_counter(path))
        for batch in batches:
            for rows, text in text_slices(batch):
                trees = counter.trees(text.to_pylist())
                yield _rows(rows["doc_id"].combine_chunks(), trees, [len(t.text) for t in trees])

    return documents.select("doc_id", "text").mapInArrow(made, TREE.format(kind=dict(documents.dtypes)["doc_id"]))


def edit_trees(trees: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """The next table of trees, from one with a column ``edits`` (arrays of ``start, end, text``, taken in turn; null: none).

    Places are code points of the text as the edits before left it; what lies beyond the text is cut to it.
    recoded_chars: code points that were encoded again. Rows without edits are passed on.
    """
    path = tokenizer_path or vocabulary("byte_bpe_50k.json")

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(piece_counter(path))
        for batch in batches:
            for rows, text in text_slices(batch):
                columns = (text.to_pylist(), rows["chars"].to_pylist(), rows["tokens"].to_pylist())
                own = [CountTree(*x) for x in zip(*columns, strict=True)]
                edits = [x or [] for x in rows["edits"].to_pylist()]
                recoded = [0] * len(own)
                for turn in range(max(map(len, edits), default=0)):
                    those = [i for i, x in enumerate(edits) if len(x) > turn]
                    sizes = counter.edit_many([(own[i], (x := edits[i][turn])["start"], x["end"], x["text"] or "") for i in those])
                    for i, size in zip(those, sizes, strict=True):
                        recoded[i] += size
                yield _rows(rows["doc_id"].combine_chunks(), own, recoded)

    kind = dict(trees.dtypes)["doc_id"]
    changed = trees.where("size(edits) > 0").select("doc_id", "text", "chars", "tokens", "edits").mapInArrow(edited, TREE.format(kind=kind))
    same = trees.where("edits is null or size(edits) = 0").select("doc_id", "text", "chars", "tokens", F.lit(0).cast("long").alias("recoded_chars"))
    return changed.unionByName(same)


def with_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """``trees`` with the edits of a table ``doc_id, seq, start, end, text``, by ``seq``. All rows of a doc_id get them."""
    own = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "text").alias("edit")))).alias("edits"))
    return trees.join(own.select("doc_id", F.transform("edits", lambda e: e["edit"]).alias("edits")), "doc_id", "left")


def count_tokens(documents: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, n_leaves, edit_start, edited_tokens, recoded_chars`` for every document.

    ``documents`` may have columns ``edit_start``, ``edit_end`` (code points) and ``edit_text``: an edit that is
    applied to the kept tree (null: none). Without these columns nothing is edited. Null and empty texts have no ids and
    no leaves; repeated rows are counted each; an empty table gives no rows. Places beyond the text are cut to it.
    """
    for name, kind in (("edit_start", "long"), ("edit_end", "long"), ("edit_text", "string")):
        if name not in documents.columns:
            documents = documents.withColumn(name, F.lit(None).cast(kind))
    start = F.col("edit_start").cast("long")
    edit = F.struct(start.alias("start"), F.coalesce(F.col("edit_end").cast("long"), start).alias("end"), F.col("edit_text").alias("text"))
    named = documents.select(F.struct("doc_id", F.when(start.isNotNull(), F.array(edit)).alias("edits")).alias("doc_id"), "text")
    trees = written(make_trees(named, tokenizer_path), "trees")
    found = edit_trees(trees.withColumn("edits", F.col("doc_id.edits")).withColumn("doc_id", F.struct(F.col("doc_id.doc_id").alias("doc_id"), F.col("doc_id.edits").alias("edits"), F.element_at("tokens", 2).alias("n_tokens"), F.element_at("tokens", 1).alias("n_leaves"))), tokenizer_path)
    named = F.col("doc_id")
    return found.select(
        named["doc_id"].alias("doc_id"),
        named["n_tokens"].cast("long").alias("n_tokens"),
        named["n_leaves"].cast("long").alias("n_leaves"),
        F.get(named["edits"], F.lit(0))["start"].alias("edit_start"),
        F.element_at("tokens", 2).cast("long").alias("edited_tokens"),
        "recoded_chars",
    )


def with_middle_edit(documents: DataFrame, chars: int = 24, new: str = " edited\n") -> DataFrame:
    """A stated edit for every document: ``chars`` code points from the middle on are replaced by ``new``."""
    middle = F.floor(F.length(F.coalesce("text", F.lit(""))) / 2).cast("long")
    return documents.select("doc_id", "text", middle.alias("edit_start"), (middle + chars).alias("edit_end"), F.lit(new).alias("edit_text"))
