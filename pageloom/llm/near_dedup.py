"""MinHash near-dedup: bottom-k sketches from one hash function, inverted lists, exact Jaccard.

1. Each document's distinct shingles are hashed once; in hash order its least ``K`` values are its sketch.
2. Inverted lists are kept by runs of 5 values that follow each other in a sketch. Of the union of two sets with
   similarity 0.8 every value is shared with probability 0.8 independently of its place in hash order, so two such
   sketches of 192 values lack a common run with a probability of some 1e-8. Sets of up to 160 values lie whole in
   their sketch and have runs of 4 (3 or 2 if very small), of which one is always shared: a fifth of the union at most
   lies between runs. Unrelated texts share a run with the fifth power of their similarity, so common words make no
   long lists. Of larger sets the 96 runs with the least keys are kept.
   Linked texts share not one run but many: two sets of up to 160 values a tenth and more of their runs for certain,
   larger ones 30 runs in the mean and fewer than 4 with a probability of about 1e-6. So each text leaves the longest of
   its lists, one less than the runs it is to share: in the order of length, then key, the least list that two linked
   texts share is kept by both. A common passage's lists thus vanish unless the passage is most of a text.
3. Labels say which texts are in one component for certain; equal sets share one from the start. In four rounds an
   eighth or a quarter of the lists, if they hold several labels (in the last two, several clusters; see below), compare
   their members with one of them, the head (first the one with most copies, then others): as many pairs as members. The union of the two sketches rejects pairs clearly below the threshold, full sets confirm the
   others, and confirmed links join labels. A large group of near copies is then one label.
4. Pairs that may be linked, confirmed or not, give clusters. In lists that still hold several clusters all pairs of
   different ones are met: those of a short list one by one, a long one in blocks, in which the union sketches of all
   pairs are taken; pairs that may be linked join clusters. So any two linked texts are in one cluster.
5. Inside each cluster full sets are compared between different labels, in blocks. Blocks of a cluster's (list's) largest
   label meet those of other labels only. Nothing is left out; a task's memory is bounded by two blocks, and only texts
   that are in nobody else's label cost the square of their number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_name, join_groups, mix64, split_words, text_slices, written
from .components import connected_components

K, SKETCH = 192, 64
#: Of a large set's runs those with the least keys are kept: so many. Sets of up to WHOLE values keep all.
KEYS, WHOLE = 96, 160
#: Runs by set size: length, least and largest size. Links join sizes that differ by a fifth at most, so classes overlap.
RUNS = ((5, 128, 1 << 62), (4, 4, WHOLE), (3, 3, 24), (2, 2, 8), (1, 1, 2))
#: Runs that linked texts share at least, by length: a part of a set's size, rounded up, less a number (of large sets just a
#: number). Of a union of u values b <= u / 5 are in one set alone and leave u - b - (run - 1) * (b + 1) runs of the others.
SHARED = {5: (0.0, -4), 4: (0.2, 3), 3: (0.4, 3), 2: (0.6, 2), 1: (0.0, -1)}
#: Rounds of heads: each takes one key in so many, those with this remainder; no link rests on them.
ROUNDS = ((8, 0), (8, 1), (4, 2), (4, 3))
#: Lists up to this length pair all members one by one.
SHORT = 12
#: Estimated similarity below which a pair isn't compared by full sets (links have 0.8).
MAY_BE = 0.55
#: Texts in one block of comparisons: the least and most, and how often a text is copied at most before blocks grow to the most.
BLOCK, LARGEST_BLOCK, COPIES = 256, 512, 16
#: Up to so many doc_ids (of 8 bytes) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def word_hashes(words: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()], np.uint64) if len(words) else np.zeros(0, np.uint64)


def shingle_sets(text: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes, ascending, end to end, and each text's end in them.

    Words are lower-cased (A-Z). Fewer words than a shingle's are one shingle; a text without words has none.
    """
    codes, ends, words = split_words(text, lower=True)
    h = word_hashes(words)[codes] if len(codes) else np.zeros(0, np.uint64)
    sizes = np.diff(ends, prepend=0)
    n = np.where(sizes >= shingle, sizes - shingle + 1, np.minimum(sizes, 1))
    doc = np.repeat(np.arange(len(sizes)), n)
    at = np.repeat(ends - sizes, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    value = np.zeros(len(at), np.uint64)
    length = np.minimum(sizes, shingle)[doc]
    with np.errstate(over="ignore"):
        for k in range(shingle):
            has = k < length
            value[has] = mix64(value[has] * np.uint64(3) + h[at[has] + k] + np.uint64(k + 1))
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    first = np.ones(len(value), bool)
    first[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[first], doc[first]
    return value, np.cumsum(np.bincount(doc, minlength=len(sizes)))


def run_keys(values: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of inverted lists and the row that each is of.

    Runs by ``RUNS`` among each row's first K, ascending; of large sets the KEYS least keys are kept. The longest run that
    is certain is shorter in small sets; below 3 values only equal sets are linked.
    """
    sizes = np.diff(ends, prepend=0)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    rank = np.arange(len(values)) - np.repeat(ends - sizes, sizes)
    kept = rank < K
    values, doc, rank, n = values[kept], doc[kept], rank[kept], np.minimum(sizes, K)[doc[kept]]
    size = sizes[doc]
    keys, rows = [], []
    for run, least, most in RUNS:
        at = np.flatnonzero((rank + run <= n) & (size >= least) & (size <= most))
        if not len(at):
            continue
        key = np.full(len(at), run, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(run):
                key = mix64(key * np.uint64(5) + values[at + k])
        keys.append(key & ~np.uint64(7) | np.uint64(run))  # the last three bits tell the length
        rows.append(doc[at])
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, rows = np.concatenate(keys), np.concatenate(rows)
    order = np.lexsort((keys, rows))
    keys, rows = keys[order], rows[order]
    counts = np.bincount(rows, minlength=len(sizes))
    least = np.arange(len(keys)) - np.repeat(np.cumsum(counts) - counts, counts) < KEYS
    least |= sizes[rows] <= WHOLE
    return keys[least], rows[least]


def describe(documents: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, n, digest, sketch, keys`` of every document. A set that came before in its slice has no keys of its own."""
    schema = "doc_id bigint, n bigint, digest binary, sketch binary, keys array<bigint>"

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, text in text_slices(batch):
                ids = rows["doc_id"].combine_chunks().cast(pa.int64())
                values, ends = shingle_sets(text, shingle)
                sizes = np.diff(ends, prepend=0)
                starts = ends - sizes
                raw = memoryview(values.tobytes())
                digests = [xxhash.xxh3_128_digest(raw[8 * s : 8 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                short = (values >> np.uint64(32)).astype("<u4").tobytes()
                sketches = [short[4 * s : 4 * min(e, s + SKETCH)] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                keys, of = run_keys(values, ends)
                counts = np.bincount(of, minlength=len(digests))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(keys.view(np.int64)))
                cells = [ids, pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary()), lists]
                yield pa.RecordBatch.from_arrays(cells, ["doc_id", "n", "digest", "sketch", "keys"])

    return documents.select("doc_id", "text").mapInArrow(described, schema)


def padded(sketches: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sketches as rows of SKETCH numbers, filled up with 2^40, and their sizes."""
    sizes = pc.binary_length(sketches).to_numpy(zero_copy_only=False).astype(np.int64) // 4
    table = np.full((len(sizes), SKETCH), 1 << 40, np.int64)
    of = np.repeat(np.arange(len(sizes)), sizes)
    table[of, np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.frombuffer(b"".join(sketches.to_pylist()), "<u4")
    return table, sizes


def estimate(a: np.ndarray, size_a: np.ndarray, b: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Similarity by the union sketch, row by row: of the least SKETCH values of both, the part that both have."""
    table = np.sort(np.concatenate([a, b], axis=1), axis=1)
    real = table < 1 << 40
    twice = (table[:, 1:] == table[:, :-1]) & real[:, 1:]
    distinct = real.copy()
    distinct[:, 1:] &= ~twice
    rank = np.cumsum(distinct, axis=1)
    # a sketch that is not full is the whole set, so the union may count all of its values
    limit = np.where(np.maximum(size_a, size_b) < SKETCH, 2 * SKETCH, SKETCH)[:, None]
    shared = (twice & (rank <= limit)[:, 1:]).sum(1)
    return shared / np.maximum(np.minimum(rank[:, -1], limit[:, 0]), 1)


def sizes_fit(a: str, b: str) -> Column:
    """Set sizes that allow a link."""
    return 5 * F.least(F.col(a), F.col(b)) >= 4 * F.greatest(F.col(a), F.col(b))


def likely(pairs: DataFrame, sides: DataFrame) -> DataFrame:
    """Pairs ``a, b`` whose estimate reaches MAY_BE; ``sides`` has ``doc_id, sketch``. A head of very many pairs is a skewed join."""

    def of(name: str) -> DataFrame:
        return sides.select(F.col("doc_id").alias(name), F.col("sketch").alias(f"sketch_{name}"))

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (a, size_a), (b, size_b) = padded(batch.column("sketch_a")), padded(batch.column("sketch_b"))
            keep = pa.array(estimate(a, size_a, b, size_b) >= MAY_BE)
            yield batch.select(["a", "b"]).filter(keep)

    both = pairs.join(of("b"), "b").join(of("a"), "a")
    return both.select("a", "b", "sketch_a", "sketch_b").mapInArrow(filtered, "a bigint, b bigint")


def full_sets(documents: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, values``: the whole shingle sets of the documents named by ``ids`` (distinct doc_ids)."""
    few = ids.count() <= BROADCAST_ROWS
    texts = documents.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, text in text_slices(batch):
                values, ends = shingle_sets(text, shingle)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([rows["doc_id"].combine_chunks().cast(pa.int64()), lists], ["doc_id", "values"])

    return texts.select("doc_id", "text").mapInArrow(sets, "doc_id bigint, values array<bigint>")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` that full sets confirm, one by one."""

    def of(name: str) -> DataFrame:
        return sets.select(F.col("doc_id").alias(name), F.col("values").alias(f"set_{name}"))

    both = pairs.join(of("b"), "b").join(of("a"), "a")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(100 * shared >= percent * (F.size("set_a") + F.size("set_b") - shared)).select("a", "b")


class Block:
    """Texts of one task: ``ids``, ``labels``, ``sizes`` and their ``values`` end to end.

    ``other``: 0 compares all texts, otherwise the first ``other`` with the rest.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, sizes: np.ndarray, values: np.ndarray, other: int):
        self.ids, self.sizes, self.other, self.values = ids, sizes, other, values
        self.names, self.labels = np.unique(labels, return_inverse=True)

    def joined(self, good: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
        """Pairs of ids that join the labels: a spanning forest of the pairs with different labels that ``good`` accepts, given
        a text, the places of others that share a value with it, and how many values they share."""
        n = len(self.ids)
        doc = np.repeat(np.arange(n), self.sizes)
        order = np.argsort(self.values, kind="stable")
        value, doc = self.values[order], doc[order]
        cut = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
        length = np.diff(np.r_[cut, len(value)])
        term = np.empty(len(value), np.int64)
        term[order] = np.repeat(np.arange(len(cut)), length)  # each text's terms, in its own order
        offsets = np.r_[0, np.cumsum(self.sizes)]
        root = np.arange(len(self.names))  # of each label
        out = []
        for i in range(self.other or n):
            terms = term[offsets[i] : offsets[i + 1]]
            k = length[terms]
            terms, k = terms[k > 1], k[k > 1]
            shared = np.bincount(doc[np.repeat(cut[terms] - np.cumsum(k) + k, k) + np.arange(k.sum())], minlength=n)
            there = np.flatnonzero(shared)
            there = there[(there >= self.other if self.other else there > i) & (root[self.labels[there]] != root[self.labels[i]])]
            if not len(there):
                continue
            for j in there[good(i, there, shared[there])].tolist():
                x, y = root[self.labels[i]], root[self.labels[j]]
                if x != y:
                    root[root == y] = x
                    out.append((int(self.ids[i]), int(self.ids[j])))
        return out


def in_blocks(rows: DataFrame, group: str, block: int) -> DataFrame:
    """Deals rows ``group, label, doc_id, ...`` (``n``, if given, is a set's size) to tasks (columns ``task``, ``low``, ``high``, ``block``) so that any two rows of a
    group with different labels meet in one.

    Blocks of the largest label's rows meet those of all others, whose blocks also meet each other; a row of the
    largest label is copied once for each block of others. Blocks grow with the group so that others fill COPIES of them;
    from COPIES * LARGEST_BLOCK others on they stay as large as that, and the number of copies grows.
    """
    counts = rows.groupBy(group, "label").agg(F.count(F.lit(1)).alias("n_label"))
    tops = counts.groupBy(group).agg(F.max(F.struct("n_label", "label")).alias("top"), F.sum("n_label").alias("n_all"))
    others = F.col("n_all") - F.col("top.n_label")
    size = F.least(F.lit(max(block, LARGEST_BLOCK)), F.greatest(F.lit(block), F.ceil(others / COPIES)))
    small = F.col("n_all") <= 2 * size
    tops = tops.select(
        group,
        F.col("top.label").alias("top"),
        small.alias("small"),
        F.when(small, 1).otherwise(F.ceil(others / size)).cast("int").alias("others"),
        F.when(small, 0).otherwise(F.ceil(F.col("top.n_label") / size)).cast("int").alias("own"),
    )
    dealt = rows.join(written(tops, "near-tops"), group)
    largest = F.col("label") == F.col("top")
    if "n" in rows.columns:  # of the largest label only sizes that any of the others could be linked with
        spans = dealt.where(~largest).groupBy(group).agg(F.min("n").alias("least"), F.max("n").alias("most"))
        dealt = dealt.join(written(spans, "near-spans"), group)
        dealt = dealt.where(~largest | ((5 * F.col("n") >= 4 * F.col("least")) & (4 * F.col("n") <= 5 * F.col("most")))).drop("least", "most")
    inside = largest & ~F.col("small")
    draw = F.xxhash64("doc_id")
    dealt = dealt.withColumn("block", F.when(inside, F.col("others") + F.pmod(draw, F.col("own"))).otherwise(F.pmod(draw, F.col("others"))).cast("int"))
    partners = F.sequence(F.lit(0), F.when(inside, F.col("others")).otherwise(F.col("others") + F.col("own")) - 1)
    dealt = dealt.withColumn("_with", F.explode(partners)).withColumn("low", F.least("block", "_with")).withColumn("high", F.greatest("block", "_with"))
    return dealt.withColumn("task", F.xxhash64(group, "low", "high")).drop("_with", "top", "small", "others", "own")


def block_links(dealt: DataFrame, payload: str, links: Callable[[pa.Table, int], list[tuple[int, int]]]) -> DataFrame:
    """``a, b``: what ``links`` finds in each task of ``in_blocks``, given its rows by block and the number of the first block's."""
    rows = dealt.select("task", "low", "high", "block", "doc_id", "label", payload).repartition("task").sortWithinPartitions("task", "block", "doc_id")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(task: pa.Table) -> pa.RecordBatch:
            low, high = task["low"][0].as_py(), task["high"][0].as_py()
            first = int(pc.sum(pc.equal(task["block"], low)).as_py())
            # a task of two blocks of which one has no rows has nothing to compare; both compare their own elsewhere
            some = task.num_rows > 1 and (low == high or 0 < first < task.num_rows)
            pairs = links(task, 0 if low == high else first) if some else []
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in range(2)], ["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            tasks = batch.column("task").to_numpy()
            cuts = [0, *(np.flatnonzero(tasks[1:] != tasks[:-1]) + 1).tolist(), len(tasks)]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                if held and end > begin and held[-1].column("task")[0].as_py() != tasks[begin]:
                    yield of(pa.Table.from_batches(held))
                    held = []
                if end > begin:
                    held.append(batch.slice(begin, end - begin))
        if held:
            yield of(pa.Table.from_batches(held))

    return rows.mapInArrow(found, "a bigint, b bigint")


def sketch_links(task: pa.Table, other: int) -> list[tuple[int, int]]:
    """Pairs of a task that may be linked, by union sketches."""
    table, sizes = padded(task["sketch"].combine_chunks())
    block = Block(task["doc_id"].to_numpy(), task["label"].to_numpy(), sizes, table[table < 1 << 40], other)

    def good(i: int, there: np.ndarray, shared: np.ndarray) -> np.ndarray:
        mine = np.broadcast_to(table[i], (len(there), SKETCH))
        return estimate(mine, np.full(len(there), sizes[i]), table[there], sizes[there]) >= MAY_BE

    return block.joined(good)


def set_links(percent: int) -> Callable[[pa.Table, int], list[tuple[int, int]]]:
    """Pairs of a task that are linked, by full sets."""

    def links(task: pa.Table, other: int) -> list[tuple[int, int]]:
        lists = task["values"].combine_chunks()
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        block = Block(task["doc_id"].to_numpy(), task["label"].to_numpy(), sizes, lists.flatten().to_numpy(), other)
        return block.joined(lambda i, there, shared: 100 * shared >= percent * (sizes[there] + sizes[i] - shared))

    return links


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with the ``label`` of their doc_id: its component, or itself."""
    to = labels.select(F.col("node").alias("doc_id"), F.col("component").alias("label"))
    return rows.join(to, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (``node, component``; other nodes are their own) after ``links`` have joined some. Only labels that links name are solved."""
    links = written(links, "near-links")
    if links.isEmpty():
        return labels
    for side in ("a", "b"):
        to = labels.select(F.col("node").alias(side), "component")
        links = links.join(to, side, "left").withColumn(side, F.coalesce("component", side)).drop("component")
    joined = written(connected_components(links), "near-joined")
    old = labels.join(joined.select(F.col("node").alias("component"), F.col("component").alias("_to")), "component", "left")
    old = old.select("node", F.coalesce("_to", "component").alias("component"))
    return written(old.unionByName(joined.join(labels, "node", "left_anti")), "near-labels")


def mixed(rows: DataFrame, group: str, head: Column) -> DataFrame:
    """Of groups that hold several labels: ``group, size, head`` (the greatest of a struct). Written, as are the other sides of
    joins on a group: so both sides are plain shuffles, of which Spark splits the parts that a hot group fills."""
    found = rows.groupBy(group).agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size"), F.max(head).alias("head"))
    return written(found.where("lo < hi").select(group, "size", "head"), "near-mixed")


def linked_sets(documents: DataFrame, usable: DataFrame, reps: DataFrame, labels: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``labels`` joined by the links between different sets."""
    # one row for each set, then lists of two members at least
    one = usable.withColumnRenamed("digest", "_digest").join(reps, (F.col("doc_id") == F.col("rep")) & (F.col("_digest") == F.col("digest")))
    postings = written(one.select(F.explode("keys").alias("key"), "doc_id", "n", "copies"), "near-postings")
    shared = written(postings.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "near-shared")
    longest = Window.partitionBy("doc_id", "run").orderBy(F.desc("size"), F.desc("key"))
    lists = postings.join(shared, "key").withColumn("run", F.col("key").bitwiseAND(F.lit(7))).withColumn("rank", F.row_number().over(longest))
    left_out = F.greatest(F.coalesce(*[F.when(F.col("run") == r, F.ceil(F.col("n") * part) - less) for r, (part, less) in SHARED.items()]), F.lit(1)) - 1
    lists = written(lists.where(F.col("rank") > left_out).select("key", "doc_id", "n", "copies"), "near-lists")
    if lists.isEmpty():
        return labels
    sides = usable.select("doc_id", "sketch")
    sets = written(full_sets(documents, written(lists.select("doc_id").distinct(), "near-members"), shingle), "near-sets")

    clusters = labels
    for turn, (many, rest) in enumerate(ROUNDS):
        # first the member with most copies, then another one each time
        head = F.struct("copies", -F.col("doc_id"), "doc_id", "label", "n") if not turn else F.struct(F.xxhash64("doc_id", F.lit(turn)), "doc_id", "label", "n")
        # first links are looked for; later what may be linked, of which nothing more is to learn inside a cluster
        now = labelled(lists.where(f"pmod(shiftright(key, 3), {many}) = {rest}"), labels if turn < 2 else clusters)
        pairs = now.join(mixed(now, "key", head), "key").where(F.col("label") != F.col("head.label")).where(sizes_fit("n", "head.n"))
        maybe = written(likely(pairs.select(F.col("head.doc_id").alias("a"), F.col("doc_id").alias("b")).distinct(), sides), "near-likely")
        labels = merged(labels, linked(maybe, sets, percent))
        clusters = merged(clusters, maybe)

    # lists that hold several clusters still: all pairs of different ones
    now = labelled(lists, clusters)
    left = written(now.join(mixed(now, "key", F.lit(0)).drop("head"), "key").select("key", "doc_id", "label", "n", "size"), "near-left")
    few = left.where(f"size <= {SHORT}").groupBy("key").agg(F.collect_list(F.struct("doc_id", "label", "n")).alias("m"))
    both = few.select(F.explode("m").alias("x"), "m").select("x", F.explode("m").alias("y")).where("x.doc_id < y.doc_id and x.label <> y.label").where(sizes_fit("x.n", "y.n"))
    maybe = likely(both.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct(), sides)
    long = left.where(f"size > {SHORT}").select("key", "doc_id", "label", "n")
    if not long.isEmpty():
        maybe = maybe.unionByName(block_links(in_blocks(long, "key", BLOCK).join(sides, "doc_id"), "sketch", sketch_links))
    clusters = merged(clusters, maybe).withColumnRenamed("node", "doc_id")
    inside = written(labelled(clusters, labels), "near-inside")
    inside = inside.join(mixed(inside, "component", F.lit(0)).select("component"), "component").select("component", "doc_id", "label")
    dealt = in_blocks(inside, "component", BLOCK).join(sets, "doc_id")
    return merged(labels, block_links(dealt, "values", set_links(percent)))


def near_components(documents: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked if the similarity of their shingle sets is at least ``percent`` / 100, confirmed on full sets;
    component_id is the smallest doc_id reachable, kept says that it is the document's own. Texts without words (null,
    empty) are linked with nothing; nor are rows with a null doc_id, whose component_id is null and which are kept.
    Repeated rows of one doc_id stand or go together. An empty table gives no rows. Whole texts are read. The lists find
    links from 80 percent on, so a smaller ``percent`` is an error.
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent must be 80 to 100")
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = written(describe(documents, shingle), "near-described")
    usable = described.where("n > 0 and doc_id is not null")
    reps = written(usable.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "near-reps")
    total = described.count()
    several = reps.where("copies > 1")
    same = join_groups(usable.select("digest", "doc_id"), several, "digest", "copies", total).where("doc_id <> rep").select("doc_id", "rep").distinct()
    # a doc_id with several texts stands for all of them
    same = written(same.groupBy("doc_id").agg(F.min("rep").alias("rep"), F.collect_set("rep").alias("reps")), "near-same")
    tied = same.where("size(reps) > 1").select(F.explode("reps").alias("a"), F.col("rep").alias("b"))
    labels = merged(written(same.limit(0).select(F.col("doc_id").alias("node"), F.col("rep").alias("component")), "near-labels"), tied)
    labels = linked_sets(documents, usable, reps, labels, shingle, percent)

    # copies get their representative's component; a representative of very many by a bounded broadcast
    groups = several.groupBy("rep").agg(F.sum("copies").alias("copies")).join(labels, F.col("rep") == F.col("node"), "left")
    groups = written(groups.select("rep", "copies", F.coalesce("component", "rep").alias("component")), "near-groups")
    copies = join_groups(same.select("doc_id", "rep"), groups, "rep", "copies", total).select(F.col("doc_id").alias("node"), "component")
    found = labels.join(copies.select("node"), "node", "left_anti").unionByName(copies)
    ids = described.select("doc_id", "n").join(found, F.col("doc_id") == F.col("node"), "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return ids.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(documents: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay, one of each component, with their columns."""
    name = fresh_name(documents, "gone")
    gone = near_components(documents, shingle, percent).where("not kept").select(F.col("doc_id").alias(name)).distinct()
    return documents.join(written(gone, "near-gone"), documents["doc_id"].cast("long") == F.col(name), "left_anti")
