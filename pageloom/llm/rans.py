"""Token ids as binary files: a static range asymmetric numeral system.

A file row is a group: whole documents of about a million ids with one shared frequency table, cut into independent
blocks. A block is coded in many interleaved lanes, which numpy steps together; it has a checksum of its ids and
checkpoints (lane states and place in the stream) from which parts of it decode alone. Groups decode in parallel.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch_path, shuffle_partitions, text_slices
from .tokens import piece_encoder, vocabulary, with_end

#: Bits of the frequency scale; lower bound of a lane's state is 2^31 and words have 32 bits.
SCALE = 18
GROUP, BLOCK, LANES, CHECKPOINT = 1 << 20, 1 << 18, 2048, 64
FORMAT = (
    "part int, group_no int, local_start bigint, n_tokens bigint, doc_ids array<bigint>, doc_tokens array<bigint>, "
    "symbols binary, frequencies binary, blocks array<struct<n:bigint,lanes:int,words:binary,states:binary,marks:array<bigint>,crc:bigint>>"
)


class Table:
    """Frequencies scaled to 2^18 with at least 1 for each symbol that occurs."""

    def __init__(self, symbols: np.ndarray, frequencies: np.ndarray):
        self.symbols, self.frequencies = symbols, frequencies
        self.before = np.cumsum(frequencies) - frequencies

    @classmethod
    def of(cls, ids: np.ndarray) -> Table:
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        counts, scale = counts[symbols], 1 << SCALE
        f = np.maximum(1, counts * scale // counts.sum())
        while (over := int(f.sum()) - scale) != 0:  # what rounding left goes to, or comes from, the largest
            order = np.argsort(-f, kind="stable")
            if over < 0:
                f[order[0]] -= over
            else:
                take = np.minimum(f[order] // 2, over)
                take = np.minimum(take, np.maximum(0, over - (np.cumsum(take) - take)))
                f[order] -= take
        return cls(symbols.astype(np.int64), f.astype(np.int64))

    def dump(self) -> tuple[bytes, bytes]:
        steps = np.diff(self.symbols, prepend=0).astype("<u4")
        return zlib.compress(steps.tobytes(), 1), zlib.compress(self.frequencies.astype("<u4").tobytes(), 1)

    @classmethod
    def load(cls, symbols: bytes, frequencies: bytes) -> Table:
        steps = np.frombuffer(zlib.decompress(symbols), "<u4").astype(np.int64)
        return cls(np.cumsum(steps), np.frombuffer(zlib.decompress(frequencies), "<u4").astype(np.int64))

    def encode(self, ids: np.ndarray) -> dict:
        """One block."""
        n, lanes = len(ids), max(1, min(LANES, len(ids) // 64))
        steps = -(-n // lanes)
        place = np.zeros(int(self.symbols[-1]) + 1, np.int64)
        place[self.symbols] = np.arange(len(self.symbols))
        at = np.full(steps * lanes, int(np.argmax(self.frequencies)), np.int64)  # the last step is filled up
        at[:n] = place[ids]
        f_all = self.frequencies.astype(np.uint64)[at].reshape(steps, lanes)
        c_all = self.before.astype(np.uint64)[at].reshape(steps, lanes)
        x = np.full(lanes, 1 << 31, np.uint64)
        words, states = [], []
        for t in range(steps - 1, -1, -1):
            f = f_all[t]
            full = x >= f << np.uint64(63 - SCALE)
            words.append(x[full].astype("<u4"))
            x = np.where(full, x >> np.uint64(32), x)
            q = x // f
            x = (q << np.uint64(SCALE)) + (x - q * f) + c_all[t]
            if t % CHECKPOINT == 0:
                states.append(x)
        words.reverse()
        sizes = np.cumsum([0, *map(len, words)])
        stream = np.concatenate(words)
        return {
            "n": n, "lanes": lanes, "words": stream.tobytes(), "states": np.concatenate(states[::-1]).astype("<u8").tobytes(),
            "marks": [int(sizes[t]) for t in range(0, steps, CHECKPOINT)], "crc": zlib.crc32(ids.astype("<u4").tobytes()),
        }

    def lookup(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.symbols)), self.frequencies)

    def decode(self, block: dict, lookup: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids of a block, or of its checkpoints ``first`` to before ``last``; a whole block is held against its checksum."""
        n, lanes = block["n"], block["lanes"]
        steps, marks = -(-n // lanes), block["marks"]
        last = len(marks) if last is None else last
        begin, end = first * CHECKPOINT, min(steps, last * CHECKPOINT)
        x = np.frombuffer(block["states"], "<u8")[first * lanes : (first + 1) * lanes].copy()
        stream, at = np.frombuffer(block["words"], "<u4"), marks[first]
        f_of, c_of = self.frequencies.astype(np.uint64), self.before.astype(np.uint64)
        out = np.empty((end - begin, lanes), np.int64)
        low = np.uint64((1 << SCALE) - 1)
        for t in range(end - begin):
            slot = x & low
            s = lookup[slot]
            out[t] = s
            x = f_of[s] * (x >> np.uint64(SCALE)) + slot - c_of[s]
            short = np.flatnonzero(x < np.uint64(1 << 31))
            x[short] = (x[short] << np.uint64(32)) | stream[at : at + len(short)]
            at += len(short)
        ids = self.symbols[out.ravel()].astype("<u4")[: n - begin * lanes]
        if first == 0 and last == len(marks) and zlib.crc32(ids.tobytes()) != block["crc"]:
            raise ValueError("a block's checksum doesn't match its ids")
        return ids


def encode_group(ids: np.ndarray) -> dict:
    table = Table.of(ids)
    symbols, frequencies = table.dump()
    return {"symbols": symbols, "frequencies": frequencies, "blocks": [table.encode(ids[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)]}


def decode_group(row: dict) -> np.ndarray:
    table = Table.load(row["symbols"], row["frequencies"])
    lookup = table.lookup()
    return np.concatenate([table.decode(b, lookup) for b in row["blocks"]])


def write_ids(documents: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0) -> None:
    """Encodes all documents (null text: empty) and writes their ids at ``path`` in ascending doc_id order.

    Files follow each other by ``part``. Null doc_ids come first; rows of one doc_id stand by their text. An empty
    table writes files without groups. Texts are range-partitioned once; each part is streamed, group by group.
    """
    spark = documents.sparkSession
    vocabulary_path = tokenizer or vocabulary("byte_bpe_50k.json")
    ranged = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(shuffle_partitions(spark), "doc_id")
    ranged = ranged.sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id())
    schema = spark.createDataFrame([], FORMAT).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(vocabulary_path)
        held: list[np.ndarray] = []
        ids_of: list[int | None] = []
        sizes: list[int] = []
        start = number = n = 0

        def flush(part: int) -> pa.RecordBatch:
            nonlocal start, number, n, held, ids_of, sizes
            row = {"part": part, "group_no": number, "local_start": start, "n_tokens": n, "doc_ids": ids_of, "doc_tokens": sizes}
            out = pa.RecordBatch.from_pylist([row | encode_group(np.concatenate(held))], arrow)
            start, number, n, held, ids_of, sizes = start + n, number + 1, 0, [], [], []
            return out

        part = 0
        for batch in batches:
            for rows, text in text_slices(batch):
                part = rows["part"][0].as_py()
                ids, ends = with_end(encoder.pieces(text), end_id)
                at = 0
                names = rows["doc_id"].to_pylist()
                while at < len(ends):  # as many whole documents as the group still takes, one at least
                    base = ends[at - 1] if at else 0
                    upto = max(at + 1, int(np.searchsorted(ends, base + GROUP - n, side="right")))
                    held.append(ids[base : ends[upto - 1]])
                    ids_of += names[at:upto]
                    sizes += np.diff(ends[at:upto], prepend=base).tolist() if upto - at > 1 else [int(ends[at] - base)]
                    n += int(ends[upto - 1] - base)
                    at = upto
                    if n >= GROUP * 0.9:
                        yield flush(part)
        if n:
            yield flush(part)

    ranged.mapInArrow(groups, schema).write.option("parquet.block.size", 16 << 20).parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Decodes the files at ``path``: ``doc_id, start, n_tokens, ids`` with ``ids`` as little-endian 32-bit integers."""
    return _read(spark, path, "ids binary", lambda ids: ids.tobytes(), pa.binary())


def read_digest(spark: SparkSession, path: str) -> DataFrame:
    """Decodes the files at ``path``: ``doc_id, start, n_tokens, ids_crc32``."""
    return _read(spark, path, "ids_crc32 bigint", lambda ids: zlib.crc32(ids.tobytes()), pa.int64())


def _read(spark: SparkSession, path: str, column: str, of, kind: pa.DataType) -> DataFrame:
    rows = spark.read.schema(spark.createDataFrame([], FORMAT).schema).parquet(path)
    name = column.split()[0]

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (row,) = batch.slice(k, 1).to_pylist()
                ids = decode_group(row)
                sizes = np.array(row["doc_tokens"], np.int64)
                ends = np.cumsum(sizes)
                if len(ids) != row["n_tokens"] or ends[-1] != len(ids):
                    raise ValueError("a group's documents don't match its ids")
                out = [of(ids[e - s : e]) for s, e in zip(sizes, ends, strict=True)]
                cells = [pa.array([row["part"]] * len(sizes), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["local_start"] + ends - sizes), pa.array(sizes), pa.array(out, kind)]
                yield pa.RecordBatch.from_arrays(cells, ["part", "doc_id", "local_start", "n_tokens", name])

    found = rows.mapInArrow(documents, f"part int, doc_id bigint, local_start bigint, n_tokens bigint, {column}")
    # one row a part: as many as there are files
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return found.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", name)


def round_trip(documents: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    path = path or scratch_path(documents.sparkSession, "token-ids")
    write_ids(documents, path, tokenizer, end_id)
    return read_digest(documents.sparkSession, path)
