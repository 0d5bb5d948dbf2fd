"""Word-sequence hashes of all documents, dealt to shards by hash as packed blocks.

A block holds the hashes that one run of texts sends to one shard, in the order of the texts: a key and a count for
each text, then eight bytes a hash. Spark shuffles blocks; a shard is a bounded range of hash values, merged in one
task. Sequences so frequent that they alone would fill a shard are found beforehand on a sample of the documents and
treated apart by the callers; the sample decides only the route, never the result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .tokens import U64

#: Hashes of a shard, about. A task holds one shard at a time. More and smaller shards would cost more bytes: each text
#: has a key in each shard that it reaches.
SHARD_HASHES = 3_000_000
#: Partitions of a shuffle of blocks, at most; with more shards a partition holds a range of them, one after another.
MAX_PARTITIONS = 20_000
#: Frequent sequences, at most: those with over 1 / MAX_HOT of all hashes in the sample.
MAX_HOT = 20_000
SAMPLE = 16
MIN_SAMPLE_COUNT = 24
#: Bytes of text behind one block for each shard: as many as give a block some thousand bytes, within these bounds.
BLOCK_BYTES, MAX_BLOCK_BYTES = 8 << 20, 48 << 20


def block_bytes(shards: int) -> int:
    return min(MAX_BLOCK_BYTES, max(BLOCK_BYTES, shards << 11))


def shard_count(docs: DataFrame, text_col: str = "text") -> int:
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(1, math.ceil(total / 6 / SHARD_HASHES))


def hot_hashes(docs: DataFrame, hashes: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], id_col: str, text_col: str = "text") -> np.ndarray:
    """Sorted hashes with a large share of all, by a sample of one document in SAMPLE; MAX_HOT at most."""
    sample = docs.where(F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(SAMPLE)) == 0).select(F.coalesce(text_col, F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in hashes(batches):
            values, n = np.unique(found, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    counted = map_batches(sample, count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    rows = counted.where(F.col("n") >= MIN_SAMPLE_COUNT).orderBy(F.col("n").desc(), "h").limit(MAX_HOT).collect()
    return np.sort(np.array([r["h"] for r in rows], np.int64).view(U64))


def in_sorted(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are in the sorted table, and where."""
    if not len(table):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values, at


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (((hashes >> U64(32)) * U64(shards)) >> U64(32)).astype(np.int32)


def split(hashes: np.ndarray, doc: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(shard, indices of its hashes, its texts, hashes per text); ``doc`` is ascending."""
    to = shard_of(hashes, shards)
    order = np.argsort(to, kind="stable")
    bounds = np.searchsorted(to[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(bounds)):
        part = order[bounds[s] : bounds[s + 1]]
        own = doc[part]
        edge = np.flatnonzero(np.diff(own, prepend=-1))
        yield int(s), part, own[edge], np.diff(np.append(edge, len(own)))


def dealt(blocks: DataFrame, shards: int, column: str = "shard") -> DataFrame:
    """Blocks by shard: each shard whole and in one partition, which is a shard or a range of shards, sorted.

    Negative numbers are further shards.
    """
    parts = min(shards, MAX_PARTITIONS)
    shard = F.pmod(F.col(column), F.lit(shards)).cast("bigint")
    return blocks.repartitionById(parts, F.floor(shard * parts / shards).cast("int")).sortWithinPartitions(column)


def runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The shard's rows of sorted batches: one table for each run of equal values of ``column``, not held here."""
    held: list[pa.RecordBatch] = []
    value = None

    def table() -> pa.Table:
        made = pa.Table.from_batches(held)
        held.clear()
        return made

    for batch in batches:
        keys = batch.column(column).to_numpy(zero_copy_only=False)
        edges = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)])) if len(keys) else [0]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if held and keys[a] != value:
                yield table()
            value = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        batch = None
        yield table()


def joined(table: pa.Table, column: str, dtype) -> np.ndarray:
    """All values of a column of packed arrays."""
    parts = [np.frombuffer(x.as_buffer(), dtype) for x in table[column]]
    return np.concatenate(parts) if parts else np.empty(0, dtype)  # a copy, so it can be changed


def packed(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """A binary array whose items are runs of ``values``; edges has one more entry than items."""
    width = values.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(np.ascontiguousarray(edges, np.int64) * width), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())
