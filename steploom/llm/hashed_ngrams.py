"""Two hashed n-gram multinomials, of a trusted target and of the raw corpus.

The n-grams are the overlapping runs of four bytes of a text, hashed into a fixed number of buckets, so the model has
a fixed size however large the corpus is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, small_batches, unused
from .tokens import slices, texts

BUCKET_BITS = 16
WIDTH = 4
#: Labelled target documents that the target model is fitted on, at most: those with the smallest digest of their id.
MAX_TARGET = 20_000


def buckets(data: np.ndarray) -> np.ndarray:
    """The bucket of the n-gram that starts at each byte (WIDTH - 1 fewer than bytes)."""
    n = len(data) - WIDTH + 1
    if n <= 0:
        return np.empty(0, np.int64)
    gram = np.zeros(n, np.uint32)
    for k in range(WIDTH):
        gram |= data[k : k + n].astype(np.uint32) << np.uint32(8 * k)
    return ((gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


def inside(bounds: np.ndarray, n: int) -> np.ndarray:
    """Which of the ``n`` n-grams lie within one text."""
    ok = np.ones(n, bool)
    for back in range(1, WIDTH):
        at = bounds[1:-1] - back
        ok[at[(at >= 0) & (at < n)]] = False
    return ok


def counts(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Counts of all buckets over the target and over all documents. ``target`` holds the ids of at most MAX_TARGET rows.

    One pass over the texts; each task adds up its own buckets. The driver gets one row per bucket.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, chosen = np.zeros(1 << BUCKET_BITS, np.int64), np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            data, bounds = texts(batch.column(0))
            is_target = batch.column(1).to_numpy(zero_copy_only=False)
            for a, b in slices(bounds):
                part, edges = data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
                found = buckets(part)
                ok = inside(edges, len(found))
                raw += np.bincount(found[ok], minlength=len(raw))
                if is_target[a:b].any():
                    ok &= np.repeat(is_target[a:b], np.diff(edges))[: len(found)]
                    chosen += np.bincount(found[ok], minlength=len(raw))
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(raw[at]), pa.array(chosen[at])], names=["bucket", "raw", "target"])

    small_batches(docs.sparkSession)
    t_id = unused(docs, "target_id")[0]
    ids = F.broadcast(target.select(F.col("doc_id").alias(t_id)).distinct())
    rows = docs.join(ids, docs[id_col] == F.col(t_id), "left").select(F.coalesce(text_col, F.lit("")).alias("text"), F.col(t_id).isNotNull().alias("t"))
    sums = map_batches(rows, count, "bucket int, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, chosen = np.zeros(1 << BUCKET_BITS), np.zeros(1 << BUCKET_BITS)
    for row in sums.collect():  # one row per bucket: 2**BUCKET_BITS at most
        raw[row["bucket"]], chosen[row["bucket"]] = row["raw"], row["target"]
    return chosen, raw


def trusted(labels: DataFrame, max_target: int = MAX_TARGET) -> DataFrame:
    """Ids of labelled documents of good quality, a bounded sample that depends on the ids only."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    return good.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(max_target)


def log_ratios(target: np.ndarray, raw: np.ndarray, prior: float = 5.0) -> np.ndarray:
    """log p_target - log p_raw of each bucket; zeros without a target.

    p_raw is add-one smoothed. p_target is p_raw times the ratio of observed to expected target counts, both with
    ``prior`` counts added, and normalised: a bucket that is too rare for the target to have seen it stays near 0.
    """
    if not target.sum():
        return np.zeros(len(raw))
    p_raw = (raw + 1) / (raw.sum() + len(raw))
    ratio = (target + prior) / (target.sum() * p_raw + prior)
    return np.log(ratio / (p_raw * ratio).sum())


def scores(data: np.ndarray, bounds: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of log ratios of each text, and its number of n-grams."""
    found = buckets(data)
    ok = inside(bounds, len(found))
    values = np.zeros(len(data) + 1)
    values[: len(found)] = np.where(ok, ratios[found], 0.0)
    sums = np.add.reduceat(values, bounds[:-1]) if len(bounds) > 1 else np.empty(0)
    lengths = np.diff(bounds)
    sums[lengths == 0] = 0.0
    return sums, np.maximum(lengths - WIDTH + 1, 0)
