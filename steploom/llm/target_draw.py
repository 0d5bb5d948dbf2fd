"""Importance resampling towards a target distribution: bit-sliced weights over hashed word n-grams, Gumbel top-k.

A document's bucket counts are held as planes of 10,000 bits, one plane for each binary digit of the counts; the gains of
the buckets are planes of their digits, positive and negative ones apart. The number of ones in (count plane i AND gain
plane j), times 2 to the power i + j, summed over all i and j, is the exact sum of gains over the document's n-grams.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, map_batches, materialise, small_batches
from .tokens import AS_LOWER, SLICE_BYTES, Words, texts

BUCKETS = 10_000
ORDER = 3
MIN_WORDS = 20
PERCENT = 5
SEED = 42
#: Bytes that separate words once A-Z are lower-case: ASCII but for digits and small letters.
GAPS = np.zeros(256, bool)
GAPS[:128] = True
GAPS[0x30:0x3A] = GAPS[0x61:0x7B] = False
#: 64-bit words of a plane.
LANES = -(-BUCKETS // 64)
#: Documents whose planes are held at once.
GROUP = 256
#: Longer words are hashed one by one by the library, shorter ones byte by byte for all words together.
LONG_WORD = 48


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & np.uint32(1), (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


CRC = _crc_table()


def _extend(state: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRC states after each word's bytes, continued from ``state``."""
    by_length = np.argsort(-np.minimum(lengths, LONG_WORD + 1), kind="stable")
    out, at, sizes = state[by_length], starts[by_length], lengths[by_length]
    n_long = int(np.searchsorted(-np.minimum(sizes, LONG_WORD + 1), -LONG_WORD, "left"))
    for k in range(n_long):
        out[k] = zlib.crc32(data[at[k] : at[k] + sizes[k]], int(~out[k])) ^ 0xFFFFFFFF
    out_, at, sizes = out[n_long:], at[n_long:], sizes[n_long:]
    for j in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -j, "left"))
        s = out_[:n]
        out_[:n] = CRC[(s ^ data[at[:n] + j]) & np.uint32(255)] ^ (s >> np.uint32(8))
    back = np.empty_like(out)
    back[by_length] = out
    return back


def features(words: Words, skip: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of all runs of one to three words of one text; runs that end in the first ``skip`` words are left out."""
    doc, lengths = words.docs(), words.ends - words.starts
    state = _extend(np.full(len(words), 0xFFFFFFFF, np.uint32), words.data, words.starts, lengths)
    for size in range(1, ORDER + 1):
        if size > 1:  # state[i] is that of the size - 1 words from i on
            n = len(words) - size + 1
            if n <= 0:
                return
            s = state[:n]
            s = CRC[(s ^ np.uint32(0x20)) & np.uint32(255)] ^ (s >> np.uint32(8))
            state = _extend(s, words.data, words.starts[size - 1 :], lengths[size - 1 :])
        ok = doc[: len(state)] == doc[size - 1 :]
        ok[: max(skip - size + 1, 0)] = False
        yield doc[: len(state)][ok], ((state[ok] ^ np.uint32(0xFFFFFFFF)) % np.uint32(BUCKETS)).astype(np.int64)


def _pieces(data: np.ndarray, bounds: np.ndarray, limit: int) -> Iterator[tuple[int, int, Words, int]]:
    """(first text, end, words, skip) for runs of texts of ``limit`` bytes; a longer text comes in pieces that begin with the
    last two words of the piece before, to be skipped."""
    at, n = 0, len(bounds) - 1
    while at < n:
        if bounds[at + 1] - bounds[at] <= limit:
            end = int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1
            yield at, end, Words(data[bounds[at] : bounds[end]], bounds[at : end + 1] - bounds[at], True, GAPS), 0
            at = end
            continue
        low, stop, carry, skip = int(bounds[at]), int(bounds[at + 1]), np.empty(0, np.uint8), 0
        while low < stop:
            cut = min(low + limit, stop)
            if cut < stop:  # cut behind a byte that is in no word
                while cut < stop and not GAPS[AS_LOWER[data[cut - 1]]]:
                    cut += 1
            part = np.concatenate([carry, data[low:cut]])
            words = Words(part, np.array([0, len(part)]), True, GAPS)
            yield at, at + 1, words, skip
            kept = min(ORDER - 1, len(words))
            carry = np.append(part[words.starts[-kept] : words.ends[-1]], np.uint8(0x20)) if kept else carry
            low, skip = cut, kept
        at += 1


def bucket_counts(rows: DataFrame, text_col: str = "text") -> np.ndarray:
    """How often the n-grams of all texts fall into each bucket. Tasks add up their own texts; the driver gets one row a bucket."""
    limit = SLICE_BYTES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, words, skip in _pieces(*texts(batch.column(0)), limit):
                for _, bucket in features(words, skip):
                    total += np.bincount(bucket, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])

    small_batches(rows.sparkSession)
    out = np.zeros(BUCKETS, np.int64)
    found = map_batches(rows.select(F.coalesce(text_col, F.lit("")).alias("text")), count, "bucket int, n bigint")
    for row in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        out[row["bucket"]] = row["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1,000 times the log ratio of target to raw shares of each bucket, add-one smoothed, rounded down."""
    s_all, t_all = float(raw.sum() + BUCKETS), float(target.sum() + BUCKETS)
    ratio = lambda t, s: ((float(t) + 1) * s_all) / ((float(s) + 1) * t_all)
    return np.array([math.floor(1000 * math.log(ratio(t, s))) for t, s in zip(target, raw, strict=True)], np.int64)


def _planes(ones: np.ndarray) -> np.ndarray:
    """Rows of flags, BUCKETS wide, as rows of LANES 64-bit words."""
    packed = np.packbits(ones, axis=1)
    return np.pad(packed, ((0, 0), (0, LANES * 8 - packed.shape[1]))).view(np.uint64)


def gain_planes(values: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(signed power of two, plane) for each binary digit of the positive and of the negative gains."""
    out = []
    for sign in (1, -1):
        size = np.where(values * sign > 0, values * sign, 0)
        for j in range(int(size.max()).bit_length()):
            out.append((sign << j, _planes((size[None, :] >> j & 1).astype(bool))[0]))
    return out


def _bit_sliced(n: int, keys: np.ndarray, counts: np.ndarray, planes: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """The weights of ``n`` documents with ``counts`` in the cells ``keys`` (document * BUCKETS + bucket)."""
    out = np.zeros(n, np.int64)
    for i in range(int(counts.max()).bit_length() if len(counts) else 0):
        doc, bucket = np.divmod(keys[counts >> i & 1 == 1], BUCKETS)
        held, row = np.unique(doc, return_inverse=True)
        ones = np.zeros((len(held), BUCKETS), bool)
        ones[row, bucket] = True
        digit = _planes(ones)
        for power, plane in planes:
            out[held] += np.bitwise_count(digit & plane).sum(axis=1, dtype=np.int64) * (power << i)
    return out


def _weigh(data: np.ndarray, bounds: np.ndarray, planes: list[tuple[int, np.ndarray]], limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of words and the weight of each text."""
    n_words, weights = np.zeros(len(bounds) - 1, np.int64), np.zeros(len(bounds) - 1, np.int64)
    keys, counts, of = [], [], None  # cells of a text that comes in pieces

    def done() -> None:
        if of is not None and keys:
            at, cell = np.unique(np.concatenate(keys), return_inverse=True)
            summed = np.bincount(cell, np.concatenate(counts)).astype(np.int64)
            weights[of] = _bit_sliced(1, at, summed, planes)[0]

    for a, b, words, skip in _pieces(data, bounds, limit):
        n_words[a:b] += words.counts - skip
        found = list(features(words, skip))
        cells = np.concatenate([doc * BUCKETS + bucket for doc, bucket in found]) if found else np.empty(0, np.int64)
        cells, times = np.unique(cells, return_counts=True)
        if b - a == 1:
            if of != a:
                done()
                keys, counts, of = [], [], a
            keys.append(cells)
            counts.append(times)
            continue
        for low in range(0, b - a, GROUP):
            high = min(low + GROUP, b - a)
            x, y = np.searchsorted(cells, [low * BUCKETS, high * BUCKETS])
            weights[a + low : a + high] = _bit_sliced(high - low, cells[x:y] - low * BUCKETS, times[x:y], planes)
    done()
    return n_words, weights


def weigh(docs: DataFrame, values: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight): the exact sum of the buckets' gains over the n-grams of each text."""
    planes, limit = docs.sparkSession.sparkContext.broadcast(gain_planes(values)), SLICE_BYTES

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, weights = _weigh(*texts(batch.column(1)), planes.value, limit)
            grams = sum(np.maximum(n_words - k, 0) for k in range(ORDER))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n_words, grams, weights))], names=["doc_id", "n_words", "n_features", "weight"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return map_batches(rows, per_batch, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def gumbel(id_col: str, seed: int = SEED) -> Column:
    """1,000 times a Gumbel variate that is a function of seed and id, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0)))


def numbered(rows: DataFrame, order: list[Column], out: str, work: Scratch) -> DataFrame:
    """``rows`` with their place, from 1, in ``order``, which must tell all rows apart.

    Rows are dealt to partitions by ranges of the order and sorted there; a row's place is its number in its partition and
    the sizes of those before. No task holds more than its range, and sizes alone are summed over all partitions.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = work.table(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranged")
    ranged = ranged.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit(2**33 - 1)))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return ranged.join(F.broadcast(sizes.select("_part", "_before")), "_part").withColumn(out, F.col("_before") + F.col("_at") + 1).drop("_part", "_before", "_at")


def draw(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row: floor(percent/100) of the rows of ``min_words`` words or more
    are drawn, those with the highest scores, and ranked from 1; rank is null for the rest.

    Adding a Gumbel variate to log weights and taking the largest is sampling in proportion to the weights. Null and empty
    texts have no n-grams and weight 0. Equal scores go by the smaller id, null ids last, and rows that repeat an id and a
    score by their place in the scored table. Without target texts gains depend on the raw counts alone. Ids are hashed as
    text, a null id as the empty one. Extra columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    values = gains(bucket_counts(docs, text_col), bucket_counts(target, target_col))
    with Scratch(spark, "draw") as work:
        scored = weigh(docs, values, id_col, text_col).withColumn("score", F.col("weight") + gumbel("doc_id", seed))
        scored = work.table(scored.withColumn("place", F.monotonically_increasing_id()), "scored")
        able = scored.where(F.col("n_words") >= min_words)
        k = able.count() * percent // 100
        ranked = numbered(able, [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("place")], "rank", work)
        ranked = ranked.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
        rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
        return materialise(ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank"), "drawn")
