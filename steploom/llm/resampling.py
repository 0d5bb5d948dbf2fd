"""Importance resampling towards a trusted target: hashed n-gram ratio and Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashed_ngrams
from .common import map_batches, materialise
from .tokens import mix, slices, texts

#: Share of the documents that is sampled.
SHARE = 0.85
#: Log weight for each unit of the mean log ratio per n-gram. Sums over a text's n-grams would differ by thousands, beside
#: which the noise (standard deviation 1.28) draws nothing; means differ by a few units.
SHARPNESS = 4.0


def log_weights(docs: DataFrame, labels: DataFrame, seed: int = 1, max_target: int = hashed_ngrams.MAX_TARGET, sharpness: float = SHARPNESS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, log_weight, draw_weight, gumbel_key): log of p_target(text) / p_raw(text), ``sharpness`` times its mean over
    the text's n-grams, and that plus Gumbel noise.

    The noise is a function of seed, id and text, so reruns agree.
    """
    target, raw = hashed_ngrams.counts(docs, hashed_ngrams.trusted(labels, max_target), id_col, text_col)
    ratios = docs.sparkSession.sparkContext.broadcast(hashed_ngrams.log_ratios(target, raw))

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = texts(batch.column(2))
            marks = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for a, b in slices(bounds):
                sums, grams = hashed_ngrams.scores(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], ratios.value)
                weights = sharpness * sums / np.maximum(grams, 1)
                drawn = mix(mix(marks[a:b], seed), 2)
                uniform = ((drawn >> np.uint64(12)).astype(float) + 0.5) / 2.0**52
                columns = [sums, weights, weights - np.log(-np.log(uniform))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *map(pa.array, columns)], names=["doc_id", "log_weight", "draw_weight", "gumbel_key"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(id_col, text_col).alias("mark"), F.coalesce(text_col, F.lit("")).alias("text"))
    return map_batches(rows, per_batch, "doc_id bigint, log_weight double, draw_weight double, gumbel_key double")


def kth_largest(values: DataFrame, column: str, k: int) -> tuple[float, int]:
    """The k-th largest value, and how many rows of just this value belong to the k largest.

    Each pass counts the values in 65,536 bins and goes on with the range of one bin, until that holds one value.
    The driver sees one row per bin.
    """
    lo, hi = values.agg(F.min(column), F.max(column)).first()
    need = k
    while lo < hi:
        width = (hi - lo) / 65536
        if width == 0 or lo + width == lo:
            break
        bin_of = F.least(F.floor((F.col(column) - F.lit(lo)) / F.lit(width)), F.lit(65535)).cast("int")
        part = values.where((F.col(column) >= F.lit(lo)) & (F.col(column) <= F.lit(hi)))
        found = part.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi"))
        for row in sorted(found.collect(), key=lambda r: -r["bin"]):
            if row["n"] >= need:
                lo, hi = row["lo"], row["hi"]
                break
            need -= row["n"]
    return lo, need


def in_top(values: DataFrame, columns: list[str], k: int) -> Column:
    """Whether a row is among the ``k`` largest by ``columns``, of which the last tells all rows apart."""
    chosen, tied = F.lit(False), F.lit(True)
    for column in columns:
        edge, k = kth_largest(values.where(tied), column, k)
        at_edge = tied & (F.col(column) == F.lit(edge))
        chosen = chosen | (tied & (F.col(column) > F.lit(edge)))
        if values.where(at_edge).count() == k:
            return chosen | at_edge
        tied = at_edge
    return chosen


def resample(docs: DataFrame, labels: DataFrame, share: float = SHARE, seed: int = 1, max_target: int = hashed_ngrams.MAX_TARGET, sharpness: float = SHARPNESS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, log_weight, draw_weight, gumbel_key, kept): Gumbel top-k draws ceil(share * rows) rows without replacement.

    Adding Gumbel noise to draw weights and taking the k largest is sampling in proportion to the weights. The
    threshold is the exact k-th largest key; equal keys go by the smallest id, null ids last, and rows that repeat an id
    and a text (they share their noise) by their place in the written table. Null and empty texts have log weight 0.
    Without a target all log weights are 0. Extra columns are ignored; an empty table gives an empty result.
    """
    keyed = materialise(log_weights(docs, labels, seed, max_target, sharpness, id_col, text_col).withColumn("place", F.monotonically_increasing_id()), "keys")
    n = keyed.count()
    if not n:
        return keyed.drop("place").withColumn("kept", F.lit(False))
    ordered = keyed.withColumn("first_id", F.coalesce(F.bitwise_not("doc_id"), F.lit(-(2**63)))).withColumn("first_place", F.bitwise_not("place"))
    kept = in_top(ordered, ["gumbel_key", "first_id", "first_place"], int(np.ceil(share * n)))
    return ordered.withColumn("kept", kept).drop("place", "first_id", "first_place")
