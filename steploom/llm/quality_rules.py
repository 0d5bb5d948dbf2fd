"""Quality rules: counts of words, symbols and repetitions, and a length-normalised log-likelihood ratio."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashed_ngrams
from .common import map_batches, unused
from .tokens import IS_SPACE, Words, mix, slices, texts

#: Mean log ratio per n-gram under which a document is rejected.
THRESHOLD = -0.5
IS_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, llr double, kept boolean"


def repeated_lines(column: pa.Array) -> np.ndarray:
    """Lines of each text that hold a word and equal an earlier line of the text."""
    lines = pc.split_pattern(column, "\n")
    flat = lines.flatten()
    of = np.repeat(np.arange(len(lines)), pc.list_value_length(lines).to_numpy(zero_copy_only=False))
    worded = pc.not_equal(pc.ascii_trim_whitespace(flat), "").to_numpy(zero_copy_only=False)
    codes = pc.dictionary_encode(flat).indices.to_numpy(zero_copy_only=False).astype(np.int64)
    key = (of.astype(np.int64) * (len(flat) + 1) + codes)[worded]
    unique = np.unique(key) // (len(flat) + 1)
    n = len(lines)
    return np.bincount(of[worded], minlength=n) - np.bincount(unique, minlength=n)


def repeated_words(words: Words, size: int = 3) -> np.ndarray:
    """Words of each text in windows of ``size`` words that occur twice or more in it."""
    window, at = words.windows(words.hashes(), size)
    doc = words.docs()
    marks = np.zeros(len(words) + 1, np.int64)
    if len(window):
        key = mix(window ^ mix(doc[at].astype(np.uint64), 1))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        hit = np.zeros(len(key), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        start = at[hit]
        np.add.at(marks, start, 1)
        np.add.at(marks, start + size, -1)
    return np.bincount(doc[np.cumsum(marks)[:-1] > 0], minlength=len(words.counts))


def verdicts(column: pa.Array, ratios: np.ndarray, threshold: float) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(first text, end, columns of SCHEMA after the id) for runs of texts."""
    data, bounds = texts(column)
    for a, b in slices(bounds):
        part, edges = data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
        words = Words(part, edges)
        chars = ((part & 0xC0) != 0x80) & ~IS_SPACE[part]
        n_words, repeats = words.counts, repeated_words(words)
        sums, grams = hashed_ngrams.scores(part, edges, ratios)
        llr = sums / np.maximum(grams, 1)
        failed = (n_words < 50) | (100 * repeats > 50 * n_words)
        lines = repeated_lines(column.slice(a, b - a))
        yield a, b, [n_words, _per_text(chars, edges), _per_text(IS_SYMBOL[part], edges), lines, repeats, failed, llr, ~failed & (llr >= threshold)]


def _per_text(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags)))[edges])


def _ratios(docs: DataFrame, labels: DataFrame, max_target: int, id_col: str, text_col: str):
    """The model as a broadcast of 2**BUCKET_BITS numbers."""
    target, raw = hashed_ngrams.counts(docs, hashed_ngrams.trusted(labels, max_target), id_col, text_col)
    return docs.sparkSession.sparkContext.broadcast(hashed_ngrams.log_ratios(target, raw))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_target: int = hashed_ngrams.MAX_TARGET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row with the counts, the mean log ratio and the verdict.

    ``base_failed``: under 50 words, or over half of the words in repeated windows. ``kept``: not failed, and a mean
    log ratio of the threshold or more. The raw counts cover all documents; the target model is fitted on
    ``max_target`` labelled documents at most. Without any target document the ratio is 0 and the base rules decide.
    Null and empty texts have no words and fail; null ids stay null; rows that repeat are judged each alike; extra
    columns are ignored; an empty table gives an empty result.
    """
    ratios = _ratios(docs, labels, max_target, id_col, text_col)
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, columns in verdicts(batch.column(1), ratios.value, threshold):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *map(pa.array, columns, types)], names=names)

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")), per_batch, SCHEMA)


def good_rows(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_target: int = hashed_ngrams.MAX_TARGET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that ``judge`` keeps, with all their columns and without a shuffle.

    Null and empty texts go; null ids don't matter; rows that repeat are judged each alike, so all of them stay or go.
    An empty table gives an empty result.
    """
    ratios = _ratios(docs, labels, max_target, id_col, text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts_of = batch.column(batch.num_columns - 1)
            kept = [columns[-1] for _, _, columns in verdicts(texts_of, ratios.value, threshold)]
            own = pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1])
            yield own.filter(pa.array(np.concatenate(kept) if kept else np.empty(0, bool)))

    return map_batches(docs.select("*", F.coalesce(text_col, F.lit("")).alias(unused(docs, "judged_text")[0])), keep, docs.schema)
