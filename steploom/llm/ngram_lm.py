"""Interpolated modified Kneser-Ney model of order two or three, counted in Spark and read by workers as memory-mapped arrays.

The model is files in the shared folder: sorted 64-bit word hashes with their counts, sorted 64-bit bigram keys
(the ranks of two words) with theirs, and sorted trigram keys (the rank of a bigram and that of a word), each cut into
shards that one task writes. Workers map the files and look up sorted batches, so what a worker holds in memory doesn't
grow with the corpus. Counts take a byte, and longer ones have a list of their own.

At order three a bigram counts as often as different words come before it, and as often as it occurs at the start of a
text. What follows a bigram that occurs once is known; statistics are kept for the others only.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gram_shards as G
from .common import drop_path, map_batches, materialise, new_path, small_batches, write_table
from .tokens import U64, batches, mix, slices, texts

#: The hash of the end token. Words hash to it as rarely as to one another.
END = mix(np.array([0xE0D], U64), 40)[0]
#: Contexts with more than this share of all tokens are dealt to several shards; there are 1 / HOT_SHARE at most.
HOT_SHARE = 1 / 1000
HOT_PARTS = 32


def model_folder(spark: SparkSession) -> str:
    """A new folder for the model. It must be a folder that workers can map: a mounted spark.checkpoint.dir."""
    url = urlparse(new_path(spark, "ngram-model"))
    if url.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped models need a mounted shared folder; spark.checkpoint.dir is {url.scheme}://")
    os.makedirs(url.path, exist_ok=True)
    return url.path


def _save(folder: str, name: str, values: np.ndarray) -> None:
    """Whole or not at all: a task that is run again writes the same file."""
    part = f"{folder}/.{name}-{uuid.uuid4().hex}"
    values.tofile(part)
    os.replace(part, f"{folder}/{name}")


@lru_cache(maxsize=100_000)
def _map(path: str, dtype: str) -> np.ndarray:
    return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)


def _save_counts(folder: str, name: str, counts: np.ndarray) -> None:
    """A byte for each count; those of 255 and more also go to a list of (place, count)."""
    large = np.flatnonzero(counts >= 255)
    _save(folder, f"{name}-more", np.stack((large, counts[large]), 1).astype("i8"))
    _save(folder, name, np.minimum(counts, 255).astype("u1"))


def _counts(path: str, at: np.ndarray | None = None) -> np.ndarray:
    """The counts at some places, or all."""
    out = (_map(path, "u1") if at is None else _map(path, "u1")[at]).astype(np.int64)
    large = np.flatnonzero(out == 255)
    if len(large):
        more = _map(f"{path}-more", "i8").reshape(-1, 2)
        out[large] = more[np.searchsorted(more[:, 0], large if at is None else at[large]), 1]
    return out


@dataclass
class Table:
    """Shards of sorted 64-bit keys; ``lows`` are the smallest possible keys of the shards, ``starts`` their first ranks."""

    folder: str
    name: str
    lows: np.ndarray
    starts: np.ndarray

    def find(self, keys: np.ndarray, *columns: tuple[str, str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(found, rank, values of the columns) for ascending keys."""
        found, rank = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        values = [np.zeros(len(keys), dtype) for _, dtype in columns]
        bounds = np.append(np.searchsorted(keys, self.lows), len(keys))
        for s in np.flatnonzero(np.diff(bounds)):
            part = slice(bounds[s], bounds[s + 1])
            own = _map(f"{self.folder}/{self.name}-{s}.key", "u8")
            if not len(own):
                continue
            at = np.minimum(np.searchsorted(own, keys[part]), len(own) - 1)
            hit = own[at] == keys[part]
            found[part], rank[part] = hit, at + self.starts[s]
            for out, (column, dtype) in zip(values, columns, strict=True):
                got = _map(f"{self.folder}/{self.name}-{s}.{column}", dtype)[at]
                out[part] = np.where(hit, got, 0)
        return found, rank, values


def _find(folder: str, name: str, to: np.ndarray, shards: int, keys: np.ndarray, *columns: str) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(found, place in the shard, values of the columns) for ascending keys that are dealt to the shards ``to``."""
    found, place = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    values = [np.zeros(len(keys), np.int64) for _ in columns]
    order = np.argsort(to, kind="stable")
    bounds = np.searchsorted(to[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(bounds)):
        part = order[bounds[s] : bounds[s + 1]]
        own = _map(f"{folder}/{name}-{s}.key", "u8")
        if len(own):
            at = np.minimum(np.searchsorted(own, keys[part]), len(own) - 1)
            hit = own[at] == keys[part]
            found[part], place[part] = hit, at
            for out, column in zip(values, columns, strict=True):
                out[part] = np.where(hit, _counts(f"{folder}/{name}-{s}.{column}", at), 0)
    return found, place, values


@dataclass
class Pairs:
    """Shards of sorted bigram keys; ``starts`` are their first ranks, ``hot`` the contexts dealt to several shards."""

    folder: str
    bounds: np.ndarray
    hot: np.ndarray
    starts: np.ndarray

    def find(self, keys: np.ndarray, *columns: str) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(found, rank, values of the columns) for ascending keys."""
        to = _bigram_shard(keys, self.bounds, self.hot)
        found, place, values = _find(self.folder, "bigram", to, len(self.starts), keys, *columns)
        return found, place + self.starts[to], values

    def shard(self, ranks: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, ranks, "right") - 1

    def followers(self, ranks: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """How many words follow each bigram once, twice and more often; nothing for hot bigrams."""
        out = np.zeros((len(ranks), 3), np.int64)
        out[counts == 1, 0] = 1
        many = np.flatnonzero(counts > 1)
        many = many[np.argsort(ranks[many], kind="stable")]
        bounds = np.searchsorted(ranks[many], np.append(self.starts, np.iinfo(np.int64).max))
        for s in np.flatnonzero(np.diff(bounds)):
            part = many[bounds[s] : bounds[s + 1]]
            own = _map(f"{self.folder}/follow-{s}.at", "u4")
            hit, at = G.in_sorted(ranks[part] - self.starts[s], own)
            out[part[hit]] = _counts(f"{self.folder}/follow-{s}.n", (3 * at[hit][:, None] + np.arange(3)).reshape(-1)).reshape(-1, 3)
        return out


def _trigram_shard(keys: np.ndarray, pairs: Pairs, hot: np.ndarray) -> np.ndarray:
    """The shard of the bigram, except for the hot ones, whose trigrams go on to HOT_PARTS shards by the last word."""
    pair = (keys >> U64(32)).astype(np.int64)
    to, part = pairs.shard(pair), (mix(keys & U64(0xFFFFFFFF), 3) % U64(HOT_PARTS)).astype(np.int64)
    return np.where(G.in_sorted(pair, hot)[0], (to + part) % len(pairs.starts), to)


def _inner(first: np.ndarray) -> np.ndarray:
    """The tokens that have another one before them in their text."""
    inside = np.ones(int(first[-1]), bool)
    inside[first[:-1]] = False
    return np.flatnonzero(inside)


def _lows(shards: int) -> np.ndarray:
    """The smallest hash of each shard of gram_shards.shard_of."""
    return np.array([-((-s << 32) // shards) << 32 for s in range(shards)], U64)


def _tokens(words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, one end after each, and the index of each text's first token."""
    first = words.first + np.arange(len(words.first))
    out = np.empty(int(first[-1]), U64)
    is_end = np.zeros(len(out), bool)
    is_end[first[1:] - 1] = True
    out[~is_end] = words.hashes()
    out[is_end] = END
    return out, first


def _lookup_words(vocabulary: Table, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(known, rank, count) of each token."""
    unique, inverse = np.unique(hashes, return_inverse=True)
    found, rank, (count,) = vocabulary.find(unique, ("count", "i8"))
    return found[inverse], rank[inverse], count[inverse]


COUNTED = "shard int, keys binary, counts binary"


def _planes(values: np.ndarray) -> bytes:
    """All first bytes, then all second bytes and so on, which the shuffle compresses better."""
    return values.view("u1").reshape(-1, values.itemsize).T.tobytes()


def _unplaned(data, dtype: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, "u1").reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).reshape(-1)


def _counted(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """What goes to shards, with ascending keys as differences; and as it is what goes to the driver (negative)."""
    keys = [_planes(np.diff(k, prepend=U64(0))) if s >= 0 else k.tobytes() for s, k, _ in rows]
    counts = [_planes(n.astype("u4")) for _, _, n in rows]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], names=["shard", "keys", "counts"])


def _by_shard(keys: np.ndarray, counts: np.ndarray, to: np.ndarray, shards: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    order = np.argsort(to, kind="stable")
    bounds = np.searchsorted(to[order], np.arange(shards + 1))
    return [(int(s), keys[p], counts[p]) for s in np.flatnonzero(np.diff(bounds)) if len(p := order[bounds[s] : bounds[s + 1]])]


def _summed(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([np.cumsum(_unplaned(x.as_buffer(), "u8"), dtype=U64) for x in table["keys"]])
    counts = np.concatenate([_unplaned(x.as_buffer(), "u4") for x in table["counts"]])
    unique, inverse = np.unique(keys, return_inverse=True)
    return unique, np.bincount(inverse, weights=counts, minlength=len(unique)).astype(np.int64)


def _blocks(batch: pa.RecordBatch, use, shards: int) -> Iterator[np.ndarray]:
    """Concatenated ``use(words)`` over large runs of texts, computed over small ones."""
    column = batch.column(0)
    for a, b in slices(texts(column)[1], G.block_bytes(shards)):
        yield np.concatenate([use(words) for _, _, words in batches(column.slice(a, b - a), lower=True)])


def _rows(df: DataFrame) -> list:
    """The few rows of a job, whose shuffle files go when it ends."""
    path = new_path(df.sparkSession, "rows")
    write_table(df, path)
    out = df.sparkSession.read.parquet(path).collect()
    drop_path(df.sparkSession, path)
    return out


def count_words(train: DataFrame, folder: str, shards: int) -> tuple[Table, int]:
    """Write the vocabulary; (table, all tokens)."""

    def send(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for hashes in _blocks(batch, lambda words: _tokens(words)[0], shards):
                unique, n = np.unique(hashes, return_counts=True)
                yield _counted(_by_shard(unique, n, G.shard_of(unique, shards), shards))

    def merge(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in G.runs(rows, "shard"):
            s = table["shard"][0].as_py()
            keys, counts = _summed(table)
            _save(folder, f"word-{s}.key", keys)
            _save(folder, f"word-{s}.count", counts)
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([len(keys)]), pa.array([int(counts.sum())])], names=["shard", "n", "total"])

    done = _rows(map_batches(G.dealt(map_batches(train, send, COUNTED), shards), merge, "shard int, n bigint, total bigint"))
    sizes = np.zeros(shards, np.int64)
    for r in done:
        sizes[r["shard"]] = r["n"]
    for s in np.flatnonzero(sizes == 0):
        for kind, dtype in (("key", "u8"), ("count", "i8")):
            _save(folder, f"word-{s}.{kind}", np.empty(0, dtype))
    if sizes.sum() >= 2**32 - 1:
        raise ValueError("more words than bigram keys can hold")
    return Table(folder, "word", _lows(shards), np.cumsum(sizes) - sizes), sum(r["total"] for r in done)


@dataclass
class Discounts:
    one: float
    two: float
    more: float

    def of(self, counts: np.ndarray) -> np.ndarray:
        return np.select([counts <= 0, counts == 1, counts == 2], [0.0, self.one, self.two], self.more)

    @classmethod
    def fit(cls, n1: int, n2: int, n3: int, n4: int) -> Discounts:
        """From the numbers of n-grams seen one to four times; 0.5, 1 and 1.5 where there are too few to tell."""
        if min(n1, n2, n3, n4) <= 0:
            return cls(0.5, 1.0, 1.5)
        y = n1 / (n1 + 2 * n2)
        d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
        return cls(*(float(np.clip(x, 0.05 * k, 0.95 * k)) for k, x in enumerate(d, 1)))


@dataclass
class Triples:
    """What order three adds: the few bigrams whose trigrams are dealt to several shards, and the discounts."""

    hot: np.ndarray
    hot_stats: np.ndarray
    discounts: Discounts


@dataclass
class Model:
    """What workers need beside the files: a few numbers, shard bounds, and the few contexts dealt to several shards."""

    words: Table
    word_bounds: np.ndarray
    hot: np.ndarray
    hot_stats: np.ndarray
    n_words: int
    n_tokens: int
    n_bigrams: int
    high: Discounts
    low: Discounts
    low_rest: float
    pairs: Pairs
    triples: Triples | None = None

    def _dense(self, kind: str, ranks: np.ndarray, width: int) -> np.ndarray:
        """Rows of per-word statistics for ascending ranks."""
        out = np.zeros((len(ranks), width), np.int64)
        bounds = np.searchsorted(ranks, self.word_bounds)
        for s in np.flatnonzero(np.diff(bounds)):
            part = slice(bounds[s], bounds[s + 1])
            out[part] = _map(f"{self.words.folder}/{kind}-{s}", "i8").reshape(-1, width)[ranks[part] - self.word_bounds[s]]
        return out

    def log10(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known, base log10, model log10) of each token."""
        known, rank, count = _lookup_words(self.words, hashes)
        base = np.log10((count + 0.5) / (self.n_tokens + 0.5 * (self.n_words + 1)))
        # The lower order: how many different words come before.
        ranks, inverse = np.unique(rank, return_inverse=True)
        kinds = np.where(known, self._dense("kinds", ranks, 1)[:, 0][inverse], 0)
        low = self.low_rest / (self.n_words + 1)
        if self.n_bigrams:
            low = low + np.maximum(kinds - self.low.of(kinds), 0) / self.n_bigrams
        context, known_context = _contexts(rank, known, first, self.n_words)
        contexts, inverse = np.unique(context, return_inverse=True)
        stats = self._dense("context", contexts, 4)
        if len(self.hot):
            is_hot, at = G.in_sorted(contexts, self.hot)
            stats[is_hot] = self.hot_stats[at[is_hot]]
        stats = stats[inverse]
        stats[~known_context] = 0
        total = stats[:, 0]
        keys, inverse = np.unique((context.astype(U64) << U64(32)) | rank.astype(U64), return_inverse=True)
        _, pair, counts = self.pairs.find(keys, *(("count", "kinds") if self.triples else ("count",)))
        seen = np.where(known & known_context, counts[-1][inverse], 0)
        d = self.high
        rest = np.where(total > 0, (d.one * stats[:, 1] + d.two * stats[:, 2] + d.more * stats[:, 3]) / np.maximum(total, 1), 1.0)
        p = np.maximum(seen - d.of(seen), 0) / np.maximum(total, 1) + rest * low
        if self.triples:
            followers = self.pairs.followers(pair, counts[0])
            is_hot, at = G.in_sorted(pair, self.triples.hot)
            followers[is_hot] = self.triples.hot_stats[at[is_hot]]
            at = _inner(first)
            before = inverse[at - 1]
            total = np.where((known & known_context)[at - 1], counts[0][before], 0)
            keys, inverse = np.unique((pair[before].astype(U64) << U64(32)) | rank[at].astype(U64), return_inverse=True)
            _, _, (seen,) = _find(self.pairs.folder, "trigram", _trigram_shard(keys, self.pairs, self.triples.hot), len(self.pairs.starts), keys, "count")
            seen = np.where(known[at] & (total > 0), seen[inverse], 0)
            d, n = self.triples.discounts, followers[before]
            rest = np.where(total > 0, (d.one * n[:, 0] + d.two * n[:, 1] + d.more * n[:, 2]) / np.maximum(total, 1), 1.0)
            p[at] = np.maximum(seen - d.of(seen), 0) / np.maximum(total, 1) + rest * p[at]
        return known, base, np.log10(p)


def _contexts(rank: np.ndarray, known: np.ndarray, first: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The word before each token; a text starts with the context ``start``, one past the last rank."""
    context, known_context = np.empty_like(rank), np.empty_like(known)
    context[1:], known_context[1:] = rank[:-1], known[:-1]
    context[first[:-1]], known_context[first[:-1]] = start, True
    return context, known_context


def _bigram_shard(keys: np.ndarray, bounds: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """A context has one shard, except the hot ones, whose bigrams go on to HOT_PARTS shards by the second word."""
    context = (keys >> U64(32)).astype(np.int64)
    shards = len(bounds) - 1
    to = np.searchsorted(bounds, context, "right") - 1
    part = (mix(keys & U64(0xFFFFFFFF), 3) % U64(HOT_PARTS)).astype(np.int64)
    return np.where(G.in_sorted(context, hot)[0], (to + part) % shards, to)


def _numbers(s: int, counts: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """For the driver: how many are counted one to four times, how many there are, and the shard."""
    return -1, np.array([(counts == k).sum() for k in (1, 2, 3, 4)] + [len(counts), s], U64), np.zeros(0)


def _context_stats(folder: str, s: int, keys: np.ndarray, counts: np.ndarray, bounds: np.ndarray, hot: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Write the statistics of the contexts of a shard of bigrams; for the driver, _numbers and those of hot contexts (-2)."""
    out = [_numbers(s, counts)]
    dense = np.zeros((bounds[s + 1] - bounds[s], 4), np.int64)
    if len(keys):
        context = (keys >> U64(32)).astype(np.int64)
        edge = np.flatnonzero(np.diff(context, prepend=-1))
        stats = np.add.reduceat(np.stack((counts, counts == 1, counts == 2, counts > 2), 1).astype(np.int64), edge, axis=0)
        who = context[edge]
        is_hot = G.in_sorted(who, hot)[0]
        own = (who >= bounds[s]) & (who < bounds[s + 1]) & ~is_hot
        dense[who[own] - bounds[s]] = stats[own]
        part = ~own & is_hot
        if part.any():
            out.append((-2, np.concatenate((who[part].reshape(-1, 1), stats[part]), 1).astype(U64).reshape(-1), np.zeros(0)))
    _save(folder, f"context-{s}", dense)
    return out


def _driver_sums(rows: list, hot: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(the rows -1, the sums of the rows -2 by hot context)"""
    seen, stats = [], np.zeros((len(hot), width), np.int64)
    for r in rows:
        values = np.frombuffer(r["keys"], "i8")
        if r["shard"] == -1:
            seen.append(values)
        elif r["shard"] == -2:
            values = values.reshape(-1, width + 1)
            np.add.at(stats, np.searchsorted(hot, values[:, 0]), values[:, 1:])
    return np.array(seen, np.int64).reshape(-1, 6), stats


def train(docs: DataFrame, text_col: str = "text", order: int = 2) -> Model:
    """Count the texts of ``docs``; null counts as empty. Three shuffles, of words, bigrams and kinds of context; order
    three adds two, of trigrams and kinds of words before bigrams."""
    if order not in (2, 3):
        raise ValueError(f"order {order} is neither 2 nor 3")
    spark = docs.sparkSession
    small_batches(spark)
    only = docs.select(F.coalesce(text_col, F.lit("")).alias("text"))
    folder, shards = model_folder(spark), G.shard_count(only)
    vocabulary, n_tokens = count_words(only, folder, shards)
    n_words = int(vocabulary.starts[-1]) + len(_map(f"{folder}/word-{shards - 1}.key", "u8"))
    bounds = np.array([s * (n_words + 1) // shards for s in range(shards + 1)], np.int64)
    bounds[-1] = n_words + 1
    hot = _hot_contexts(vocabulary, n_words, n_tokens, shards, spark)

    def keys_of(words) -> np.ndarray:
        hashes, first = _tokens(words)
        known, rank, _ = _lookup_words(vocabulary, hashes)
        context, _ = _contexts(rank, known, first, n_words)
        return (context.astype(U64) << U64(32)) | rank.astype(U64)

    def send(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for keys in _blocks(batch, keys_of, shards):
                unique, n = np.unique(keys, return_counts=True)
                yield _counted(_by_shard(unique, n, _bigram_shard(unique, bounds, hot), shards))

    def merge(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in G.runs(rows, "shard"):
            s = table["shard"][0].as_py()
            keys, counts = _summed(table)
            _save(folder, f"bigram-{s}.key", keys)
            _save_counts(folder, f"bigram-{s}.count", counts)
            word = (keys & U64(0xFFFFFFFF)).astype(np.int64)
            yield _counted(_context_stats(folder, s, keys, counts, bounds, hot) if order == 2 else [_numbers(s, counts)])
            # How many contexts each word has here, to the shard of the word.
            unique, n = np.unique(word, return_counts=True)
            yield _counted(_by_shard(unique.astype(U64), n, np.searchsorted(bounds, unique, "right") - 1, shards))
            often = np.flatnonzero(counts > HOT_SHARE * n_tokens)
            if len(often):
                yield _counted([(-3, np.stack((np.full(len(often), s), often, word[often]), 1).astype(U64).reshape(-1), np.zeros(0))])

    path = new_path(spark, "kinds")
    write_table(map_batches(G.dealt(map_batches(only, send, COUNTED), shards), merge, COUNTED), path)
    kinds = spark.read.parquet(path)
    small = kinds.where("shard < 0").collect()  # a row per shard, and the few hot contexts and bigrams
    seen, hot_stats = _driver_sums(small, hot, 4)
    often = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(r["keys"], "i8") for r in small if r["shard"] == -3)]).reshape(-1, 3)

    def add(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in G.runs(rows, "shard"):
            s = table["shard"][0].as_py()
            words, n = _summed(table)
            dense = np.zeros(bounds[s + 1] - bounds[s], np.int64)
            dense[words.astype(np.int64) - bounds[s]] = n
            _save(folder, f"kinds-{s}", dense)
            yield pa.RecordBatch.from_arrays([pa.array([[int((n == k).sum()) for k in range(1, 5)] + [int((n > 2).sum()), int(s)]])], names=["n"])

    add_rows = _rows(map_batches(G.dealt(kinds.where("shard >= 0"), shards), add, "n array<bigint>"))
    low = np.array([r["n"] for r in add_rows], np.int64).reshape(-1, 6)
    drop_path(spark, path)
    for s in range(shards):  # shards that got nothing; order three writes all contexts later
        for name, dtype, rows in ((f"bigram-{s}.key", "u8", 0), (f"bigram-{s}.count", "u1", 0), (f"context-{s}", "i8", 4), (f"kinds-{s}", "i8", 1)):
            if not os.path.exists(f"{folder}/{name}") and not (order == 3 and name.startswith("context")):
                _save(folder, name, np.zeros(rows * int(bounds[s + 1] - bounds[s]), dtype))
    n1, n2, n3, n4, n_more = (int(x) for x in low[:, :5].sum(0)) if len(low) else (0,) * 5
    discounts = Discounts.fit(n1, n2, n3, n4)
    n_bigrams = int(seen[:, 4].sum())
    rest = (discounts.one * n1 + discounts.two * n2 + discounts.more * n_more) / n_bigrams if n_bigrams else 1.0
    sizes = np.zeros(shards, np.int64)
    sizes[seen[:, 5]] = seen[:, 4]
    pairs, triples = Pairs(folder, bounds, hot, np.cumsum(sizes) - sizes), None
    if order == 3:
        triples, seen, hot_stats = _train_triples(only, vocabulary, pairs, n_words, often)
    high = Discounts.fit(*(int(x) for x in seen[:, :4].sum(0)))
    return Model(vocabulary, bounds, hot, hot_stats, n_words, n_tokens, n_bigrams, high, discounts, rest, pairs, triples)


def _train_triples(only: DataFrame, vocabulary: Table, pairs: Pairs, n_words: int, often: np.ndarray) -> tuple[Triples, np.ndarray, np.ndarray]:
    """Count trigrams, and bigrams by the words before them; (order three, what ``_driver_sums`` gives for these bigrams).

    ``often`` has shard, place and last word of the bigrams that are dealt to several shards.
    """
    spark, folder, starts, shards = only.sparkSession, pairs.folder, pairs.starts, len(pairs.starts)
    if starts[-1] + len(_map(f"{folder}/bigram-{shards - 1}.key", "u8")) >= 2**32 - 1:
        raise ValueError("more bigrams than trigram keys can hold")
    hot = starts[often[:, 0]] + often[:, 1]
    hot, hot_words = hot[np.argsort(hot)], often[np.argsort(hot), 2]

    def keys_of(words) -> np.ndarray:
        hashes, first = _tokens(words)
        known, rank, _ = _lookup_words(vocabulary, hashes)
        context, _ = _contexts(rank, known, first, n_words)
        unique, inverse = np.unique((context.astype(U64) << U64(32)) | rank.astype(U64), return_inverse=True)
        at, pair = _inner(first), pairs.find(unique)[1]
        return (pair[inverse[at - 1]].astype(U64) << U64(32)) | rank[at].astype(U64)

    def send(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for keys in _blocks(batch, keys_of, shards):
                unique, n = np.unique(keys, return_counts=True)
                yield _counted(_by_shard(unique, n, _trigram_shard(unique, pairs, hot), shards))

    def merge(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in G.runs(rows, "shard"):
            s = table["shard"][0].as_py()
            keys, counts = _summed(table)
            _save(folder, f"trigram-{s}.key", keys)
            _save_counts(folder, f"trigram-{s}.count", counts)
            pair = (keys >> U64(32)).astype(np.int64)
            edge = np.flatnonzero(np.diff(pair, prepend=-1))
            stats = np.add.reduceat(np.stack((counts == 1, counts == 2, counts > 2), 1).astype(np.int64), edge, axis=0)
            who = pair[edge]
            is_hot, at = G.in_sorted(who, hot)
            own = np.flatnonzero(~is_hot)
            place = who[own] - starts[s]
            many = _map(f"{folder}/bigram-{s}.count", "u1")[place] > 1
            _save(folder, f"follow-{s}.at", place[many].astype("u4"))
            _save_counts(folder, f"follow-{s}.n", stats[own[many]].reshape(-1))
            yield _counted([_numbers(s, counts)])
            if is_hot.any():
                yield _counted([(-2, np.concatenate((who[is_hot].reshape(-1, 1), stats[is_hot]), 1).astype(U64).reshape(-1), np.zeros(0))])
            # How many words come before each bigram here, to the shard of the bigram; one does if it occurs once.
            middle = np.empty(len(who), U64)
            middle[own] = _map(f"{folder}/bigram-{s}.key", "u8")[place] & U64(0xFFFFFFFF)
            middle[is_hot] = hot_words[at[is_hot]].astype(U64)
            last = (np.repeat(middle, np.diff(np.append(edge, len(keys)))) << U64(32)) | (keys & U64(0xFFFFFFFF))
            unique, n = np.unique(last, return_counts=True)
            _, rank, (count,) = pairs.find(unique, "count")
            rank, n = rank[count > 1], n[count > 1]
            to = pairs.shard(rank)
            yield _counted(_by_shard((rank - starts[to]).astype(U64), n, to, shards))

    def add(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in G.runs(rows, "shard"):
            s = table["shard"][0].as_py()
            place, n = _summed(table)
            keys, counts = _map(f"{folder}/bigram-{s}.key", "u8"), _counts(f"{folder}/bigram-{s}.count")
            counts[place.astype(np.int64)] = n
            _save_counts(folder, f"bigram-{s}.kinds", counts)
            yield _counted(_context_stats(folder, s, keys, counts, pairs.bounds, pairs.hot))

    path = new_path(spark, "befores")
    write_table(map_batches(G.dealt(map_batches(only, send, COUNTED), shards), merge, COUNTED), path)
    found = spark.read.parquet(path)
    seen, hot_stats = _driver_sums(found.where("shard in (-1, -2)").collect(), hot, 3)  # a row per shard, and the few hot bigrams
    for s in range(shards):  # shards that got nothing
        for name, dtype in ((f"trigram-{s}.key", "u8"), (f"trigram-{s}.count", "u1"), (f"follow-{s}.at", "u4"), (f"follow-{s}.n", "u1")):
            if not os.path.exists(f"{folder}/{name}"):
                _save(folder, name, np.empty(0, dtype))
    every = spark.range(shards).select(F.col("id").cast("int").alias("shard"), F.expr("X'' as keys"), F.expr("X'' as counts"))
    befores = G.dealt(found.where("shard >= 0").unionByName(every), shards)
    sums = _driver_sums(_rows(map_batches(befores, add, COUNTED)), pairs.hot, 4)
    drop_path(spark, path)
    return Triples(hot, hot_stats, Discounts.fit(*(int(x) for x in seen[:, :4].sum(0)))), *sums


def _hot_contexts(vocabulary: Table, n_words: int, n_tokens: int, shards: int, spark: SparkSession) -> np.ndarray:
    """Ranks of the words with more than HOT_SHARE of all tokens, and the start of a text; found shard by shard."""
    starts, folder, least = vocabulary.starts, vocabulary.folder, HOT_SHARE * n_tokens

    def find(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for s in batch.column(0).to_pylist():
                at = np.flatnonzero(_map(f"{folder}/word-{s}.count", "i8") > least)
                yield pa.RecordBatch.from_arrays([pa.array(at + starts[s], pa.int64())], names=["rank"])

    rows = map_batches(spark.range(shards), find, "rank bigint").collect()
    return np.unique(np.array([r["rank"] for r in rows] + [n_words], np.int64))


SCORES = "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double"


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: tokens, known tokens, and log10 probabilities by word counts and by the model."""

    def scores(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for a, b, words in batches(batch.column(1), lower=True, limit=4 << 20):
                hashes, first = _tokens(words)
                known, base, own = model.log10(hashes, first)
                sums = [np.add.reduceat(x, first[:-1]) for x in (known.astype(np.int64), base, own)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(first), pa.int64()), *map(pa.array, sums)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"]
                )

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")), scores, SCORES)


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 1):
    """Whether a row is held out of training; a null id never is."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 2) -> DataFrame:
    """Train a model of order two or three on the rows that aren't held out, and score all rows.

    Null and empty texts are one end token; rows that repeat count each; extra columns are ignored. An empty table, or
    one whose rows are all held out, trains a model of no words, for which every token is unknown. Null ids are never
    held out. The model's files go when the scores are written. Words are told apart by 64-bit hashes.
    """
    model = train(docs.where(~held_out(id_col)), text_col, order)
    made = materialise(score(docs, model, id_col, text_col), "scores")
    drop_path(docs.sparkSession, f"file://{model.words.folder}")
    return made.select("doc_id", held_out("doc_id").alias("held_out"), "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
