"""Substring dedup: Rabin-Karp hashes of every window of words, counted in Spark; repeated windows are removed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gram_shards as G
from .common import map_batches, materialise, small_batches
from .tokens import U64, Words, batches, mix, slices, texts

WINDOW = 50
LAST = np.iinfo(np.int64).max  # stands for a null id
BLOCKS = "shard int, ids binary, marks binary, counts binary, low binary, high binary, hashes binary"


def _window_hashes(size: int):
    def hashes(rows: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in rows:
            for _, _, words in batches(batch.column(0)):
                yield words.windows(words.hashes(), size)[0]

    return hashes


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)


def _send(size: int, shards: int, hot: np.ndarray):
    """Blocks for all shards. Frequent windows are reduced to their smallest id in the task, and sent as shards below 0."""

    def send(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.full(len(hot), LAST, np.int64)
        seen = np.zeros(len(hot), bool)
        most = G.block_bytes(shards)
        for batch in rows:
            ids, marks = _ids(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            data, bounds = texts(batch.column(2))
            for a, b in slices(bounds, most):
                found = []
                for c, d in slices(bounds[a : b + 1]):
                    c, d = a + c, a + d
                    words = Words(data[bounds[c] : bounds[d]], bounds[c : d + 1] - bounds[c])
                    hashes, at = words.windows(words.hashes(), size)
                    doc = words.docs()[at]
                    found.append((hashes, (doc + (c - a)).astype(np.int32), (at - words.first[doc]).astype(np.int32)))
                hashes, doc, at = (np.concatenate(x) for x in zip(*found, strict=True))
                is_hot, which = G.in_sorted(hashes, hot)
                if is_hot.any():
                    np.minimum.at(least, which[is_hot], ids[a:b][doc[is_hot]])
                    seen[which[is_hot]] = True
                    hashes, doc, at = hashes[~is_hot], doc[~is_hot], at[~is_hot]
                out = []
                for s, part, own, n in G.split(hashes, doc, shards):
                    gaps = np.diff(at[part], prepend=0)
                    heads = np.concatenate(([0], np.cumsum(n)[:-1]))
                    gaps[heads] = at[part][heads]
                    out.append((s, ids[a:b][own].tobytes(), marks[a:b][own].tobytes(), n.astype(np.uint32).tobytes(), (gaps & 255).astype(np.uint8).tobytes(), (gaps >> 8).astype(np.uint32).tobytes(), hashes[part].tobytes()))
                if out:
                    yield _block(out)
        if seen.any():
            # As many shards as keep what all tasks send to one of them small.
            spread = G.shard_of(hot, max(8, shards // 8))
            yield _block([(-1 - int(s), least[k].tobytes(), b"", b"", b"", b"", hot[k].tobytes()) for s in np.unique(spread[seen]) if (k := seen & (spread == s)).any()])

    return send


def _block(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32()] + [pa.binary()] * 6
    names = [x.split()[0] for x in BLOCKS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


REPLIES = "bucket int, ids binary, marks binary, counts binary, places binary, hot binary"


def _reply(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32()] + [pa.binary()] * 5
    names = [x.split()[0] for x in REPLIES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _merge(buckets: int):
    """For each text the windows that also start in a text with a smaller id, as one row for each bucket of texts; for
    frequent windows their smallest id, as bucket -1."""

    def merge(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in G.runs(rows, "shard"):
            hashes = G.joined(table, "hashes", U64)
            ids = G.joined(table, "ids", np.int64)
            if table["shard"][0].as_py() < 0:
                values, group = np.unique(hashes, return_inverse=True)
                least = np.full(len(values), LAST, np.int64)
                np.minimum.at(least, group, ids)
                yield _reply([(-1, least.tobytes(), b"", b"", b"", values.tobytes())])
                continue
            marks, counts = G.joined(table, "marks", np.int64), G.joined(table, "counts", np.uint32).astype(np.int64)
            owner = np.repeat(np.arange(len(ids), dtype=np.int32), counts)
            repeated = _repeated(hashes, ids, owner)
            del hashes
            if not len(repeated):
                continue
            at, who = _places(table, counts)[repeated], owner[repeated]
            heads = np.flatnonzero(np.diff(who, prepend=-1))
            doc, n = who[heads], np.diff(np.append(heads, len(who)))
            to = G.shard_of(mix(marks[doc].view(U64) ^ mix(ids[doc].view(U64))), buckets)
            order = np.argsort(to, kind="stable")
            out = []
            for part in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
                k = n[part]
                take = np.repeat(heads[part] - (np.cumsum(k) - k), k) + np.arange(k.sum())
                out.append((int(to[part[0]]), ids[doc[part]].tobytes(), marks[doc[part]].tobytes(), k.astype(np.uint32).tobytes(), at[take].tobytes(), b""))
            yield _reply(out)

    return merge


def _gather(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each text that has answers."""
    for table in G.runs(rows, "bucket"):
        if table["bucket"][0].as_py() < 0:
            values = G.joined(table, "hot", U64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(G.joined(table, "ids", np.int64)), pa.nulls(len(values), pa.int64()), pa.nulls(len(values), pa.binary()), pa.array(values)], names=["id", "mark", "places", "hot"])
            continue
        ids, marks, counts = G.joined(table, "ids", np.int64), G.joined(table, "marks", np.int64), G.joined(table, "counts", np.uint32).astype(np.int64)
        at = G.joined(table, "places", np.uint32)
        order = np.lexsort((marks, ids))
        starts = (np.cumsum(counts) - counts)[order]
        n = counts[order]
        at = at[np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        ids, marks = ids[order], marks[order]
        heads = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1]))))
        edges = np.append((np.cumsum(n) - n)[heads], n.sum())
        yield pa.RecordBatch.from_arrays([pa.array(ids[heads]), pa.array(marks[heads]), G.packed(at, edges), pa.nulls(len(heads), pa.int64())], names=["id", "mark", "places", "hot"])


def _repeated(hashes: np.ndarray, ids: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Indices of the hashes that a text with a smaller id also has, ascending."""
    order = np.argsort(hashes).astype(np.int32)
    hashes = hashes[order]
    edge = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
    del hashes
    runs = np.diff(np.append(edge, len(order)))
    # Only runs of two or more can repeat.
    many = np.repeat(runs > 1, runs)
    order, runs = order[many], runs[runs > 1]
    if not len(order):
        return order
    own = ids[owner[order]]
    least = np.repeat(np.minimum.reduceat(own, np.cumsum(runs) - runs), runs)
    return np.sort(order[own > least])


def _places(table: pa.Table, counts: np.ndarray) -> np.ndarray:
    """The index of each window in its text."""
    gaps = G.joined(table, "high", np.uint32)
    gaps <<= np.uint32(8)
    gaps += G.joined(table, "low", np.uint8)
    starts = np.cumsum(counts) - counts
    total = np.cumsum(gaps, dtype=np.int64)
    return (total - np.repeat(total[starts] - gaps[starts], counts)).astype(np.uint32)


def _apply(size: int, hot: np.ndarray, hot_least: np.ndarray, with_text: bool):
    """Cut the words under repeated windows out of each text."""
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "intervals", "kept_text"]

    def apply(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            column, replies = batch.column(1), batch.column(2)
            data, bounds = texts(column)
            ids = _ids(batch.column(0))
            for a, b in slices(bounds):
                words = Words(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
                marks = np.zeros(len(words) + 1, np.int64)
                for k in range(a, b):
                    if replies[k].is_valid:
                        start = np.frombuffer(replies[k].as_buffer(), np.uint32).astype(np.int64) + words.first[k - a]
                        np.add.at(marks, start, 1)
                        np.add.at(marks, start + size, -1)
                if len(hot):
                    hashes, at = words.windows(words.hashes(), size)
                    is_hot, which = G.in_sorted(hashes, hot)
                    start = at[is_hot]
                    start = start[hot_least[which[is_hot]] < ids[a:b][words.docs()[start]]]
                    np.add.at(marks, start, 1)
                    np.add.at(marks, start + size, -1)
                removed = np.cumsum(marks)[:-1] > 0
                out = _cut(words, removed, with_text)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *out], names=names)

    return apply


def _cut(words: Words, removed: np.ndarray, with_text: bool) -> list[pa.Array]:
    n_docs = len(words.counts)
    doc = words.docs()
    kept = np.flatnonzero(~removed)
    data = words.data.copy()
    more = np.zeros(len(kept), bool)
    more[:-1] = doc[kept[1:]] == doc[kept[:-1]]
    cover = np.zeros(len(data) + 1, np.int64)
    np.add.at(cover, words.starts[kept], 1)
    np.add.at(cover, words.ends[kept], -1)
    take = np.cumsum(cover)[:-1] > 0
    data[words.ends[kept[more]]] = 0x20
    take[words.ends[kept[more]]] = True
    sizes = np.concatenate(([0], np.cumsum(take)))[words.offsets]
    kept_bytes = data[take].tobytes()
    texts_out = [kept_bytes[sizes[k] : sizes[k + 1]] for k in range(n_docs)]
    change = np.diff(np.concatenate(([0], removed.astype(np.int8), [0])))
    if n_docs:  # an interval ends with its text
        first = words.first[1:-1]
        first = first[(first > 0) & (first < len(removed))]
        both = first[removed[first] & removed[first - 1]]
    else:
        both = np.empty(0, np.int64)
    begin, end = np.sort(np.concatenate((np.flatnonzero(change == 1), both))), np.sort(np.concatenate((np.flatnonzero(change == -1), both)))
    owner = doc[begin]
    pairs = np.stack((begin - words.first[owner], end - words.first[owner]), 1).reshape(-1) if len(begin) else np.empty(0, np.int64)
    edges = 2 * np.searchsorted(owner, np.arange(n_docs + 1))
    return [
        pa.array(words.counts, pa.int64()),
        pa.array(np.bincount(doc[removed], minlength=n_docs), pa.int64()),
        pa.array([hashlib.sha256(t).hexdigest() for t in texts_out], pa.string()),
        pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(pairs, pa.int64())),
        pa.array([t.decode() for t in texts_out] if with_text else [None] * n_docs, pa.string()),
    ]


def remove_repeats(docs: DataFrame, size: int = WINDOW, with_text: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, intervals, kept_text), one row per input row.

    A word goes if a window of ``size`` words that covers it also starts in a document with a smaller id. ``intervals``
    are the maximal runs of removed words as a flat list (start, end, start, end, ...); kept_text joins the kept words
    with one space. Null and empty texts have no words; null ids count as larger than all others and don't remove each
    other's words, nor do rows that share an id; windows never cross texts. Extra columns are ignored; an empty table
    gives an empty result.

    Every window's hash goes to a shard by value, 8 bytes and its place; the shard finds the smallest id of equal
    hashes and answers with the places that repeat. Windows that a large share of documents hold are kept out: each
    task sends only its smallest id for them, and their number is bounded (gram_shards.MAX_HOT). Texts meet the
    answers in one join on the id and a hash of the text.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("mark"), F.coalesce(text_col, F.lit("")).alias("text"))
    shards = G.shard_count(rows)
    hot = G.hot_hashes(rows, _window_hashes(size), "id")
    blocks = G.dealt(map_batches(rows, _send(size, shards, hot), BLOCKS), shards)
    answers = G.dealt(map_batches(blocks, _merge(shards), REPLIES), shards, "bucket")
    answers = materialise(map_batches(answers, _gather, "id bigint, mark bigint, places binary, hot bigint"), "answers")
    hot_rows = answers.where("hot is not null").select("hot", "id").collect()  # MAX_HOT at most
    hot_rows.sort(key=lambda r: int(r["hot"]) % (1 << 64))
    hot_at = np.array([r["hot"] for r in hot_rows], np.int64).view(U64)
    hot_least = np.array([r["id"] for r in hot_rows], np.int64)
    told = answers.where("hot is null").select(F.when(F.col("id") != LAST, F.col("id")).alias("r_id"), F.col("mark").alias("r_mark"), "places")
    both = rows.join(told, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("mark") == F.col("r_mark")), "left").select("id", "text", "places")
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, intervals array<bigint>, kept_text string"
    return map_batches(both, _apply(size, hot_at, hot_least, with_text), schema)
