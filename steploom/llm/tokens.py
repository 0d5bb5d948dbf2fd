"""Words of many texts at once as numpy arrays: where they are, and 64-bit hashes of words and word sequences.

Everything works on the bytes of an Arrow string array, a few megabytes at a time, so the memory of a task is bounded
by its longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 512 << 10
_BASE, _BASE_INVERSE = U64(0x9E3779B97F4A7C15), U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Keeps the first k bytes of a little-endian block.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
AS_LOWER = np.arange(256, dtype=np.uint8)
AS_LOWER[65:91] += 32


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64 bits whose output bits all depend on all input bits."""
    h = h + U64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words of consecutive texts.

    ``data`` holds the bytes, ``offsets`` the bounds of the texts, ``starts`` and ``ends`` those of the words,
    ``first`` the index of the first word of each text (one more entry than texts). ``gaps`` says which bytes are no
    part of a word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, gaps: np.ndarray = IS_SPACE):
        self.data, self.offsets = (AS_LOWER[data] if lower else data), offsets
        space = gaps[self.data]
        before = np.empty(len(data), bool)
        if len(data):
            before[0], before[1:] = True, space[:-1]
            before[offsets[:-1][offsets[:-1] < len(data)]] = True
        self.starts = np.flatnonzero(before & ~space)
        after = np.empty(len(data), bool)
        if len(data):
            after[-1], after[:-1] = True, space[1:]
            ends = offsets[1:]
            after[ends[ends > 0] - 1] = True
        self.ends = np.flatnonzero(after & ~space) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for each word, a function of its bytes only. No two words are known to share one; of n different words
        two do with a probability of about n * n / 2**65."""
        if not len(self.starts):
            return np.empty(0, U64)
        lengths = self.ends - self.starts
        # Blocks of eight bytes, the last one filled with zeros, each mixed with its place in the word.
        n = (lengths + 7) >> 3
        heads = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(heads, n)
        at = np.repeat(self.starts, n) + 8 * place
        padded = np.concatenate((self.data, np.zeros(8, np.uint8)))
        block = np.lib.stride_tricks.sliding_window_view(padded, 8)[at].view("<u8").reshape(-1)
        block &= _KEEP[np.minimum(np.repeat(self.ends, n) - at, 8)]
        return mix(np.add.reduceat(mix(block ^ mix(place.astype(U64), 3)), heads) ^ mix(lengths.astype(U64)))

    def docs(self) -> np.ndarray:
        """The index of the text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def windows(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Rabin-Karp hashes of all runs of ``size`` words inside a text, and the index of their first word."""
        n = len(hashes)
        if n < size:
            return np.empty(0, U64), np.empty(0, np.int64)
        up, down = powers(_BASE, n + 1), powers(_BASE_INVERSE, n)
        total = np.zeros(n + 1, U64)
        np.cumsum(hashes * down, out=total[1:])
        at = np.arange(n - size + 1)
        inside = at + size <= self.first[1:][self.docs()[: n - size + 1]]
        at = at[inside]
        rolled = (total[at + size] - total[at]) * up[at + size - 1]
        return mix(rolled, size), at


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls, and the bounds of its texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.empty(0, np.uint8), bounds - bounds[0]
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(bounds: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts of ``limit`` bytes together, or one longer text."""
    at, n = 0, len(bounds) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        yield at, end
        at = end


def batches(column: pa.Array, lower: bool = False, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first text, end, words) for runs of texts of the array."""
    data, bounds = texts(column)
    for at, end in slices(bounds, limit):
        yield at, end, Words(data[bounds[at] : bounds[end]], bounds[at : end + 1] - bounds[at], lower)
