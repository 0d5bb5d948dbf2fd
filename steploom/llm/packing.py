"""Packing by cutting stock: column generation over the histogram of piece lengths.

Documents are tokenised once. A document longer than a sequence gives full sequences and a rest; the rests are packed.
The driver sees only the histogram of their lengths (one number per length class): a linear program chooses how often
to use each pattern of classes, a knapsack dynamic program finds the pattern with the best price, the solution is
rounded, and ranked pieces of each class are dealt to the patterns' places by arithmetic on their rank.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small_batches

CAPACITY = 4096
#: Lengths are packed in classes of this many tokens, rounded up.
GRAIN = 16
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"

# The tokenizer's own split of a lower-case text, for texts of Latin-1 letters only.
_LETTERS = "a-zªµºß-öø-ÿ"
_DIGITS = "0-9²³¹¼½¾"
_SPACES = r"\x09-\x0D\x20\x85\xA0"
SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_SPACES}{_LETTERS}{_DIGITS}]+")
_CACHE_ENTRIES = 300_000


def _byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary writes for each byte: printable Latin-1 stands for itself."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordTokenizer:
    """Ids of a text by the tokenizer file, with the ids of frequent words kept in a bounded table.

    Texts outside Latin-1, and texts with a special token's string or with separators that few texts have, go to the
    tokenizer as they are. For all others its own split and vocabulary are applied word by word; results are equal.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.letters = _byte_letters()
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.slow = re.compile("|".join([*special, r"[\x1c-\x1f]"]))

    def _ids(self, word: str) -> bytes:
        spelled = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
        if word.isascii() and not word.isprintable():
            spelled = "".join(map(self.letters.__getitem__, word.encode()))
        return np.array([t.id for t in self.tokenizer.model.tokenize(spelled)], "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if self.slow.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words, known = SPLIT.findall(text.lower()), self.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            if len(known) > _CACHE_ENTRIES:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = self._ids(w)
            return b"".join([known[w] for w in words])


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One per worker process and file."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document: full sequences, then the rest. One pass over the texts, narrow rows out."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = tokenizer(tokenizer_path).encode, np.array([end_id], "<u4").tobytes()
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py()) + end
                total = len(ids) // 4
                rows += [(doc, k, at, min(capacity, total - at), zlib.crc32(ids[4 * at : 4 * (at + capacity)]), total) for k, at in enumerate(range(0, total, capacity))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).mapInArrow(cut, PIECES)


def price_pattern(prices: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The multiset of classes (class k takes k + 1 units) with the largest total price in ``room`` units."""
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    n = len(prices)
    for units in range(1, room + 1):
        k = min(units, n)
        values = prices[:k] + best[units - k : units][::-1]
        top = int(values.argmax())
        best[units], last[units] = values[top], top
        if best[units - 1] >= best[units]:
            best[units], last[units] = best[units - 1], -1
    pattern, units = np.zeros(n, np.int64), room
    while units > 0:
        if last[units] < 0:
            units -= 1
        else:
            pattern[last[units]] += 1
            units -= last[units] + 1
    return float(best[room]), pattern


def largest_first(left: np.ndarray, sizes: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Patterns filled from the largest class down, each used while the demand has all its pieces."""
    left, out = left.copy(), []
    while left.any():
        units, pattern = room, np.zeros(len(left), np.int64)
        for k in range(len(left) - 1, -1, -1):
            take = min(int(left[k]), units // int(sizes[k]))
            pattern[k], units = take, units - take * int(sizes[k])
        times = int((left[pattern > 0] // pattern[pattern > 0]).min())
        out.append((pattern, times))
        left -= pattern * times
    return out


def cutting_stock(demand: np.ndarray, room: int, gap: float = 1e-3) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used; together they hold exactly ``demand`` pieces of each class.

    The linear program (cover the demand with the fewest sequences) starts from one-class patterns. Every column is the
    best one at the current prices, by a knapsack dynamic program. No solution uses fewer sequences than the demand at these
    prices over the best pattern's value, so the loop ends when the solution is within ``gap`` of the highest such bound.
    The demand is raised by tiny amounts of its own for each class: then every pivot lowers the total, so none comes back; where
    rounding hides that over many pivots in a row, the prices are as good as doubles can give, and the loop ends too.
    The solution is rounded down; what is left goes largest first into sequences of its own.
    """
    classes = np.flatnonzero(demand)
    m = len(classes)
    if not m:
        return []
    sizes, need = classes + 1, demand[classes].astype(float)
    raised = need * (1 + gap / 100 * np.random.default_rng(1).random(m)) + 1e-6
    basis = [np.eye(m, dtype=np.int64)[i] * int(room // sizes[i]) for i in range(m)]
    inverse = np.diag(1.0 / np.array([room // s for s in sizes]))
    amount, bound = inverse @ raised, 0.0
    lowest, still = float(amount.sum()), 0
    while still < 4 * m:
        prices = np.maximum(inverse.sum(0), 0)
        full = np.zeros(int(sizes[-1]))
        full[sizes - 1] = prices
        value, wide = price_pattern(full, room)
        bound = max(bound, float(prices @ raised) / max(value, 1.0))
        if value <= 1 + 1e-9 or amount.sum() <= bound * (1 + gap):
            break
        direction = inverse @ wide[sizes - 1]
        up = direction > 1e-9
        ratios = np.where(up, amount / np.where(up, direction, 1), np.inf)
        out = int(ratios.argmin())
        row = inverse[out] / direction[out]
        inverse -= np.outer(direction, row)
        inverse[out] = row
        amount = np.maximum(amount - direction * ratios[out], 0)
        amount[out] = ratios[out]
        basis[out] = wide[sizes - 1]
        still = 0 if amount.sum() < lowest * (1 - 1e-12) else still + 1
        lowest = min(lowest, float(amount.sum()))
    amount = np.maximum(inverse @ need, 0)
    used: dict[bytes, list] = {}
    left = demand[classes].astype(np.int64)
    for pattern, x in zip(basis, np.floor(amount + 1e-6).astype(np.int64), strict=True):
        x = min([int(x), *(left[pattern > 0] // pattern[pattern > 0]).tolist()])
        if x > 0:
            used.setdefault(pattern.tobytes(), [pattern, 0])[1] += x
            left -= pattern * x
    for pattern, times in largest_first(left, sizes, room):
        used.setdefault(pattern.tobytes(), [pattern, 0])[1] += times
    out = []
    for pattern, times in used.values():
        wide = np.zeros(len(demand), np.int64)
        wide[classes] = pattern
        out.append((wide, times))
    return out


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, grain: int = GRAIN, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are one end id; null ids stay null; repeated rows are packed each; extra columns are
    ignored; an empty table gives an empty result.

    The pieces are written once. Their ranks within a class come from the counts of blocks (class, hash block) and
    the rank in the block, so a class with most of the pieces is many blocks. The patterns' places are a table of
    classes times patterns (bounded by the number of classes squared), joined on class and rank.
    """
    spark = docs.sparkSession
    small_batches(spark)
    pieces = token_pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col)
    pieces = materialise(pieces.withColumn("class", (F.ceil(F.col("length") / grain) - 1).cast("int")).withColumn("block", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(512)).cast("int")), "pieces")
    blocks = pieces.groupBy("class", "block").agg(F.count("*").alias("n"))
    up_to = Window.partitionBy("class").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = materialise(blocks.withColumn("before", F.coalesce(F.sum("n").over(up_to), F.lit(0))), "blocks")
    demand = np.zeros(-(-capacity // grain), np.int64)
    for row in blocks.groupBy("class").agg(F.sum("n").alias("n")).collect():  # one row per length class
        demand[row["class"]] = row["n"]
    places, base = [], 0
    taken = np.zeros(len(demand), np.int64)
    for pattern, times in cutting_stock(demand, len(demand)):
        for k in np.flatnonzero(pattern):
            each = int(pattern[k])
            places.append((int(k), int(taken[k]), int(taken[k]) + each * times, each, base))
            taken[k] += each * times
        base += times
    if not places:
        places = [(-1, 0, 0, 1, 0)]
    table = spark.createDataFrame(places, "class int, first bigint, last bigint, each bigint, base bigint")
    place = Window.partitionBy("class", "block").orderBy(F.col("doc_id").isNull(), "doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("in_block", F.row_number().over(place) - 1).join(blocks.drop("n"), ["class", "block"]).withColumn("rank", F.col("before") + F.col("in_block"))
    dealt = ranked.join(F.broadcast(table), (ranked["class"] == table["class"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    dealt = dealt.withColumn("sequence_id", F.col("base") + F.floor((F.col("rank") - F.col("first")) / F.col("each")))
    order = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), F.col("doc_id").isNull(), "doc_id", "start", "ids_crc32", "rank").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
