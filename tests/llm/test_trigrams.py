"""The model of order three beside a plain one."""

import collections
import math
import zlib

import pytest

from steploom.llm import gram_shards, ngram_lm
from steploom.llm.queries import QUERIES

from . import brute
from .test_operators import SF, by_id

ODD = [None, "", " \t\n", "a", "A", "a b", "a b c", "a b c", "la " * 3000, "é ü ß 日本"]


def kneser_ney_3(rows):
    """({id: score}, p(before, word), words): bigrams count by the words before them, or as they occur after <s>."""
    tokens = lambda t: ["<s>", *brute.words((t or "").translate(brute.LOWER)), "</s>"]
    out_of = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    threes, raw, words = collections.Counter(), collections.Counter(), set()
    for i, t in rows:
        if not out_of(i):
            w = tokens(t)
            words.update(w[1:])
            raw.update(zip(w, w[1:], strict=False))
            threes.update(zip(w, w[1:], w[2:], strict=False))
    before = collections.Counter(k[1:] for k in threes)
    twos = {k: n if k[0] == "<s>" else before[k] for k, n in raw.items()}
    ones = collections.Counter(w for _, w in raw)
    fit = lambda c: brute._discounts(*(sum(n == k for n in c.values()) for k in (1, 2, 3, 4)))
    levels = []
    for counts in ({(w,): n for w, n in ones.items()}, twos, threes):
        d, total, rest = fit(counts), collections.Counter(), collections.Counter()
        for k, n in counts.items():
            total[k[:-1]] += n
            rest[k[:-1]] += d[min(n, 3) - 1]
        levels.append((counts, d, total, rest))

    def p(history, w):
        counts, d, total, rest = levels[len(history)]
        lower = p(history[1:], w) if history else 1 / (len(words) + 1)
        if not total[history]:
            return lower
        n = counts.get((*history, w), 0)
        return (max(n - d[min(n, 3) - 1], 0) if n else 0) / total[history] + rest[history] / total[history] * lower

    made = {}
    for i, t in rows:
        w = tokens(t)
        made[i] = sum(math.log10(p(tuple(w[max(0, k - 2) : k]), w[k])) for k in range(1, len(w)))
    return made, p, words


def test_order_three(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10_000 + k, t) for k, t in enumerate(ODD)], "doc_id long, text string")
    df = docs.union(odd)
    made, p, words = kneser_ney_3([tuple(r) for r in df.collect()])
    assert sum(p(("la", "la"), w) for w in words) + p(("la", "la"), None) == pytest.approx(1)
    for size in (6_000_000, 5_000):  # with many shards, ' la la' is dealt to several
        monkeypatch.setattr(gram_shards, "SHARD_HASHES", size)
        assert by_id(ngram_lm.score_corpus(df, order=3), "score") == {i: (pytest.approx(x, rel=1e-9),) for i, x in made.items()}
    none = ngram_lm.score_corpus(docs.limit(0), order=3)
    assert none.count() == 0


def test_query_sees_two_words_of_context(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    made, _, _ = kneser_ney_3(rows)
    assert by_id(QUERIES["op4_lm_scoring"](spark, SF), "score") == {i: (pytest.approx(x, rel=1e-9),) for i, x in made.items()}
