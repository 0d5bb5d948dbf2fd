"""Words and texts that polynomial hashes confuse, and column generation that ends by its bound."""

import zlib

import numpy as np
import pytest

from steploom.llm import jaccard_join, ngram_lm, packing, quality_rules, substring_dedup
from steploom.llm.tokens import Words

from . import brute
from .test_operators import by_id, labels  # noqa: F401


def thue_morse(n, letters):
    return "".join(letters[bin(k).count("1") & 1] for k in range(n))


@pytest.mark.parametrize("n", [64, 1024, 2048, 4096])
def test_words_of_swapped_letters_have_other_hashes(n):
    made = [thue_morse(n, "ab"), thue_morse(n, "ba"), thue_morse(n, "ab") + "a", thue_morse(n, "ab")[:-1]]
    data = np.frombuffer(" ".join(made).encode(), np.uint8)
    assert len(set(Words(data, np.array([0, len(data)])).hashes().tolist())) == 4


def test_words_are_hashed_by_their_bytes_alone():
    words = ["a", "ab", "abcdefgh", "abcdefghi", "b" * 17, "\x00", "\x00\x00", "é", "a"]
    text = " ".join(words).encode()
    hashes = Words(np.frombuffer(text, np.uint8), np.array([0, len(text)])).hashes().tolist()
    alone = [Words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())])).hashes()[0] for w in words]
    assert hashes == alone and len(set(hashes)) == len(words) - 1


def test_operators_tell_such_words_apart(spark, labels):  # noqa: F811
    a, b = thue_morse(1024, "ab"), thue_morse(1024, "ba")
    many = [" ".join(f"w{k}{x}" for k in range(25)) for x in "xy"]
    made = [(0, a), (1, b), (5, f"{many[0]} {a} {many[1]}"), (10, f"{many[0]} {b} {many[1]}"), (11, f"{many[0]} {b} {many[1]}"), (12, f"{a} x y {b} x y")]
    df = spark.createDataFrame(made, "doc_id long, text string")
    assert by_id(substring_dedup.remove_repeats(df), "n_words", "n_removed", "kept_sha256") == brute.repeats(made, 50)
    assert by_id(jaccard_join.jaccard_components(df), "n_shingles", "component_id") == brute.jaccard(made)
    got = by_id(quality_rules.judge(df, labels), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == {i: brute.rules(t) for i, t in made}
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 1)
    trained = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 5 != 1)
    known = by_id(ngram_lm.score_corpus(spark.createDataFrame([(trained, a), (held, b)], "doc_id long, text string"), order=3), "held_out", "n_known")
    assert known == {trained: (False, 2), held: (True, 1)}  # of the held-out text only its end is known


def lengths(kind, r):
    return {"uniform": r.integers(0, 256, 1000), "one": np.array([255]), "short": r.integers(0, 5, 1000), "skewed": np.minimum(255, np.exp(r.normal(3, 1, 20_000)).astype(int))}[kind]


@pytest.mark.parametrize("kind", ["uniform", "one", "short", "skewed"])
def test_column_generation_ends_by_its_bound(kind, monkeypatch):
    calls, price = [], packing.price_pattern
    monkeypatch.setattr(packing, "price_pattern", lambda *a: calls.append(1) or price(*a))
    demand = np.bincount(lengths(kind, np.random.default_rng(3)), minlength=256)
    found = packing.cutting_stock(demand, 256)
    sizes = np.arange(1, 257)
    assert (sum(p * n for p, n in found) == demand).all() and all(p @ sizes <= 256 for p, _ in found) and calls
    used, area = sum(n for _, n in found), demand @ sizes / 256
    assert used <= area * 1.01 + len(np.flatnonzero(demand)) / 20 + 1
