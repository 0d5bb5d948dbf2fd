"""Bit-sliced importance resampling against a plain version."""

import random

import numpy as np
import pytest

from steploom.llm import target_draw
from steploom.llm.queries import QUERIES

from . import brute
from .test_operators import SF, awkward, by_id, docs, odd, rows  # noqa: F401

COLUMNS = ("n_features", "weight", "score", "rank")


@pytest.fixture(scope="module")
def target(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


def test_query_equals_the_plain_version(spark, rows, target):  # noqa: F811
    got = QUERIES["op11_target_draw"](spark, SF)
    assert got.columns == ["doc_id", *COLUMNS] and {t for _, t in got.dtypes} == {"bigint"}
    assert by_id(got, *COLUMNS) == brute.draw(rows, [r.text for r in target.collect()])


@pytest.mark.parametrize("limit", [40, 300, 1 << 19])
def test_awkward_rows_and_texts_in_pieces(rows, docs, awkward, odd, target, limit, monkeypatch):  # noqa: F811
    """Extra columns with clashing names, nulls, long words, and texts longer than a slice."""
    monkeypatch.setattr(target_draw, "SLICE_BYTES", limit)
    more = docs.where("doc_id < 30")
    df = awkward.unionByName(more, allowMissingColumns=True)
    got = by_id(target_draw.draw(df, target, percent=40, min_words=2), *COLUMNS)
    assert got == brute.draw(odd + [x for x in rows if x[0] < 30], [r.text for r in target.collect()], 40, 2)


def test_very_long_text(spark, target):
    r = random.Random(5)
    text = " ".join(r.choice(["Alpha", "béta", "x" * 70, "a-b", "7"]) for _ in range(400_000))
    assert len(text) > 5_000_000
    made = [(1, text), (2, "one two"), (3, None)]
    got = by_id(target_draw.draw(spark.createDataFrame(made, "doc_id long, text string"), target, 100, 1), *COLUMNS)
    assert got == brute.draw(made, [x.text for x in target.collect()], 100, 1)


def test_null_ids_ties_repeats_and_empty_tables(spark, target):
    text = " ".join(f"w{k}" for k in range(25))
    df = spark.createDataFrame([(None, text), (7, text), (7, text), (None, text)], "doc_id long, text string")
    got = target_draw.draw(df, target, percent=100).collect()
    assert sorted(x["rank"] for x in got) == [1, 2, 3, 4] and len({x.weight for x in got}) == 1
    seven = [x["rank"] for x in got if x.doc_id == 7]
    assert max(seven) - min(seven) == 1
    same = spark.createDataFrame([(k, "") for k in range(50)], "doc_id long, text string")
    drawn = [x for x in target_draw.draw(same, target, percent=10, min_words=0).collect() if x["rank"]]
    assert len(drawn) == 5 and all(x.weight == 0 for x in drawn)
    empty = df.where("false")
    assert target_draw.draw(empty, target).count() == 0
    assert {x.weight for x in target_draw.draw(df, target.where("false")).collect()} == {sum(int(v) for v in _own_gains(df, text))}


def _own_gains(df, text):
    raw = target_draw.bucket_counts(df)
    values = target_draw.gains(raw, np.zeros(target_draw.BUCKETS, np.int64))
    of = target_draw.bucket_counts(df.limit(1))
    return values * of


def test_planes_hold_any_gain():
    r = np.random.default_rng(3)
    values = r.integers(-20_000, 20_000, target_draw.BUCKETS)
    keys = np.sort(r.choice(3 * target_draw.BUCKETS, 2_000, replace=False))
    counts = r.integers(1, 5_000, 2_000)
    want = [int((counts * values[keys % target_draw.BUCKETS])[keys // target_draw.BUCKETS == d].sum()) for d in range(3)]
    assert target_draw._bit_sliced(3, keys, counts, target_draw.gain_planes(values)).tolist() == want
