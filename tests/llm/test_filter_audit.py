"""The filter audit against a walk through all orders, and the join that spreads common keys."""

import random

import pytest
from pyspark.sql import functions as F

from steploom.llm import common, filter_audit

from . import brute
from .test_operators import SCHEMA, awkward, docs, labels  # noqa: F401

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def found(df):
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in COLUMNS[3:]) for r in df.collect()}


def test_whole_table_with_awkward_rows(spark, docs, awkward, labels):  # noqa: F811
    """Nulls, empty and long texts, columns named like the operator's own, labels given twice, repeated rows."""
    more = [(1, "s", "A" * 9, "z", 1), (None, "same", None, "y", 2), (3, "same", "s", "y", 2), (3, "same", "s", "y", 2), (2, "same", "t", "y", 2), (None, "same", "t", "x", 3)]
    odd = spark.createDataFrame([(i, t, s, a, b) for i, t, s, a, b in more], "doc_id long, text string, source string, part string, step int")
    df = docs.unionByName(awkward, allowMissingColumns=True).unionByName(odd, allowMissingColumns=True).withColumn("row", F.lit(1)).withColumn("filter", F.lit("A"))
    marks = labels.select("doc_id", "quality", "toxic").union(spark.createDataFrame([(10_003, 0, 1), (10_003, 1, 0), (3, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int"))
    got = filter_audit.audit(df, marks)
    assert got.columns == COLUMNS
    want = brute.audit([(r.doc_id, r.text, r.source) for r in df.collect()], [tuple(r) for r in marks.collect()])
    assert found(got) == want and any(v[4] for v in want.values()) and any(v[5] for v in want.values())


def test_text_of_a_whole_megabyte_and_hot_texts(spark, labels, monkeypatch):  # noqa: F811
    r = random.Random(1)
    big = " ".join(f"w{r.randint(0, 999)}" for _ in range(2_000_000))
    made = [(k, "copy # of a text", "hot") for k in range(400)] + [(1_000, big, "x"), (1_001, big, "hot"), (1_002, big + " ", "hot"), (1_003, "", "x")]
    df = spark.createDataFrame(made, "doc_id long, text string, source string").repartition(6)
    for share in (10_000, 4):  # with 4, most texts take the way of rare ones
        monkeypatch.setattr(common, "COMMON", share)
        assert found(filter_audit.audit(df, labels.where("false"))) == brute.audit(made, [])


def test_empty_table(spark, docs, labels):  # noqa: F811
    assert filter_audit.audit(docs.where("false"), labels).count() == 0


@pytest.mark.parametrize("share", [2, 7, 10_000])
def test_common_rows(spark, share, monkeypatch):
    monkeypatch.setattr(common, "COMMON", share)
    keys = ["a"] * 50 + ["b"] * 20 + list("cdefgh") + [None] * 3
    rows = spark.createDataFrame(list(enumerate(keys)), "i int, k string")
    groups = rows.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("top")).where("k <> 'h'")
    got = common.common_rows(rows, groups, "k", len(keys))
    top = {k: max(i for i, x in enumerate(keys) if x == k) for k in "abcdefg"}
    assert got.columns == ["i", "k", "n", "top"]
    assert sorted((r.i, r.k, r.top) for r in got.collect()) == [(i, k, top.get(k)) for i, k in enumerate(keys)]
