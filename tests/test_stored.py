"""Stored run statistics, ordered exports, symbols of intents, searches, and binned distributions."""

import glob
import json
import random

import pytest
from pyspark.sql import functions as F

from steploom.operators import marts, pairing, sequences, stored
from steploom.plans import stored_queries

SF = "/root/testdata/sf0.001"


def test_pairs_from_the_stored_table_need_no_exchange(spark):
    joined = stored_queries.stored_pairs(spark, SF)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and joined.count() > 0


def test_files_of_an_export_are_in_order(spark, tmp_path):
    r = random.Random(1)
    made = [(r.choice("abc"), r.randint(0, 50), k, None if k % 7 == 0 else f"t\n{k}") for k in range(2_000)]
    path = str(tmp_path / "x")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stored.export_ordered(spark.createDataFrame(made, "model string, instance int, run int, text string").repartition(5), path, ["model", "instance", "run"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    names = sorted(glob.glob(f"{path}/part-*"))
    lines = [json.loads(x) for n in names for x in open(n)]
    want = sorted(made, key=lambda x: x[:3])
    assert len(names) > 3 and [tuple(x[c] for c in ("model", "instance", "run", "text")) for x in lines] == want
    back = stored.read_ordered(spark, path, "model string, instance int, run int, text string").orderBy("place").collect()
    assert [r["place"] for r in back] == list(range(2_000)) and [(r.model, r.instance, r.run, r.text) for r in back] == want


def test_symbols(spark):
    steps = spark.createDataFrame([(1, "m", k, f"i{x:02d}") for k, x in enumerate([3, 1, 3, 2])], "run_id int, model string, step_idx int, intent string")
    assert [r.sequence for r in sequences.intent_strings(steps).collect()] == ["CACB"]
    many = spark.range(65).select(F.concat(F.lit("i"), F.format_string("%02d", "id")).alias("intent"))
    assert sequences.symbols(many.limit(64)).count() == 64
    with pytest.raises(ValueError, match="65 intents"):
        sequences.symbols(many)


def test_find_runs(spark):
    made = [(1, "a", "r2", "t1", True, 5, "EVE"), (2, "b", "r1", "t1", False, 9, "eV"), (3, "a", "r1", "t2", True, 2, "RS"), (4, "b", "r1", "t1", True, 9, "VEV")]
    df = spark.createDataFrame(made, "run_id int, model string, repo string, task string, submitted boolean, steps int, sequence string")
    found = lambda **k: [r.run_id for r in sequences.find_runs(df, **k).collect()]
    assert found() == [2, 4, 3, 1] and found(contains=" ev ") == [2, 4, 1] and found(contains="ev", submitted_only=True) == [4, 1]
    assert found(sort="steps_desc") == [2, 4, 1, 3] and found(sort="steps_asc") == [3, 1, 2, 4]
    assert found(models=["a"]) == [3, 1] and found(repos=["r1"], tasks=["t1"]) == [2, 4] and found(contains=".") == []


def test_binned_distribution(spark):
    def plain(steps, cap=250):
        bins = sorted({s // 5 * 5 for s in steps})
        points = [(0, 0.0)] + [(min(b, cap), sum(s // 5 * 5 <= b for s in steps) / len(steps)) for b in bins]
        k = next(k for k in range(1, len(points)) if points[k][1] >= 0.5)
        (x0, y0), (x1, y1) = points[k - 1], points[k]
        return 1 - sum(s // 5 * 5 < cap for s in steps) / len(steps), x0 + (0.5 - y0) * (x1 - x0) / (y1 - y0)

    r = random.Random(2)
    of = {"a": [r.randint(1, 400) for _ in range(101)], "b": [7], "c": [300, 900, 251], "d": [3, 4, 260, 270]}
    df = spark.createDataFrame([(m, s) for m, v in of.items() for s in v], "model string, steps int")
    for row in marts.ecdf_summary(df).collect():
        assert (row.censored, row.median) == pytest.approx(plain(of[row.model])) and row.total == len(of[row.model])


def test_model_family(spark):
    df = spark.createDataFrame([("GPT-5",), ("Claude-4",), ("glm",), (None,)], "m string")
    assert [tuple(r) for r in df.select(stored.model_family(F.col("m")), stored.model_family(F.col("m"), two=True)).collect()] == [("gpt5", "gpt5"), ("claude", "claude"), (None, "claude"), (None, "claude")]


def test_sections_cover_all_metrics():
    assert sorted(m for names in pairing.SECTIONS.values() for m in names) == sorted(pairing.METRICS)
