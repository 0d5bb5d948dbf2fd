"""Streamed marts equal the same marts of a batch, through a crash within a batch and a restart; finer marts by hand."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from steploom.functions import dims
from steploom.functions.outcomes import repo_of_task
from steploom.functions.quantiles import quartiles_and_medians
from steploom.functions.text import strip_wrappers
from steploom.operators import labels, marts
from steploom.operators import sessions as S
from steploom.plans import run_queries
from steploom.streaming import marts as streamed

from .test_transcripts import ONE, SF, TWO, call, msg, text, write

THREE = [
    msg("assistant", [call("1", "edit", path="/r/a.ts", oldText="x", newText="y"), call("2", "bash", command="npx vitest"), call("3", "bash", command="frob")], model="gpt-5.4"),
    msg("toolResult", [text("bash: frob: command not found")], toolCallId="3", isError=True),
]


def rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


def test_stream_equals_batch_after_a_restart(spark, tmp_path):
    root, path = tmp_path / "in", f"file://{tmp_path}/out"
    root.mkdir()
    write(root, "a.jsonl", ONE, broken=True)
    write(root, "b.jsonl", TWO)
    streamed.stream_marts(spark, str(root), path)
    write(root, "c.jsonl", ONE)
    write(root, "d.jsonl", THREE)
    (root / "e.jsonl").write_text("")
    (root / "notes.txt").write_text("{}")

    @dataclasses.dataclass(frozen=True)
    class Broken(streamed.Additive):
        def part(self, steps):
            raise ZeroDivisionError

    broken = {**streamed.MARTS, "modes": Broken(["model"], {})}
    with pytest.raises(Exception, match="ZeroDivisionError"):
        streamed.stream_marts(spark, str(root), path, marts=broken)  # some marts of the batch are written
    before = streamed.read_streamed(spark, path, "models")
    assert before.agg(F.sum("n_runs")).first()[0] == 2  # what isn't done doesn't count
    streamed.stream_marts(spark, str(root), path, files_per_batch=1)
    streamed.stream_marts(spark, str(root), path)  # nothing is new
    batch = streamed.transcript_steps(spark, [str(root)], "*.jsonl").cache()
    assert batch.count() == 15
    for name, mart in streamed.MARTS.items():
        got, want = rows(streamed.read_streamed(spark, path, name)), rows(mart.part(batch))
        assert got == want and got, name
    assert rows(streamed.read_streamed(spark, path, "intents").select("model", "intent", "n")) == rows(marts.intent_frequencies(batch).select("model", "intent", "n"))


def test_files_a_batch(spark, tmp_path):
    root, path = tmp_path / "in", f"file://{tmp_path}/out"
    root.mkdir()
    for k in range(5):
        write(root, f"{k}.jsonl", TWO)
    streamed.stream_marts(spark, str(root), path, files_per_batch=2)
    done = spark.read.parquet(f"{path}/done")
    assert sorted(r.n_files for r in done.collect()) == [1, 2, 2]
    assert streamed.read_streamed(spark, path, "models").first().n_runs == 5


def test_statistics_of_parts_equal_those_of_filtered_rows(spark):
    data = [("a", float(v * 7 % 11), v % 3 == 0) for v in range(40)] + [("b", 2.0, False), ("c", None, True)]
    df = spark.createDataFrame(data, "k string, v double, won boolean")
    got = {r.k: r for r in quartiles_and_medians(df, ["k"], "v", {"won_median": F.col("won"), "lost_median": ~F.col("won")}).collect()}
    median = lambda xs: (sorted(xs)[(len(xs) - 1) // 2] + sorted(xs)[len(xs) // 2]) / 2
    own = [(v, w) for k, v, w in data if k == "a"]
    a = got["a"]
    assert (a.n, a.median, a.won_median, a.lost_median) == (40, median([v for v, _ in own]), median([v for v, w in own if w]), median([v for v, w in own if not w]))
    assert a.p25 == sorted(v for v, _ in own)[10] and got["b"].won_median is None and got["b"].lost_median == 2.0 and "c" not in got


def test_labels_by_need_equal_all_labels(spark):
    from steploom.plans import fixtures

    s = fixtures.steps(spark, SF)
    every = labels.label(s).select("run_id", "step_idx", "mode", "act")
    assert rows(every) == rows(labels.with_acts(labels.with_modes(s)).select("run_id", "step_idx", "mode", "act"))


def test_plans(spark):
    plan = lambda name: run_queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan("structural_markers").count("Exchange hashpartitioning") <= 5
    stats = plan("run_stats")
    assert stats.count("Exchange hashpartitioning") == 1 and "Generate " not in stats


def test_wrappers_and_task_ids(spark):
    ask = lambda f, values: [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string").orderBy("k").select(f(F.col("v"))).collect()]
    wrapped = ["A=1 B=2 env C=3 timeout 5 pytest x", "set -e -x; set -o pipefail; env make", "timeout 5", "settle -e; x", "  env  ", "A= b c", "1A=2 x", "timeout 3 " * 5 + "ls"]
    assert ask(strip_wrappers, wrapped) == ["pytest x", "make", "timeout 5", "settle -e; x", "env", "A= b c", "1A=2 x", "ls"]
    ids = ["instance_org__my-repo-0123abcd-v12", "org__repo-012345", "org__repo", "none", "instance_a__b__c-0123abc", ""]
    assert ask(repo_of_task, ids) == ["org/my-repo", "org/repo-012345", "org/repo", "unknown/unknown", "a/b__c", "unknown/unknown"]
    assert ask(lambda c: repo_of_task(c, with_commit=True), ids) == ["org/my", "org/repo", "org/repo", "", "a/b", ""]


def test_bands_and_totals(spark):
    profile = spark.createDataFrame([("m", 0, "R", 0.2), ("m", 0, "S", 0.2), ("m", 0, "G", 0.4), ("m", 0, "H", 0.1), ("m", 0, "X", 0.1), ("m", 1, "G", 1.0)], "model string, bin int, letter string, mean_share double")
    got = {(r.bin, r.band): r.share for r in marts.phase_bands(profile, dims.BANDS).collect()}
    assert got == {(0, "understand"): pytest.approx(0.4 / 0.9), (0, "cleanup"): pytest.approx(0.5 / 0.9), (1, "cleanup"): 1.0}
    got = {(r.bin, r.band): r.share for r in marts.phase_bands(profile, dims.SESSION_BANDS, without=("git",)).collect()}
    assert got == {(0, "understand"): pytest.approx(0.8), (0, "housekeeping"): pytest.approx(0.2)}
    per = spark.createDataFrame([("a", 3, 4, 1), ("b", 2, 0, 0)], "model string, n_sessions long, n_attempted long, n_resolved long")
    assert {(r.model, r.n_sessions, r.n_attempted, r.n_resolved, r.rate) for r in S.with_issue_totals(per).collect()} == {("a", 3, 4, 1, 25.0), ("b", 2, 0, 0, 0.0), (None, 5, 4, 1, 25.0)}
