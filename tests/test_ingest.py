"""Readers and the stream on small files in the real formats."""

import json

from pyspark.sql import functions as F

from steploom.sources import ingest
from steploom.streaming import files as stream


def traj(root, model, name, doc):
    folder = root / model / "traj" / name
    folder.mkdir(parents=True)
    (folder / f"{name}.traj").write_text(json.dumps(doc))


def test_trajectories(spark, tmp_path):
    steps = [{"action": "ls", "observation": "a", "execution_time": 1.5}, {"action": None, "observation": None}]
    history = [{"role": "assistant", "content": "Hi there.", "thought": "Hi there.", "tool_calls": [{"function": {"arguments": "{}"}}]}, {"role": "user", "content": "x"}]
    stats = {"instance_cost": 1.25, "tokens_sent": 7, "tokens_received": 3, "api_calls": 2}
    config = json.dumps({"agent": {"model": {"name": "m", "temperature": 0.5, "completion_kwargs": {"k": "v"}}}})
    traj(tmp_path, "m1", "a-1", {"environment": "env", "trajectory": steps, "history": history, "info": {"exit_status": "submitted", "submission": "diff", "model_stats": stats}, "replay_config": config})
    traj(tmp_path, "m1", "b-2", {"trajectory": [], "info": {}, "replay_config": "{broken"})
    traj(tmp_path, "m2", "c-3", {"trajectory": steps[:1]})
    files = ingest.trajectories(spark, str(tmp_path))
    assert sorted((r.model, r.instance_id, r.task) for r in files.collect()) == [("m1", "a-1", "env"), ("m1", "b-2", "b-2"), ("m2", "c-3", "c-3")]
    assert ingest.trajectories(spark, str(tmp_path), ["m2"]).count() == 1
    assert [(r.step_idx, r.action) for r in ingest.trajectory_steps(files).where("model = 'm1'").orderBy("step_idx").collect()] == [(0, "ls"), (1, None)]
    got = {r.instance_id: r for r in ingest.trajectory_stats(files).collect()}
    assert (got["a-1"].cost, got["a-1"].api_calls, got["a-1"].has_patch, got["a-1"].output_words) == (1.25, 2, True, 5)
    assert (got["b-2"].steps, got["b-2"].cost, got["b-2"].submitted_any) == (0, 0.0, False)
    config = {r.instance_id: r for r in ingest.run_config(files).collect()}
    assert config["a-1"].model_name == "m" and config["a-1"].options == {"k": "v"} and config["b-2"].model_name is None


def test_transcripts_and_stream(spark, tmp_path):
    lines = [
        json.dumps({"type": "session", "cwd": "/r/app"}),
        "",
        "{broken",
        json.dumps({"type": "message", "message": {"role": "toolResult", "toolCallId": "1", "content": [{"type": "text", "text": "a"}, {"type": "image"}], "details": {"diff": "+x"}}}),
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/s.jsonl").write_text("\n".join(lines))
    events = ingest.transcripts(spark, str(tmp_path / "in"))
    assert [(r.line_no, r.type) for r in events.orderBy("line_no").collect()] == [(0, "session"), (3, "message")]
    assert [r.bad_lines for r in ingest.bad_line_counts(spark, str(tmp_path / "in")).collect()] == [1]
    text = events.where("type = 'message'").select(ingest.flatten_content(F.col("message.content"), F.col("message.details.diff")).alias("t")).first().t
    assert text == "a\n[image]\n+x"
    seen = []
    run = lambda: stream.ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "state"), lambda b, _: seen.append(b.count()))
    run()
    (tmp_path / "in/t.jsonl").write_text(lines[0])
    run()
    run()
    assert sum(seen) == 2
    kinds = lambda b: b.select(F.explode(F.split("value", "\n")).alias("line")).select(F.get_json_object("line", "$.type").alias("type")).where("type is not null")
    stream.ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "state2"), stream.count_into(str(tmp_path / "counts"), ["type"], kinds))
    assert {r.type: r.n for r in stream.totals(spark, str(tmp_path / "counts"), ["type"]).collect()} == {"session": 2, "message": 1}


def test_outcomes_and_ledger(spark, tmp_path):
    (tmp_path / "r.csv").write_text("metadata.model_name,metadata.instance_id,metadata.resolved\nA,i,true\nB,i,false\nC,i,true\n")
    got = ingest.outcome_table(spark, str(tmp_path / "r.csv"), {"A": "a", "B": "b"}).collect()
    assert sorted((r.model, r.resolved) for r in got) == [("a", True), ("b", False)]
    (tmp_path / "e.json").write_text(json.dumps({"i": True, "j": False}))
    evals = ingest.eval_map(spark, str(tmp_path / "e.json")).unionByName(spark.createDataFrame([("m", "j", True)], "scope string, instance_id string, resolved boolean"))
    runs = spark.createDataFrame([("m", "i"), ("m", "j"), ("n", "j"), ("n", "k")], "model string, instance_id string")
    assert sorted((r.model, r.instance_id, r.resolved) for r in ingest.with_outcomes(runs, evals).collect()) == [("m", "i", True), ("m", "j", True), ("n", "j", False), ("n", "k", None)]
    files = lambda: spark.read.text(str(tmp_path / "r.csv"), wholetext=True)
    first = ingest.unseen(files(), None).select("version")
    first.write.parquet(str(tmp_path / "ledger"))
    assert ingest.unseen(files(), spark.read.parquet(str(tmp_path / "ledger"))).count() == 0
    ingest.write_mart(runs, str(tmp_path / "mart"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "mart")).count() == 4
