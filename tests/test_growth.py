"""Files that don't grow in number with sessions, labels made once, and decimal shares of runs."""

import glob
import json
import os

from pyspark.sql import functions as F

from steploom.functions.sessions import meaningful_command, message_class
from steploom.operators import marts
from steploom.operators import sessions as S
from steploom.plans import stored_queries, transcript_files
from steploom.sources import ingest

SF = "/root/testdata/sf0.001"


def sessions_of(path):
    """The sessions of each file, in order, every event counted."""
    out = {}
    for name in glob.glob(f"{path}/**/part-*", recursive=True):
        lines = [x for x in open(name).read().split("\n") if x.endswith("}")]
        out[name] = [json.loads(x)["sessionId"] for x in lines]
    return out


def runs_of(ids):
    return [x for k, x in enumerate(ids) if k == 0 or ids[k - 1] != x]


def test_files_hold_many_whole_sessions(spark, tmp_path):
    rows = transcript_files.transcript_rows(spark, SF)
    transcript_files.write_lines(rows, f"file://{tmp_path}")
    found = sessions_of(tmp_path)
    blocks = [s for ids in found.values() for s in runs_of(ids)]
    n = rows.select("session").distinct().count()
    assert len(found) <= 8 < n and len(blocks) == len(set(blocks)) == n  # each in one file, in one piece
    assert transcript_files.read_packed(spark, f"file://{tmp_path}").where("session is null").isEmpty()


def test_folders_of_sessions(spark, tmp_path):
    rows = spark.range(3_000).select(F.col("id").alias("session"), F.array(F.lit(0).cast("bigint")).alias("at"), F.format_string('{"sessionId": "%d"}', "id").alias("line"))
    transcript_files.write_parts(rows, f"file://{tmp_path}", 5, packs=4)
    found = sessions_of(tmp_path)
    assert len(found) <= 20 and sorted(int(x) for ids in found.values() for x in ids) == list(range(3_000))
    assert all(int(x) % 5 == int(name.split("part=")[1].split("/")[0]) for name, ids in found.items() for x in ids)
    transcript_files.drop_parts(spark, f"file://{tmp_path}", [0, 3, 9])
    assert sorted(x for x in os.listdir(tmp_path) if x.startswith("part=")) == ["part=1", "part=2", "part=4"]


def test_the_last_part_of_a_run_is_decimal(spark):
    steps = spark.range(90).select(F.lit(1).alias("run_id"), F.lit("m").alias("model"), F.col("id").alias("step_idx"), F.lit("i").alias("intent"))
    assert marts.tail_mix(steps).first().n == 27  # from step 63 on, not 62


def test_strings_read_stored_intents(spark):
    for name in ("intent_strings", "sequence_find"):
        plan = stored_queries.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "action" not in plan and "sequence" in plan, name


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_categories_label_the_calls_once(spark):
    assert optimized(transcript_files.QUERIES["transcript_categories"](spark, SF)).count("Generate explode") == 2  # one intent for all, one for calls


def test_success_reads_calls_once(spark):
    plan = optimized(transcript_files.QUERIES["transcript_success"](spark, SF))
    assert plan.count("Generate posexplode") == 1 and "Union" not in plan


def test_signals_of_sessions_with_edits_or_messages_only(spark):
    kinds = "session int, name string, path string, command string, result string, is_error boolean"
    calls = spark.createDataFrame([(1, "edit", "/a.ts", None, "", False), (2, "bash", None, "git push", "", None), (3, "read", "/a.ts", None, "", False), (4, "write", "/test.ts", None, "", False)], kinds)
    said = S.placed(spark.createDataFrame([(5, 7, "b"), (5, 3, "a"), (5, 9, "looks good")], "session int, turn int, text string"))
    assert [(r.turn, r.message_index) for r in said.orderBy("turn").collect()] == [(3, 1), (7, 2), (9, 3)]
    found = {r.session: (r.n_user, r.pushed, r.source_edit, r.last_closeout) for r in S.ship_signals(calls, said).collect()}
    assert found == {1: (0, False, True, False), 2: (0, False, False, False), 5: (3, False, False, True)}


def test_lines_are_parsed_once(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"type": "session"}\n{"ty\n\n{"type": "note"}\n')
    read = ingest.transcripts(spark, f"file://{tmp_path}")
    assert optimized(read).count("from_json") == 1
    assert [(r.line_no, r.type) for r in read.orderBy("line_no").collect()] == [(0, "session"), (3, "note")]


def test_commands_are_split_once(spark):
    rows = ["cd /r\nls", "set -e\n\ncd /r && ls", "set -e", "A=1\nfi", "cd /r", " ls \r\n then", ""]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(rows)], "k int, c string").select("k", meaningful_command(F.col("c")).alias("m"))
    assert optimized(df).count("fi|do|done") == 1
    assert [r.m for r in df.orderBy("k").collect()] == ["ls", "cd /r && ls", "set -e", "fi", "cd /r", "ls", ""]


def test_messages_are_normalised_once(spark):
    rows = {
        "We  should go": "solution_steer", "xwe should go": "task_brief", "see @packages/": "solution_steer", "the Changelog": "workflow_closeout", "changelogs": "task_brief", "commit": "workflow_closeout",
        "docs in @x": "workflow_closeout", "problem: x": "task_brief", "FFB647C": "evidence_or_repro", "a ffb647c": "task_brief", "fix it": "authorize_work", "fix it, we need use ": "authorize_work",
        "fix it, we should use this": "solution_steer", "lgtm": "validation_request",
    }
    df = spark.createDataFrame([(k, m) for k, m in enumerate(rows)], "k int, m string").select("k", message_class(F.col("m"), F.lit(1)).alias("c"))
    plan = optimized(df)
    assert plan.count("regexp_replace") == 2 and r"\bcan we\b" not in plan
    assert [r.c for r in df.orderBy("k").collect()] == list(rows.values())
