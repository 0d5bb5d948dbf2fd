"""Transcript files in their real format: lines in order, tables of sessions, marts, and the ledger."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from steploom.operators import sessions as S
from steploom.operators import transcripts as T
from steploom.plans import session_queries as Q
from steploom.plans import transcript_files
from steploom.sources import ingest, splits
from steploom.sources.ledger import Ledger

SF = "/root/testdata/sf0.001"


def msg(role, content=None, **more):
    return {"type": "message", "message": {"role": role, "content": content, **more}}


def text(t):
    return {"type": "text", "text": t}


def call(i, name, **arguments):
    return {"type": "toolCall", "id": i, "name": name, "arguments": arguments}


ONE = [
    {"type": "session", "cwd": "/home/u/app/"},
    {"type": "session_info", "name": "Draft"},
    {"type": "model_change", "modelId": "gpt-5.4"},
    msg("user", [text("see https://github.com/o/r/issues/7"), {"type": "image"}, text("please fix it")]),
    msg("assistant", [text("on it"), call("1", "read", path="/r/a.ts"), call("2", "bash", command="npx vitest")], model="us.anthropic.claude-opus-4.5", stopReason="toolUse"),
    msg("toolResult", [text("source"), {"type": "image"}], toolCallId="1", details={"diff": "+x"}),
    msg("toolResult", [text("2 failed")], toolCallId="2", isError=True),
    msg("toolResult", [text("later")], toolCallId="2", isError=False),
    msg("assistant", [call("3", "edit", path="/r/a.ts", edits=[{"oldText": "a", "newText": "b"}, {"oldText": "", "newText": "c"}]), call("4", "write", path="/r/new.ts"), call("5", "bash", command="git push origin main")], model="", stopReason=""),
    msg("toolResult", [text("main -> main")], toolCallId="5"),
    {"type": "session_info", "name": ""},
    {"type": "session_info", "name": "Final"},
    msg("user", [text("lgtm")]),
    msg("assistant", [text("done")], stopReason="stop"),
]
TWO = [msg("user", None), msg("assistant", [call("1", "finish_and_exit"), call("9", "edit", path="/r/b.ts", oldText="x", newText="y")])]


def write(root, name, events, broken=False):
    lines = [json.dumps(e) for e in events]
    if broken:
        lines[1:1] = ["", "{oops", "  \t", "not json"]
    (root / name).write_text("\n".join(lines) + "\n")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("logs")
    write(root, "one.jsonl", ONE, broken=True)
    write(root, "two.jsonl", TWO)
    (root / "empty.jsonl").write_text("")
    (root / "notes.txt").write_text("{}")
    return root


def test_tables_of_sessions(spark, folder):
    e = T.by_session(ingest.transcripts(spark, str(folder))).cache()
    assert {(r.session, r.repo) for r in T.sessions(e).collect()} == {("one", "app"), ("two", "unknown")}
    got = {(r.session, r.call_id): r for r in T.labelled_calls(e).collect()}
    assert {k: r.intent for k, r in got.items()} == {
        ("one", "1"): "read-file-full", ("one", "2"): "run-test-suite", ("one", "3"): "insert-source", ("one", "4"): "create-file", ("one", "5"): "git-publish", ("two", "1"): "submit", ("two", "9"): "edit-source",
    }
    assert got["one", "1"].result == "source\n[image]\n+x" and got["one", "2"].result == "ERROR:\n2 failed" and not got["two", "9"].answered
    assert got["one", "1"].action == "str_replace_editor view /r/a.ts" and got["one", "3"].action == "str_replace_editor insert /r/a.ts" and got["two", "1"].action == "submit"
    steps = T.steps(T.labelled_calls(e), T.main_model(e)).where("run_id = 'one'").orderBy("step_idx").collect()
    assert [(r.step_idx, r.intent, r.model) for r in steps] == [(k, got["one", str(k + 1)].intent, "claude-opus-4-5") for k in range(5)]
    assert [(r.session, r.text) for r in T.user_turns(e).orderBy("session", "turn").collect()] == [("one", "see https://github.com/o/r/issues/7 please fix it"), ("one", "lgtm"), ("two", "")]
    names = {r.session: (r.first_name, r.last_name) for r in S.session_names(T.name_events(e)).collect()}
    assert names == {"one": ("Draft", "Final")}
    models = {r.session: r.models for r in S.session_models(T.model_names(e)).collect()}
    assert models == {"one": "gpt-5.4,claude-opus-4-5,unknown", "two": "unknown"}
    assert {r.session: r.completed for r in S.completion(T.sessions(e), T.stops(e), T.calls(e)).collect()} == {"one": True, "two": True}
    assert {(r.session, r.key) for r in T.bridge(e).collect()} == {("one", "7")}
    sig = {r.session: r for r in T.signals(e, S.messages(T.user_turns(e), T.calls(e))).collect()}
    assert sig["one"].pushed and sig["one"].source_edit and sig["one"].last_closeout and sig["two"].source_edit and not sig["two"].pushed
    progress = {(r.session, r.message_index): (r.steps_before, r.total_steps) for r in S.messages(T.user_turns(e), T.calls(e)).collect()}
    assert progress == {("one", 1): (0, 5), ("one", 2): (5, 5), ("two", 1): (0, 2)}


def test_lines_in_blocks(spark, tmp_path):
    """Blocks of a few hundred bytes give the numbers that the whole file gives; lines of any length, with both line ends."""
    r = random.Random(4)
    lines = [r.choice(["", " ", "\t", "x" * r.randint(1, 40), "é" * r.randint(1, 900)]) + r.choice(["", "\r"]) for _ in range(600)]
    (tmp_path / "f.jsonl").write_text("\n".join(lines), newline="")
    (tmp_path / "g.jsonl").write_text("\n".join(lines[:50]) + "\n", newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("1501", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = sorted((os.path.basename(x.path), x.line_no, x.line) for x in ingest.transcript_lines(spark, str(tmp_path)).collect())
            blocks = splits.pieces(spark, str(tmp_path), "\n", "f*").select("block").distinct().count()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        want = [(n, k, x.rstrip("\r")) for n, some in (("f.jsonl", lines), ("g.jsonl", lines[:50])) for k, x in enumerate(some) if x.strip()]
        assert got == sorted(want) and (blocks > 20) == (size == "1501")


def test_strict_scan_names_the_line(spark, folder):
    with pytest.raises(Exception, match=r"broken line .*one\.jsonl:3"):
        ingest.transcripts(spark, str(folder), strict=True).collect()
    assert {os.path.basename(r.path): r.bad_lines for r in ingest.bad_line_counts(spark, str(folder)).collect()} == {"one.jsonl": 2, "two.jsonl": 0}
    assert ingest.transcripts(spark, str(folder / "two.jsonl"), strict=True).count() == 2


@pytest.fixture(scope="module")
def read_back(spark):
    return transcript_files.events(spark, SF).cache()


def rows(df, names):
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)


def test_files_and_tables_give_the_same(spark, read_back):
    e = read_back
    pairs = [
        (T.labelled_calls(e), Q.labelled_calls(spark, SF), ["session", "call_id", "intent", "answered"]),
        (S.session_names(T.name_events(e)), S.session_names(Q.name_events(spark, SF)), ["session", "first_name", "last_name"]),
        (S.session_models(T.model_names(e)), S.session_models(Q.model_names(spark, SF)), ["session", "models", "single"]),
        (S.messages(T.user_turns(e), T.calls(e)), S.messages(Q.user_turns(spark, SF), Q.calls(spark, SF)), ["session", "message_index", "class", "progress", "text"]),
        (T.bridge(e), Q.bridge(spark, SF), ["session", "key"]),
    ]
    for got, want, names in pairs:
        assert rows(got, names) == rows(want, names) and rows(got, names)


def test_bundle(spark, read_back, tmp_path):
    path = f"file://{tmp_path}/bundle"
    listed = T.write_bundle(spark, read_back.withColumn("path", F.format_string("/x/%s.jsonl", F.col("session").cast("string"))), path)
    assert len(listed) >= 10
    total = T.read_mart(spark, path, "intent_frequencies").agg(F.sum("n")).first()[0]
    assert total == T.calls(read_back).count() == T.read_mart(spark, path, "category_frequencies").agg(F.sum("n")).first()[0]
    assert T.read_mart(spark, path, "session_completion").count() == read_back.select("session").distinct().count()
    assert T.read_mart(spark, path, "issue_resolution").count() > 0
    with pytest.raises(KeyError):
        T.read_mart(spark, path, "nothing")


def test_ledger(spark, tmp_path):
    """New, changed and deleted files, a crash between mart and ledger, other rules, and a second writer."""
    root = tmp_path / "in"
    root.mkdir()
    seen = []

    def build(paths):
        seen.append(sorted(os.path.basename(p) for p in paths))
        return T.by_session(ingest.transcripts(spark, paths)).select("path", "session", "line_no")

    ledger = Ledger(spark, f"file://{tmp_path}/ledger", f"file://{tmp_path}/mart")
    count = lambda: {r.session: r["count"] for r in ledger.rows().groupBy("session").count().collect()}
    write(root, "a.jsonl", ONE)
    write(root, "b.jsonl", TWO)
    assert ledger.run(str(root), build) == 0 and count() == {"a": 14, "b": 2}
    assert ledger.run(str(root), build) is None and len(seen) == 1
    write(root, "b.jsonl", TWO * 2)
    write(root, "c.jsonl", TWO)

    commit, ledger._commit = ledger._commit, lambda *_: 1 / 0
    with pytest.raises(ZeroDivisionError):
        ledger.run(str(root), build)
    assert count() == {"a": 14, "b": 2}  # rows without a commit don't count
    ledger._commit = commit
    assert ledger.run(str(root), build) == 1 and count() == {"a": 14, "b": 4, "c": 2} and seen[-1] == ["b.jsonl", "c.jsonl"]
    (root / "a.jsonl").unlink()
    assert ledger.run(str(root), build) == 2 and count() == {"b": 4, "c": 2} and len(seen) == 3
    write(root, "a.jsonl", ONE)
    assert ledger.run(str(root), build) == 3 and count() == {"a": 14, "b": 4, "c": 2}
    other = Ledger(spark, ledger.path, ledger.mart, rule_version="2")
    assert other.run(str(root), build) == 4 and seen[-1] == ["a.jsonl", "b.jsonl", "c.jsonl"] and count() == {"a": 14, "b": 4, "c": 2}
    write(root, "d.jsonl", TWO)
    other.next_commit = lambda: 4
    with pytest.raises(RuntimeError):
        other.run(str(root), build)
