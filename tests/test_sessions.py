"""Session operators on small rows: peers, names, completion, shipping; and that no user's events are left out."""

from steploom.operators import sessions as S
from steploom.plans import fixtures
from steploom.sources import ingest

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_peer_of_two_shared_issues_counts_once(spark):
    sessions = spark.createDataFrame([(1, "a", "issue"), (2, "a", "pr"), (3, "b", "other"), (4, "b", "issue"), (5, None, "pr")], "session int, model string, prefix string")
    bridge = spark.createDataFrame([(1, "7"), (1, "8"), (2, "7"), (2, "8"), (3, "8"), (4, "9"), (5, "7")], "session int, key string")
    # 1: peers 2, 3, 5; 2: peers 1, 3, 5; 3: peers 1, 2; 4: none
    assert rows(S.peer_landscape(sessions, bridge)) == [("a", 0, 2, 2, 3, 2), ("b", 1, 0, 2, 1, 0)]
    assert rows(S.peer_landscape(sessions, bridge.where("false"))) == []


def test_sessions_of_one_issue_are_counted_as_one_group(spark):
    n = 3000
    sessions = spark.range(n).selectExpr("cast(id as int) as session", "'a' as model", "'issue' as prefix")
    got = rows(S.peer_landscape(sessions, sessions.selectExpr("session", "'7' as key")))
    assert got == [("a", 0, n * (n - 1), 0, 0, 0)]


def test_first_and_last_names(spark):
    infos = spark.createDataFrame([(1, 0, ""), (1, 1, "x"), (1, 2, None), (2, 0, "a"), (2, 5, "b"), (3, 0, None)], "session int, line_no int, name string")
    assert rows(S.session_names(infos)) == [(1, "", "x"), (2, "a", "b"), (3, "", "")]


def test_completion_takes_the_last_reason_given(spark):
    sessions = spark.createDataFrame([(k,) for k in range(1, 6)], "session int")
    stops = spark.createDataFrame([(1, 0, "stop"), (1, 1, ""), (2, 0, "stop"), (2, 1, "length"), (3, 0, None), (5, 0, "length")], "session int, turn int, stop_reason string")
    calls = spark.createDataFrame([(5, "finish_and_exit"), (2, "read")], "session int, name string")
    assert rows(S.completion(sessions, stops, calls)) == [(1, True), (2, False), (3, False), (4, False), (5, True)]


def test_a_failed_close_ships_but_resolves_nothing(spark):
    calls = spark.createDataFrame(
        [(1, "edit", None, "/r/a.ts", "ok", False), (1, "bash", "gh issue close 3", None, "no", True), (2, "edit", None, "/r/a.ts", "ok", False), (2, "bash", "GH ISSUE CLOSE 3", None, "ok", False)],
        "session int, name string, command string, path string, result string, is_error boolean",
    )
    user = spark.createDataFrame([(s, k, "hmm") for s in (1, 2) for k in (1, 2)], "session int, message_index int, text string")
    got = S.ship_signals(calls, user).select("session", S.success_label().alias("label"), S.resolution_kind().alias("kind"))
    assert rows(got) == [(1, "success", ""), (2, "failure", "gh_close")]


def test_every_user_is_a_run_and_some_have_no_pair(spark):
    users = fixtures.table(spark, SF, "events").select("user_id").distinct().count()
    runs = fixtures.runs(spark, SF)
    assert runs.count() == users and fixtures.steps(spark, SF).count() == fixtures.table(spark, SF, "events").count()
    assert runs.where("instance_no < 0").count() == runs.where("run_id % 17 = 5").count() > 0


def test_outcomes_of_a_table(spark):
    runs = spark.createDataFrame([("a", "i"), ("a", "j"), ("b", "i")], "model string, instance_id string")
    table = spark.createDataFrame([("a", "i", False), ("a", "i", True), ("b", "j", True)], "model string, instance_id string, resolved boolean")
    assert rows(ingest.with_resolution(runs, table)) == [("a", "i", True), ("a", "j", False), ("b", "i", False)]
