"""Marts over sessions: models, messages, issues, peers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import exclusive_quartiles
from ..functions.sessions import BLAME_WORDS, CLOSE_INSTRUCTION, CLOSEOUT_WORDS, message_class
from .marts import count_if

BINS = 20
#: The macros of user messages; a brief is in none.
MACROS = {"authorize_work": "authorization", "solution_steer": "steering", "evidence_or_repro": "steering", "qa_or_critique": "steering", "validation_request": "steering", "workflow_closeout": "closeout"}
#: The macros where analysis and work have starts of their own.
START_MACROS = {"task_brief": "analysis_start", "authorize_work": "work_start", "solution_steer": "solution_steering", "evidence_or_repro": "solution_steering", "qa_or_critique": "solution_steering", "validation_request": "solution_steering", "workflow_closeout": "workflow_closeout"}
#: Shell calls that ship.
PUSH = r"\bgit (?:-c [^\s]+\s+)?push\b"
COMMIT = r"\bgit (?:-c [^\s]+\s+)?commit\b"


def with_result(calls: DataFrame, results: DataFrame, last: bool = False) -> DataFrame:
    """Each call with its result, the first or the last of several; calls without one get an empty result."""
    pick = F.max_by if last else F.min_by
    one = results.groupBy("session", "call_id").agg(pick(F.struct("result", "is_error"), "line_no").alias("r"))
    return calls.join(one, ["session", "call_id"], "left").select(
        *calls.columns, F.coalesce("r.result", F.lit("")).alias("result"), F.coalesce("r.is_error", F.lit(False)).alias("is_error"), F.col("r").isNotNull().alias("answered")
    )


def messages(user_turns: DataFrame, calls: DataFrame) -> DataFrame:
    """User messages with place, class, and progress: tool calls before the message, in per cent of the session's."""
    events = user_turns.select("session", "turn", F.lit(0).alias("n"), "text", F.lit(True).alias("is_user")).unionByName(
        calls.groupBy("session", "turn").agg(F.count("*").cast("int").alias("n")).select("session", "turn", "n", F.lit(None).cast("string").alias("text"), F.lit(False).alias("is_user"))
    )
    session = Window.partitionBy("session").orderBy("turn", F.desc("is_user"))
    before, whole = session.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("session")
    e = events.withColumn("steps_before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("total_steps", F.sum("n").over(whole))
    e = e.withColumn("message_index", F.sum(F.col("is_user").cast("int")).over(session)).where("is_user")
    pct = F.when(F.col("total_steps") > 0, F.col("steps_before") * 100.0 / F.col("total_steps")).otherwise(0.0)
    e = e.withColumn("progress", pct).withColumn("bin", F.least(F.lit(BINS - 1), F.floor(F.col("progress") / 5)))
    return e.withColumn("class", message_class(F.col("text"), F.col("message_index"))).select("session", "turn", "message_index", "text", "class", "steps_before", "total_steps", "progress", "bin")


def placed(user_turns: DataFrame) -> DataFrame:
    """User messages with their place only, as ``messages`` counts it; no calls are needed for it."""
    return user_turns.withColumn("message_index", F.row_number().over(Window.partitionBy("session").orderBy("turn")))


def macro_stats(rows: DataFrame, macros: dict[str, str]) -> DataFrame:
    """``message_stats`` by macros, groups of classes; messages of a class in no group are left out of all counts."""
    macro = F.create_map(*[F.lit(x) for pair in macros.items() for x in pair])
    return message_stats(rows.withColumn("macro", macro[F.col("class")]).where("macro is not null"), "macro")


def first_occurrence(rows: DataFrame, key: str) -> DataFrame:
    """(session, model, key, progress, message_index): the first message of each key in a session."""
    return rows.groupBy("session", "model", key).agg(F.min("message_index").alias("message_index"), F.min_by("progress", "message_index").alias("progress"))


def message_stats(rows: DataFrame, key: str = "class") -> DataFrame:
    """Per model and over all models (null): messages, sessions and their shares, quartiles of the first occurrence."""
    sessions = rows.groupingSets([["model"], []], "model").agg(F.count_distinct("session").alias("all_sessions"), F.count("*").alias("all_messages"))
    counts = rows.groupingSets([["model", key], [key]], "model", key).agg(F.count("*").alias("n_messages"), F.count_distinct("session").alias("n_sessions"))
    first = first_occurrence(rows, key).withColumn("scope", F.explode(F.array(F.col("model"), F.lit(None))))
    spread = exclusive_quartiles(first.select(F.coalesce("scope", F.lit("*")).alias("m"), key, "progress"), ["m", key], "progress").withColumnRenamed("n", "n_first")
    out = counts.alias("c").join(sessions.alias("s"), F.col("c.model").eqNullSafe(F.col("s.model")))
    out = out.select("c.model", key, "n_messages", "n_sessions", (F.col("n_messages") / F.col("all_messages")).alias("message_share"), (F.col("n_sessions") / F.col("all_sessions")).alias("session_share"))
    return out.withColumn("m", F.coalesce("model", F.lit("*"))).join(spread, ["m", key]).drop("m", "n_first")


def message_timing(rows: DataFrame) -> DataFrame:
    """(class, bin): share of sessions with a message of the class in the bin."""
    total = rows.agg(F.count_distinct("session").alias("total"))
    return rows.groupBy("class", "bin").agg(F.count_distinct("session").alias("n_sessions")).crossJoin(F.broadcast(total)).select("class", "bin", "n_sessions", (F.col("n_sessions") / F.col("total")).alias("share"))


def session_models(names: DataFrame) -> DataFrame:
    """names(session, line_no, model): distinct models in order of appearance, and whether there is one only."""
    first = names.groupBy("session", "model").agg(F.min("line_no").alias("at"))
    return first.groupBy("session").agg(F.sort_array(F.collect_list(F.struct("at", "model"))).alias("m")).select(
        "session", F.array_join(F.transform("m", lambda x: x["model"]), ",").alias("models"), (F.size("m") == 1).alias("single"), F.when(F.size("m") == 1, F.get("m", F.lit(0))["model"]).alias("model")
    )


def session_names(infos: DataFrame) -> DataFrame:
    """infos(session, line_no, name): the first name as it is, and the last one that isn't empty; '' without one."""
    said = F.coalesce("name", F.lit("")) != ""
    last = F.max_by(F.when(said, F.col("name")), F.when(said, F.col("line_no")))
    return infos.groupBy("session").agg(F.min_by(F.coalesce("name", F.lit("")), "line_no").alias("first_name"), F.coalesce(last, F.lit("")).alias("last_name"))


def completion(sessions: DataFrame, stops: DataFrame, calls: DataFrame) -> DataFrame:
    """(session, completed): the last stop reason that isn't empty is ``stop``, or a call finished the session.

    stops(session, turn, stop_reason) has a row per assistant message.
    """
    last = stops.where("stop_reason <> ''").groupBy("session").agg((F.max_by("stop_reason", "turn") == "stop").alias("_stopped"))
    done = calls.groupBy("session").agg(F.bool_or(F.col("name") == "finish_and_exit").alias("_finished"))
    no = F.lit(False)
    ended = F.coalesce("_stopped", no) | F.coalesce("_finished", no)
    return sessions.select("session").join(last, "session", "left").join(done, "session", "left").select("session", ended.alias("completed"))


def selected(sessions: DataFrame, models: list[str] | None, prefixes: list[str], single_only: bool = True) -> Column:
    """The session filter. Without ``single_only`` a list of models matches nothing, as such sessions have no one model."""
    named = F.lit(False)
    for p in prefixes:
        named = named | F.lower(F.coalesce("name", F.lit(""))).startswith(p.lower())
    out = named if prefixes else F.lit(True)
    if single_only:
        out = out & F.col("single")
    if models:
        out = out & (F.coalesce(F.col("model").isin(*models), F.lit(False)) if single_only else F.lit(False))
    return out


def ship_signals(calls: DataFrame, user: DataFrame) -> DataFrame:
    """Per session: what its shell calls shipped (last results count) and whether its user closed the matter."""
    cmd, low, seen = F.col("command"), F.lower("command"), F.lower("result")
    shell = (F.col("name") == "bash") & cmd.isNotNull()
    fine = ~F.col("is_error")
    any_of = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    yes = lambda c: any_of(shell & c)
    source = F.col("name").isin("edit", "write") & ~F.lower(F.coalesce("path", F.lit(""))).rlike(r"test|repro|\.md|changelog") & (F.coalesce("path", F.lit("")) != "")
    acts = calls.where(shell | source).groupBy("session").agg(  # one pass over the calls, as each has been joined with its result
        yes(cmd.rlike(PUSH) & fine & ~seen.contains("rejected") & ~seen.contains("error:")).alias("pushed"),
        yes(low.contains("gh issue close") & fine).alias("closed"),
        yes(low.contains("gh pr merge") & fine).alias("merged"),
        yes(cmd.contains("gh issue close")).alias("close_called"),
        yes(cmd.contains("gh pr merge")).alias("merge_called"),
        yes((low.contains("gh issue comment") | low.contains("gh pr comment")) & fine).alias("commented"),
        yes(cmd.rlike(COMMIT)).alias("committed"),
        yes(cmd.rlike(COMMIT) & fine).alias("commit_ok"),
        any_of(source).alias("source_edit"),
    )
    last = F.max_by("text", "message_index")
    said = user.groupBy("session").agg(
        F.count("*").alias("n_user"),
        F.bool_or(F.col("text").rlike(CLOSE_INSTRUCTION)).alias("any_close"),
        ((F.count("*") >= 2) & last.rlike(CLOSE_INSTRUCTION)).alias("last_close"),
        ((F.count("*") >= 2) & last.rlike(CLOSEOUT_WORDS)).alias("last_closeout"),
        ((F.count("*") >= 2) & last.rlike(BLAME_WORDS)).alias("last_blame"),
    )
    out = said.join(acts, "session", "full")
    flags = [c for c in out.columns if c not in ("session", "n_user")]
    return out.select("session", F.coalesce("n_user", F.lit(0)).alias("n_user"), *[F.coalesce(c, F.lit(False)).alias(c) for c in flags])


def resolution_kind() -> Column:
    """push, gh_merge, gh_close, gh_comment, user_close or '', over ship_signals."""
    return (
        F.when(F.col("pushed"), "push")
        .when(F.col("merged"), "gh_merge")
        .when(F.col("closed"), "gh_close")
        .when(F.col("commented") & F.col("any_close"), "gh_comment")
        .when(F.col("last_close"), "user_close")
        .otherwise("")
    )


def shipped() -> Column:
    """A push that went through, or a call that closes an issue or merges, whatever its result says; over ship_signals."""
    return F.col("pushed") | F.col("close_called") | F.col("merge_called")


def success_label() -> Column:
    """success, failure or ambiguous, over ship_signals."""
    return (
        F.when(F.col("n_user") <= 1, "failure")
        .when(~F.col("source_edit") & ~F.col("committed"), "failure")
        .when(shipped() & F.col("last_blame"), "ambiguous")
        .when(shipped(), "success")
        .when(F.col("commit_ok") & F.col("last_closeout"), "ambiguous")
        .otherwise("failure")
    )


def issue_resolution(sessions: DataFrame, bridge: DataFrame) -> DataFrame:
    """Per model: issues that chosen sessions attempt, and those that any session of the model resolved.

    sessions(session, model, chosen, kind); bridge(session, key). Sessions count in the kinds even without an issue.
    """
    keyed = bridge.join(sessions, "session")
    attempted = keyed.where("chosen").select("model", "key").distinct()
    won = keyed.where("kind <> '' and model is not null").select("model", "key").distinct().withColumn("won", F.lit(True))
    issues = attempted.join(won, ["model", "key"], "left").groupBy("model").agg(F.count("*").alias("n_attempted"), F.count("won").alias("n_resolved"))
    kinds = sessions.where("chosen").groupBy("model").agg(
        F.count("*").alias("n_sessions"), *[count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("push", "gh_merge", "gh_close", "gh_comment", "user_close")]
    )
    return kinds.join(issues, "model", "left").na.fill(0, ["n_attempted", "n_resolved"])


def with_issue_totals(per_model: DataFrame) -> DataFrame:
    """``issue_resolution`` with the rate of each model, and a row of all (null): sums, where an issue counts once a model."""
    sums = [c for c in per_model.columns if c != "model"]
    out = per_model.groupingSets([["model"], []], "model").agg(*[F.sum(c).alias(c) for c in sums])
    return out.withColumn("rate", F.coalesce(F.try_divide(F.col("n_resolved") * 100.0, F.col("n_attempted")), F.lit(0.0)))


def resolved_issues(sessions: DataFrame, bridge: DataFrame) -> DataFrame:
    """(model, key): issues that some single-model session of a model shipped; sessions(session, model, shipped)."""
    return bridge.join(sessions.where("shipped and model is not null"), "session").select("model", "key").distinct()


def peer_rescue(sessions: DataFrame, bridge: DataFrame) -> DataFrame:
    """(session, model, shipped, rescued): another session of the model shipped on one of the session's issues.

    A session that did not ship itself can only be rescued by others, so no pairs of sessions are made.
    """
    won = resolved_issues(sessions, bridge)
    saved = bridge.join(sessions.where("not shipped"), "session").join(won, ["model", "key"], "left_semi").select("session").distinct().withColumn("rescued", F.lit(True))
    return sessions.join(saved, "session", "left").select("session", "model", "shipped", F.coalesce("rescued", F.lit(False)).alias("rescued"))


def peer_landscape(sessions: DataFrame, bridge: DataFrame) -> DataFrame:
    """Per model, over its single-model sessions with an issue: sessions without a peer, and distinct peers by kind.

    sessions(session, model, prefix), model null for sessions of several; bridge(session, key). Peers share an issue.
    Sessions with equal sets of issues are counted as one, so sets are paired and never sessions; a session that
    shares several issues with another is still one peer of it.
    """
    sets = bridge.groupBy("session").agg(F.sort_array(F.collect_set("key")).alias("keys")).join(sessions, "session")
    groups = sets.groupBy("keys", "model", "prefix").agg(F.count("*").alias("k"))
    linked = groups.select("keys").distinct().select("keys", F.explode("keys").alias("key"))
    near = linked.join(linked.select(F.col("keys").alias("other"), "key"), "key").select("keys", "other").distinct()
    peers = groups.select(F.col("keys").alias("other"), F.col("model").alias("peer_model"), F.col("prefix").alias("peer_prefix"), F.col("k").alias("n"))
    around = near.join(peers, "other").groupBy("keys", "peer_model", "peer_prefix").agg(F.sum("n").alias("n"))
    of = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    itself = lambda p: (F.col("prefix") == p).cast("int")
    one = groups.where("model is not null").join(around, "keys").groupBy("keys", "model", "prefix", "k").agg(
        (F.sum("n") - 1).alias("peers"), (of(F.col("peer_model") == F.col("model")) - 1).alias("same"), of(F.col("peer_model") != F.col("model")).alias("diff"),
        (of(F.col("peer_prefix") == "pr") - itself("pr")).alias("pr"), (of(F.col("peer_prefix") == "other") - itself("other")).alias("other"),
    )
    total = lambda c: F.sum(F.col(c) * F.col("k"))
    return one.groupBy("model").agg(
        F.sum(F.when(F.col("peers") == 0, F.col("k")).otherwise(0)).alias("no_peer"), total("same").alias("same_model"), total("diff").alias("other_model"), total("pr").alias("pr_peers"), total("other").alias("other_peers")
    )


def beside_baseline(own: DataFrame, base: DataFrame, baselines: dict[str, str], on: list[str] | None = None) -> DataFrame:
    """Marts of session models beside the same marts of the models they are compared with, as ``base_…``.

    Models of ``own`` without a baseline are left out; where the baseline has no row, its columns are null. ``on`` names the
    keys that both have besides the model.
    """
    on = on or []
    names = own.sparkSession.createDataFrame(list(baselines.items()), "model string, baseline string")
    other = base.select(F.col("model").alias("baseline"), *on, *[F.col(c).alias(f"base_{c}") for c in base.columns if c not in ("model", *on)])
    return own.join(F.broadcast(names), "model").join(other, ["baseline", *on], "left")
