"""Tables of sessions derived from the events of their transcripts, and the marts over them.

An event is a line; a content block has the key (line_no, block), by which calls are ordered. The functions take
``ingest.transcripts`` and give the tables that ``operators.sessions`` and ``operators.marts`` work on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.outcomes import verify_outcome
from ..functions.sessions import issue_keys, normalize_model, with_tool_intent
from ..sources.ingest import flatten_content
from . import marts
from . import sessions as S
from .labels import taxonomy
from .sequences import positions, sequence_labels


def by_session(events: DataFrame) -> DataFrame:
    """Events with ``session``: the name of the file without its ending."""
    return events.withColumn("session", F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", ""))


def _said(events: DataFrame, role: str) -> DataFrame:
    return events.where((F.col("type") == "message") & (F.col("message.role") == role))


def _blocks(events: DataFrame, role: str) -> DataFrame:
    return _said(events, role).select("session", "line_no", F.posexplode("message.content").alias("block", "b"))


def sessions(events: DataFrame) -> DataFrame:
    """(session, repo): the last part of the working directory of its first session event, else unknown."""
    start = F.col("type") == "session"
    cwd = F.min_by("cwd", F.when(start, F.col("line_no")))
    return events.groupBy("session").agg(repo_name(cwd).alias("repo"))


def repo_name(cwd: Column) -> Column:
    """The last part of a path that isn't empty; unknown without one."""
    last = F.substring_index(F.regexp_replace(F.coalesce(cwd, F.lit("")), "(/+\\.?)+$", ""), "/", -1)
    return F.coalesce(F.nullif(F.nullif(last, F.lit("")), F.lit(".")), F.lit("unknown"))


def calls(events: DataFrame) -> DataFrame:
    """Tool calls of assistant messages: turn is the line, j the block. Of the texts that an edit replaces, an empty one
    (it inserts) comes before others; a range is an offset or a limit that isn't null."""
    b = _blocks(events, "assistant").where("b.type = 'toolCall'")
    a = F.col("b.arguments")
    empty = F.lit("")
    edits = F.transform(a["edits"], lambda e: F.coalesce(F.nullif(e["oldText"], empty), e["old_string"], empty))
    single = F.coalesce(a["oldText"], a["old_string"], F.when(F.coalesce(a["newText"], a["new_string"]).isNotNull(), ""))
    old = F.when(F.size(a["edits"]) > 0, F.array_min(edits)).otherwise(single)
    return b.select(
        "session", F.col("line_no").alias("turn"), F.col("block").alias("j"), F.col("b.id").alias("call_id"), F.coalesce("b.name", empty).alias("name"), a["path"].alias("path"),
        a["command"].alias("command"), a["pattern"].alias("pattern"), (a["offset"].isNotNull() | a["limit"].isNotNull()).alias("has_range"), old.alias("old_text"),
    )


def results(events: DataFrame, text_only: bool = False) -> DataFrame:
    """Tool results that name their call. With ``text_only`` a result is its text blocks, else also images, other blocks and the diff."""
    m = F.col("message")
    texts = F.array_join(F.transform(F.filter(m["content"], lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), "\n")
    result = texts if text_only else flatten_content(F.coalesce(m["content"], F.array()), m["details"]["diff"])
    return _said(events, "toolResult").where("message.toolCallId <> ''").select(
        "session", m["toolCallId"].alias("call_id"), "line_no", F.coalesce(result, F.lit("")).alias("result"), F.coalesce(m["isError"], F.lit(False)).alias("is_error")
    )


def user_turns(events: DataFrame) -> DataFrame:
    """(session, turn, text): the text blocks of each user message, joined by spaces."""
    texts = F.transform(F.filter("message.content", lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit("")))
    return _said(events, "user").select("session", F.col("line_no").alias("turn"), F.coalesce(F.array_join(texts, " "), F.lit("")).alias("text"))


def name_events(events: DataFrame) -> DataFrame:
    return events.where("type = 'session_info'").select("session", "line_no", "name")


def model_names(events: DataFrame) -> DataFrame:
    """(session, line_no, model): of model changes and of assistant messages, normalised; one without a name is unknown."""
    raw = F.when(F.col("type") == "model_change", F.col("modelId")).otherwise(F.col("message.model"))
    named = (F.col("type") == "model_change") | ((F.col("type") == "message") & (F.col("message.role") == "assistant"))
    return events.where(named).select("session", "line_no", normalize_model(raw).alias("model"))


def main_model(events: DataFrame) -> DataFrame:
    """(session, model): of the first assistant message that names one, else of the first model change, else unknown."""
    spoken = F.when((F.col("type") == "message") & (F.col("message.role") == "assistant") & (F.col("message.model") != ""), F.col("message.model"))
    changed = F.when((F.col("type") == "model_change") & (F.col("modelId") != ""), F.col("modelId"))
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("line_no")))
    return events.groupBy("session").agg(normalize_model(F.coalesce(first(spoken), first(changed))).alias("model"))


def stops(events: DataFrame) -> DataFrame:
    return _said(events, "assistant").select("session", F.col("line_no").alias("turn"), F.col("message.stopReason").alias("stop_reason"))


def labelled_calls(events: DataFrame) -> DataFrame:
    """Calls with their first result, marked as an error where it is one, their intent, and the action it stands for."""
    c = S.with_result(calls(events), results(events))
    marked = F.when(F.col("is_error") & (F.col("result") != ""), F.concat(F.lit("ERROR:\n"), "result")).otherwise(F.col("result"))
    c = with_tool_intent(c.withColumn("result", marked), action="_shell_action")
    path, name = F.coalesce("path", F.lit("")), F.col("name")
    verb = F.when(name == "read", "view").when(name == "write", "create").when(name == "edit", F.when(F.coalesce(F.col("old_text") == "", F.lit(False)), "insert").otherwise("str_replace"))
    action = F.when(verb.isNotNull(), F.concat(F.lit("str_replace_editor "), verb, F.lit(" "), path)).when(F.col("_shell_action") != "", F.col("_shell_action")).otherwise(name)
    return c.withColumn("action", action).drop("_shell_action")


def steps(labelled: DataFrame, models: DataFrame) -> DataFrame:
    """Labelled calls as the steps of a run: its session, in order, with category, letter, phase and outcome."""
    tax = taxonomy(labelled.sparkSession, session=True)
    order = Window.partitionBy("session").orderBy("turn", "j")
    s = labelled.withColumn("step_idx", F.row_number().over(order) - 1).withColumn("outcome", verify_outcome(F.col("action"), F.col("result"), F.col("intent")))
    s = s.join(models, "session").join(F.broadcast(tax), "intent", "left")  # a row per intent
    return s.select(F.col("session").alias("run_id"), "model", "step_idx", "action", F.col("result").alias("observation"), "intent", "category", "letter", "phase", "outcome")


def runs(events: DataFrame) -> DataFrame:
    """(run_id, model) of the sessions with calls, which are not labelled for it."""
    called = calls(events).select("session").distinct()
    return called.join(main_model(events), "session").select(F.col("session").alias("run_id"), "model")


def signals(events: DataFrame, messages: DataFrame) -> DataFrame:
    """What sessions shipped: their last results count, by their text."""
    return S.ship_signals(S.with_result(calls(events), results(events, text_only=True), last=True), messages)


def bridge(events: DataFrame) -> DataFrame:
    """(session, key): issues in a session's last name or its first user message."""
    first = user_turns(events).groupBy("session").agg(F.min_by("text", "turn").alias("first_text"))
    names = S.session_names(name_events(events)).select("session", F.col("last_name").alias("name"))
    both = sessions(events).select("session").join(names, "session", "left").join(first, "session", "left")
    return both.select("session", F.explode(issue_keys(F.col("name"), F.col("first_text"))).alias("key"))


#: The tables that the marts share; each is written once.
SHARED = ("events", "models", "steps", "messages", "signals", "bridge")


def shared_tables(events: DataFrame, keep) -> dict[str, DataFrame]:
    """The tables of SHARED, each handed to ``keep(name, table)`` before the next is built on what it returns. Calls are
    labelled once, for ``steps``."""
    out = {"events": keep("events", by_session(events))}
    e = out["events"]
    out["models"] = keep("models", S.session_models(model_names(e)))
    out["steps"] = keep("steps", sequence_labels(steps(labelled_calls(e), main_model(e))))
    out["messages"] = keep("messages", S.messages(user_turns(e), calls(e)))
    out["signals"] = keep("signals", signals(e, out["messages"]))
    out["bridge"] = keep("bridge", bridge(e))
    return out


def session_marts(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The marts of a folder of transcripts, from its shared tables. Message and issue marts are over sessions of one model."""
    e, s = t["events"], t["steps"]
    own = t["models"].where("single").select("session", "model")
    said = t["messages"].join(own, "session")
    ship = t["signals"].select("session", S.resolution_kind().alias("kind"))
    known = sessions(e).select("session").join(own, "session", "left").join(ship, "session", "left").select("session", "model", F.coalesce("kind", F.lit("")).alias("kind"))
    return {
        "session_models": t["models"],
        "session_names": S.session_names(name_events(e)),
        "session_repos": sessions(e),
        "session_completion": S.completion(sessions(e), stops(e), calls(e)),
        "intent_frequencies": marts.intent_frequencies(s),
        "category_frequencies": marts.category_frequencies(s, s.select("run_id", "model").distinct()),
        "verify_outcomes": marts.verify_outcomes(s),
        "sequence_label_counts": marts.sequence_label_counts(s),
        "positions": positions(s),
        "message_stats": S.message_stats(said),
        "message_timing": S.message_timing(said),
        "issue_resolution": S.issue_resolution(known.withColumn("chosen", F.col("model").isNotNull()), t["bridge"]).where("model is not null"),
        "session_success": t["signals"].select("session", S.success_label().alias("label")),
    }


def write_bundle(spark: SparkSession, events: DataFrame, path: str) -> list[str]:
    """The shared tables and all marts under ``path``, each written once, and last a manifest of the marts with their rows.

    A bundle without its manifest is not whole. The calls are labelled in one job; every mart reads what that wrote.
    """

    def keep(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{path}/shared/{name}")
        return spark.read.parquet(f"{path}/shared/{name}")

    rows = []
    for name, mart in session_marts(shared_tables(events, keep)).items():
        mart.write.mode("overwrite").parquet(f"{path}/marts/{name}")
        rows.append((name, spark.read.parquet(f"{path}/marts/{name}").count()))
    spark.createDataFrame(rows, "mart string, n_rows bigint").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return [name for name, _ in rows]


def read_mart(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A mart of a whole bundle; an error where the manifest is missing or doesn't list it."""
    listed = {r["mart"] for r in spark.read.json(f"{path}/manifest").collect()}  # a row a mart
    if name not in listed:
        raise KeyError(f"{path} has no mart {name}")
    return spark.read.parquet(f"{path}/marts/{name}")
