"""Readers of run logs: trajectory files, session transcripts, outcome tables; an ingest ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import once
from . import splits

_CALL = "struct<function:struct<arguments:string>>"
TRAJECTORY = (
    "environment string, trajectory array<struct<action:string,observation:string,response:string,thought:string,execution_time:double>>, "
    f"history array<struct<role:string,content:string,thought:string,tool_calls:array<{_CALL}>>>, "
    "info struct<exit_status:string,submission:string,model_stats:struct<instance_cost:double,tokens_sent:bigint,tokens_received:bigint,api_calls:bigint>>, replay_config string"
)
_EDIT = "struct<oldText:string,newText:string,old_string:string,new_string:string>"
_ARGUMENTS = f"struct<path:string,offset:bigint,limit:bigint,command:string,pattern:string,oldText:string,newText:string,old_string:string,new_string:string,edits:array<{_EDIT}>>"
EVENT = (
    "type string, sessionId string, cwd string, name string, modelId string, message struct<role:string,model:string,stopReason:string,toolCallId:string,isError:boolean,details:struct<diff:string>,"
    f"content:array<struct<type:string,text:string,id:string,name:string,arguments:{_ARGUMENTS}>>>, bad string"
)
CONFIG = "agent struct<model:struct<name:string,temperature:double,per_instance_call_limit:bigint,total_cost_limit:double,completion_kwargs:map<string,string>>>"


def trajectories(spark: SparkSession, root: str, models: list[str] | None = None) -> DataFrame:
    """One row per ``<root>/<model>/traj/<instance>/<instance>.traj``; a list of models prunes the folders that are read."""
    roots = [f"{root}/{m}/traj" for m in models] if models else [root]
    files = spark.read.schema(TRAJECTORY).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.traj").json(roots)
    path = F.col("_metadata.file_path")
    stem = F.regexp_extract(path, r"([^/]+)\.traj$", 1)
    return files.select("*", path.alias("path"), F.regexp_extract(path, r"([^/]+)/traj/", 1).alias("model"), stem.alias("instance_id"), F.coalesce("environment", stem).alias("task"))


def trajectory_steps(files: DataFrame) -> DataFrame:
    """One row per step, in order; files without steps are left out."""
    return files.select("model", "instance_id", "path", F.posexplode("trajectory").alias("step_idx", "s")).select("model", "instance_id", "path", "step_idx", "s.*")


def trajectory_stats(files: DataFrame) -> DataFrame:
    """Cost, tokens, patch and status of each file; files without steps are kept. Both meanings of submitted are given."""
    m = F.col("info.model_stats")
    patch = F.coalesce("info.submission", F.lit(""))
    status = F.coalesce("info.exit_status", F.lit(""))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return files.select(
        "model", "instance_id", F.coalesce(F.size("trajectory"), F.lit(0)).alias("steps"), zero(m["instance_cost"]).alias("cost"), zero(m["tokens_sent"]).alias("tokens_sent"),
        zero(m["tokens_received"]).alias("tokens_received"), zero(m["api_calls"]).alias("api_calls"), status.alias("exit_status"), (patch != "").alias("has_patch"),
        (status.startswith("submitted") | (patch != "")).alias("submitted_any"), F.length(patch).alias("patch_chars"), output_words(F.col("history")).alias("output_words"),
    )


def output_words(history: Column) -> Column:
    """Pre-tokens of what the assistant wrote: contents, thoughts that differ from them, and call arguments."""
    said = F.filter(F.coalesce(history, F.array().cast(f"array<struct<role:string,content:string,thought:string,tool_calls:array<{_CALL}>>>")), lambda h: h["role"] == "assistant")
    text = lambda c: F.coalesce(c, F.lit(""))
    calls = lambda h: F.array_join(F.transform(F.coalesce(h["tool_calls"], F.array().cast(f"array<{_CALL}>")), lambda c: text(c["function"]["arguments"])), " ")
    whole = F.array_join(F.transform(said, lambda h: F.concat_ws(" ", text(h["content"]), F.when(text(h["thought"]) != text(h["content"]), text(h["thought"])).otherwise(F.lit("")), calls(h))), " ")
    return F.size(F.regexp_extract_all(whole, F.lit(r"\w+|[^\w\s]"), F.lit(0)))


def run_config(files: DataFrame) -> DataFrame:
    """Settings held in the configuration string; nulls where it is missing or broken."""
    c = F.from_json("replay_config", CONFIG)["agent"]["model"]
    return files.select("model", "instance_id", c["name"].alias("model_name"), c["temperature"].alias("temperature"), c["per_instance_call_limit"].alias("call_limit"), c["total_cost_limit"].alias("cost_limit"), c["completion_kwargs"].alias("options"))


def transcript_lines(spark: SparkSession, root: str | list[str], pattern: str = "*.jsonl") -> DataFrame:
    """(path, line_no, line): the lines of all files that aren't blank, numbered from 0 with the blank ones counted.

    Files are read in blocks by many tasks, so no file has to fit in a row; the number of a line is the lines of the blocks
    before and those before it in its own.
    """
    pieces = splits.pieces(spark, root, "\n", pattern).drop("file_size")
    numbered = splits.sum_before(pieces, F.lit(1), "line_no")
    return numbered.where(F.col("value").rlike(r"\S")).select("path", F.col("line_no").cast("int").alias("line_no"), F.rtrim("value", F.lit("\r")).alias("line"))


def _parsed(lines: DataFrame) -> DataFrame:
    event = F.from_json("line", EVENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"})
    return lines.select("path", "line_no", "line", once(event).alias("e"))  # else the filter on broken lines parses each line again


def transcripts(spark: SparkSession, root: str | list[str], strict: bool = False, pattern: str = "*.jsonl") -> DataFrame:
    """One row per line of ``*.jsonl`` in file order; blank lines are skipped, broken ones too, or fail if ``strict``, with
    the path and the number (from 1) of the line."""
    events = _parsed(transcript_lines(spark, root, pattern))
    if strict:
        where = F.concat(F.lit("broken line "), F.col("path"), F.lit(":"), (F.col("line_no") + 1).cast("string"))
        events = events.withColumn("line_no", F.when(F.col("e.bad").isNotNull(), F.raise_error(where).cast("int")).otherwise(F.col("line_no")))
    return events.where("e.bad is null" if not strict else "line_no is not null").select("path", "line_no", "e.*").drop("bad")


def bad_line_counts(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    return _parsed(transcript_lines(spark, root, pattern)).groupBy("path").agg(F.count("e.bad").alias("bad_lines"))


def flatten_content(content: Column, diff: Column) -> Column:
    """A tool result as text: its text blocks, [image] for images, and the diff behind them."""
    blocks = F.transform(content, lambda b: F.when(b["type"] == "text", F.coalesce(b["text"], F.lit(""))).when(b["type"] == "image", "[image]").otherwise(F.to_json(b)))
    parts = F.filter(F.concat(blocks, F.array(F.coalesce(diff, F.lit("")))), lambda x: x != "")
    return F.array_join(parts, "\n")


def outcome_table(spark: SparkSession, path: str, names: dict[str, str]) -> DataFrame:
    """(model, instance_id, resolved) of a CSV with dotted headers; unknown models are left out."""
    rows = spark.read.option("header", True).csv(path)
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return rows.select(known[F.col("`metadata.model_name`")].alias("model"), F.col("`metadata.instance_id`").alias("instance_id"), (F.col("`metadata.resolved`") == "true").alias("resolved")).where("model is not null")


def eval_map(spark: SparkSession, path: str, scope: str = "__all__") -> DataFrame:
    """(scope, instance_id, resolved) of a JSON object of booleans."""
    return spark.read.text(path, wholetext=True).select(F.lit(scope).alias("scope"), F.explode(F.from_json("value", "map<string,boolean>")).alias("instance_id", "resolved"))


def with_outcomes(runs: DataFrame, evals: DataFrame) -> DataFrame:
    """``runs(model, instance_id)`` with the outcome of its own scope, else of all; null without one."""
    own = evals.select(F.col("scope").alias("model"), "instance_id", F.col("resolved").alias("_own"))
    everywhere = evals.where("scope = '__all__'").select("instance_id", F.col("resolved").alias("_all"))
    return runs.join(own, ["model", "instance_id"], "left").join(everywhere, "instance_id", "left").withColumn("resolved", F.coalesce("_own", "_all")).drop("_own", "_all")


def with_resolution(runs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``runs(model, instance_id)`` with the outcome of an outcome table, false without one; of several outcomes one won is enough."""
    one = outcomes.groupBy("model", "instance_id").agg(F.bool_or("resolved").alias("_won"))
    return runs.join(one, ["model", "instance_id"], "left").withColumn("resolved", F.coalesce("_won", F.lit(False))).drop("_won")


def unseen(files: DataFrame, ledger: DataFrame | None) -> DataFrame:
    """Files (rows with the hidden file metadata) that are new or changed against a ledger of path, size and time."""
    now = files.select("*", F.struct("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").alias("version"))
    return now if ledger is None else now.join(ledger.select("version"), "version", "left_anti")


def write_mart(df: DataFrame, path: str, form: str = "parquet", partition_by: list[str] | None = None) -> None:
    """A mart as parquet, or as CSV with a header or JSON lines."""
    writer = df.write.mode("overwrite").format(form)
    writer = writer.option("header", True) if form == "csv" else writer
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
