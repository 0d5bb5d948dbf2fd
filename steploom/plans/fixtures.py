"""Agent runs, steps and sessions derived from the driver's tables, in Spark and in SQL.

Spark labels the steps by rules from their action and observation. The SQL side takes the labels that were given to
the templates by hand, so that a query's oracle says nothing the rules said first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dims
from ..operators.labels import label, taxonomy, with_acts, with_modes
from .templates import STEPS

MODELS = ["claude45", "gpt5", "gemini25pro", "glm45"]
EXITS = ["submitted", "submitted", "submitted", "submitted (exit_context)", "exit_cost"]
TYPES = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], index):
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of all users, each of whom is a run, with the number in their properties."""
    return table(spark, sf_dir, "events").withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))


def instance_of(run_id: Column) -> Column:
    """Four runs in a row share an instance, one of each model; one run in 17 has an instance to itself, so it has no pair."""
    return F.when(run_id % 17 == 5, -1 - run_id).otherwise(F.floor(run_id / 4))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, instance_id, resolved): an outcome table of its own, from the labels."""
    run = F.col("doc_id")
    return table(spark, sf_dir, "labels").select(
        _pick(MODELS, run % 4).alias("model"), instance_of(run).alias("instance_id"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("resolved")
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per run."""
    spend = events(spark, sf_dir).groupBy(F.col("user_id").alias("run_id")).agg(
        (F.sum("value") / 100).alias("cost"), (1000 * F.sum("k")).alias("tokens_sent"), F.sum("k").alias("tokens_received"), F.count("*").alias("api_calls")
    )
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    places = F.broadcast(places.select("n_nationkey", F.concat("r_name", F.lit("/"), "n_name").alias("repo")))  # 25 rows
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("run_id"), "quality")
    u = spend.withColumn("instance_no", instance_of(F.col("run_id"))).withColumn("model", _pick(MODELS, F.col("run_id") % 4))
    u = u.withColumn("exit_status", _pick(EXITS, (F.col("run_id") * 7) % 5)).withColumn("has_patch", F.col("exit_status").startswith("submitted"))
    u = u.join(labels, "run_id", "left").join(places, F.floor(F.col("run_id") / 4) % 25 == F.col("n_nationkey"))
    resolved = (
        F.when(F.col("run_id") % 10 == 9, F.lit(None).cast("boolean"))
        .when(~F.col("has_patch"), False)
        .when(F.col("quality").isNotNull(), F.col("quality") == 1)
        .otherwise((F.col("run_id") * 5) % 3 == 0)
    )
    patch = F.when(F.col("has_patch"), 100 + (F.col("run_id") * 37) % 900).otherwise(0)
    return u.select(
        "run_id", "instance_no", "model", "repo", "exit_status", "has_patch", patch.alias("patch_chars"), resolved.alias("resolved"), "cost", "tokens_sent", "tokens_received", "api_calls"
    )


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, model, step_idx, tpl, action, observation, execution_time, thought"""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.coalesce(F.array_position(F.array(*map(F.lit, TYPES)), F.col("event_type")) - 1, F.lit(0))
    e = events(spark, sf_dir).withColumn("step_idx", F.row_number().over(order) - 1)
    e = e.withColumn("tpl", ((F.col("k") + 31 * kind + 7 * F.col("user_id")) % len(STEPS)).cast("int"))
    texts = spark.createDataFrame([(k, s[0], s[1]) for k, s in enumerate(STEPS)], "tpl int, action string, observation string")
    e = e.join(F.broadcast(texts), "tpl")  # a row per template
    return e.select(
        F.col("user_id").alias("run_id"), _pick(MODELS, F.col("user_id") % 4).alias("model"), "step_idx", "tpl", "action", "observation",
        F.col("value").alias("execution_time"), F.repeat(F.lit("x"), F.col("k")).alias("thought"),
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label(steps(spark, sf_dir))


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps with their failure mode, and no other label."""
    return with_modes(steps(spark, sf_dir))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps with the class of their action, and no other label."""
    return with_acts(steps(spark, sf_dir))


def _golden() -> list[tuple]:
    """(tpl, intent, outcome, mode, act, path, chars of action and observation)"""
    out = []
    for k, (action, observation, intent, outcome, mode, act) in enumerate(STEPS):
        line = (action or "").split("\n")[0].split()
        out.append((k, intent, outcome, mode, act, line[2].strip("'\"") if len(line) > 2 else "", len(action or ""), len(observation or "")))
    return out


#: Common table expressions: tpl, tax, runs, steps (labelled).
BASE_SQL = f"""with recursive tpl(tpl, intent, outcome, mode, act, path, action_chars, observation_chars) as ({dims.values_sql(_golden())}),
tax(intent, category, letter, phase) as ({dims.values_sql(dims.taxonomy())}),
ev as (select *, cast(regexp_extract(props, '[0-9]+') as int) as k from events),
spend as (
  select user_id as run_id, sum(value) / 100 as cost, cast(1000 * sum(k) as bigint) as tokens_sent, cast(sum(k) as bigint) as tokens_received, count(*) as api_calls
  from ev group by 1),
runs as (
  select s.run_id, case when s.run_id % 17 = 5 then -1 - s.run_id else s.run_id // 4 end as instance_no, (array['claude45', 'gpt5', 'gemini25pro', 'glm45'])[s.run_id % 4 + 1] as model,
         r_name || '/' || n_name as repo, x.exit_status, x.exit_status like 'submitted%' as has_patch,
         case when x.exit_status like 'submitted%' then 100 + (s.run_id * 37) % 900 else 0 end as patch_chars,
         case when s.run_id % 10 = 9 then null when x.exit_status not like 'submitted%' then false
              when quality is not null then quality = 1 else (s.run_id * 5) % 3 = 0 end as resolved,
         cost, tokens_sent, tokens_received, api_calls
  from spend s
  join (select run_id, (array['submitted', 'submitted', 'submitted', 'submitted (exit_context)', 'exit_cost'])[(run_id * 7) % 5 + 1] as exit_status from spend) x on x.run_id = s.run_id
  left join labels on doc_id = s.run_id
  join nation on n_nationkey = (s.run_id // 4) % 25 join region on n_regionkey = r_regionkey),
steps as (
  select s.user_id as run_id, (array['claude45', 'gpt5', 'gemini25pro', 'glm45'])[s.user_id % 4 + 1] as model, s.step_idx, s.value as execution_time, s.k,
         t.*, category, letter, phase
  from (select *, row_number() over (partition by user_id order by ts, event_id) - 1 as step_idx,
               (k + 31 * (case event_type when 'click' then 0 when 'error' then 1 when 'purchase' then 2 when 'signup' then 3 when 'view' then 4 else 0 end) + 7 * user_id) % {len(STEPS)} as tpl_no
        from ev) s
  join tpl t on t.tpl = s.tpl_no join tax using (intent))
"""
