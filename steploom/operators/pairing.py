"""Two models on the same instance: pairs, coverage, and what the pairs show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import order_statistics
from .marts import count_if

FIELDS = ["run_id", "repo", "exit_status", "has_patch", "patch_chars", "resolved", "cost", "tokens_sent", "tokens_received", "api_calls", "steps", "tool_time"]


def pairs(runs: DataFrame, a: str, b: str) -> DataFrame:
    """One row per instance with struct columns a and b, null where a model has no run. One shuffle, no self-join.

    Of several runs of a model on an instance the one with the largest id stands.
    """
    row = F.struct(*FIELDS)
    pick = lambda m: F.max_by(F.when(F.col("model") == m, row), F.when(F.col("model") == m, F.col("run_id")))
    return runs.where(F.col("model").isin(a, b)).groupBy("instance_no").agg(pick(a).alias("a"), pick(b).alias("b"))


def both(joined: DataFrame) -> DataFrame:
    return joined.where("a is not null and b is not null")


def submitted(joined: DataFrame) -> DataFrame:
    """Pairs where both models submitted a patch."""
    return both(joined).where("a.has_patch and b.has_patch")


def coverage(joined: DataFrame) -> DataFrame:
    two = F.col("a").isNotNull() & F.col("b").isNotNull()
    fine = two & F.col("a.has_patch") & F.col("b.has_patch")
    return joined.agg(count_if(fine).alias("paired"), count_if(~two).alias("skipped_unpaired"), count_if(two & ~fine).alias("skipped_unsubmitted"))


def resolved_by(joined: DataFrame) -> Column:
    won = lambda s: F.coalesce(F.col(f"{s}.resolved"), F.lit(False))
    return F.when(won("a") & won("b"), "both").when(won("a"), "a_only").when(won("b"), "b_only").otherwise("neither")


def flat(joined: DataFrame) -> DataFrame:
    return joined.select("instance_no", F.col("a.repo").alias("repo"), *[F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in FIELDS if c not in ("repo", "exit_status")])


def unsubmitted(joined: DataFrame) -> DataFrame:
    """Pairs that a model at least left without a patch, by who submitted."""
    has = lambda s: F.col(f"{s}.has_patch")
    kind = F.when(has("a"), "a_only").when(has("b"), "b_only").otherwise("neither")
    return both(joined).where(~(has("a") & has("b"))).select(
        "instance_no", kind.alias("submitted_by"), F.col("a.exit_status").alias("exit_a"), F.col("b.exit_status").alias("exit_b"),
        F.coalesce("a.resolved", F.lit(False)).alias("resolved_a"), F.coalesce("b.resolved", F.lit(False)).alias("resolved_b"), F.col("a.cost").alias("cost_a"), F.col("b.cost").alias("cost_b"),
    )


METRICS = ["cost", "tokens_sent", "tokens_received", "api_calls", "steps", "tool_time", "patch_chars"]


def long_form(joined: DataFrame) -> DataFrame:
    """(metric, a, b): one row per pair and metric."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"a.{m}").cast("double").alias("x"), F.col(f"b.{m}").cast("double").alias("y")) for m in METRICS])
    return joined.select(F.explode(cells).alias("c")).select("c.metric", "c.x", "c.y")


def report(joined: DataFrame) -> DataFrame:
    """Means of each metric over submitted pairs, and their ratio; no ratio where the second mean is 0.5 or less."""
    means = long_form(submitted(joined)).groupBy("metric").agg(F.avg("x").alias("mean_a"), F.avg("y").alias("mean_b"))
    return means.withColumn("ratio", F.when(F.col("mean_b") > 0.5, F.col("mean_a") / F.col("mean_b")))


def ratios(joined: DataFrame) -> DataFrame:
    """Distribution of a / b over submitted pairs with both above 0: linear quartiles, and who is lower."""
    r = long_form(submitted(joined)).where("x > 0 and y > 0").withColumn("ratio", F.col("x") / F.col("y"))
    sums = r.groupBy("metric").agg(count_if(F.col("ratio") < 1).alias("lower"), count_if(F.col("ratio") > 1).alias("higher"))
    at = lambda q: (lambda n: F.floor((n - 1) * q / 4))
    up = lambda q: (lambda n: F.ceil((n - 1) * q / 4))
    found = order_statistics(r, ["metric"], "ratio", {f"_l{q}": at(q) for q in (1, 2, 3)} | {f"_h{q}": up(q) for q in (1, 2, 3)})
    part = lambda q: (F.col("n") - 1) * q / 4 - F.floor((F.col("n") - 1) * q / 4)
    values = [(F.col(f"_l{q}") + (F.col(f"_h{q}") - F.col(f"_l{q}")) * part(q)).alias(name) for q, name in ((1, "p25"), (2, "median"), (3, "p75"))]
    return found.select("metric", "n", *values).join(sums, "metric")


def head_to_head(joined: DataFrame) -> DataFrame:
    """Pairs that both models resolved: cost differences and spending per character of patch."""
    p = both(joined).where("a.resolved and b.resolved")
    side = lambda s: [
        F.avg(F.when(F.col(f"{s}.patch_chars") > 0, F.col(f"{s}.tokens_received") / F.col(f"{s}.patch_chars")).otherwise(0.0)).alias(f"tokens_per_char_{s}"),
        F.try_divide(F.sum(f"{s}.cost"), F.sum(f"{s}.patch_chars").cast("double")).alias(f"cost_per_char_{s}"),
    ]
    return p.agg(F.count("*").alias("n"), F.avg(F.col("b.cost") - F.col("a.cost")).alias("mean_cost_delta"), count_if(F.col("b.cost") > F.col("a.cost")).alias("b_dearer"), *side("a"), *side("b"))


def by_repo(joined: DataFrame) -> DataFrame:
    """Per repository: submitted pairs, how many each model resolved, and by whom they were."""
    p = submitted(joined)
    who = resolved_by(p)
    won = lambda *kinds: count_if(F.col("who").isin(*kinds))
    return p.select(F.col("a.repo").alias("repo"), who.alias("who")).groupBy("repo").agg(
        F.count("*").alias("n"), won("both", "a_only").alias("resolved_a"), won("both", "b_only").alias("resolved_b"), *[won(k).alias(k) for k in ("both", "a_only", "b_only", "neither")]
    )


#: Sections of the paired report and their metrics.
SECTIONS = {"spending": ["cost", "api_calls"], "tokens": ["tokens_sent", "tokens_received"], "work": ["steps", "tool_time", "patch_chars"]}


def sectioned_report(joined: DataFrame) -> DataFrame:
    """(section, metric, mean_a, median_a, total_a, the same of b, ratio) over submitted pairs; no ratio where b's mean is 0.5 or less."""
    section = F.create_map(*[F.lit(x) for s, names in SECTIONS.items() for m in names for x in (m, s)])
    both_sides = [f(c).alias(f"{name}_{side}") for c, side in (("x", "a"), ("y", "b")) for name, f in (("mean", F.avg), ("median", F.median), ("total", F.sum))]
    out = long_form(submitted(joined)).groupBy("metric").agg(*both_sides)
    return out.select(section[F.col("metric")].alias("section"), *out.columns, F.when(F.col("mean_b") > 0.5, F.col("mean_a") / F.col("mean_b")).alias("ratio"))
