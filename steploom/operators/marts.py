"""Aggregates over labelled steps and over runs. Shares and means are left unrounded."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.quantiles import middle, nearest_quartiles, quartiles_and_medians
from .sequences import BINS, MARKERS, progress_bin


def share(n: str | Column, *keys: str) -> Column:
    """Of the total of its keys."""
    n = F.col(n) if isinstance(n, str) else n
    return n.cast("double") / F.sum(n).over(Window.partitionBy(*keys))


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def intent_frequencies(steps: DataFrame) -> DataFrame:
    counts = steps.groupBy("model", "intent").agg(F.count("*").alias("n"))
    return counts.withColumn("share", share("n", "model"))


def category_frequencies(steps: DataFrame, runs: DataFrame) -> DataFrame:
    counts = steps.groupBy("model", "category").agg(F.count("*").alias("n"))
    per_model = runs.groupBy("model").agg(F.count("*").alias("n_runs"))
    return counts.withColumn("share", share("n", "model")).join(F.broadcast(per_model), "model").select(
        "model", "category", "n", "share", (F.col("n") / F.col("n_runs")).alias("per_run")
    )


def phase_frequencies(steps: DataFrame) -> DataFrame:
    """Per cent of all steps of a model; steps without a phase count in the total only."""
    counts = steps.groupBy("model", "phase").agg(F.count("*").alias("n"))
    return counts.withColumn("pct", share("n", "model") * 100).where(F.col("phase").isNotNull())


def intent_comparison(steps: DataFrame, models: list[str], threshold: float = 1.5) -> DataFrame:
    """Per 100 steps of each model, side by side, where the largest is above the threshold."""
    per = intent_frequencies(steps).withColumn("per100", F.col("share") * 100)
    wide = per.groupBy("intent").pivot("model", models).agg(F.first("per100")).na.fill(0.0)
    return wide.withColumn("largest", F.greatest(*models)).where(F.col("largest") > threshold)


def verify_outcomes(steps: DataFrame) -> DataFrame:
    """unknown counts every step without an outcome, so total is all steps."""
    passed, failed = count_if(F.col("outcome") == "pass"), count_if(F.col("outcome") == "fail")
    return steps.groupBy("model").agg(
        passed.alias("n_pass"), failed.alias("n_fail"), count_if(F.col("outcome") == "").alias("n_unknown"), F.count("*").alias("total"), F.try_divide(passed * 100.0, passed + failed).alias("pass_pct")
    )


def sequence_label_counts(sequenced: DataFrame) -> DataFrame:
    return sequenced.where("seq <> 'seq-none'").groupBy("model", "seq").agg(F.count("*").alias("n"))


def edit_verify_cycles(sequenced: DataFrame) -> DataFrame:
    """Verifications after an edit per run; runs without any count as 0."""
    per_run = sequenced.groupBy("model", "run_id").agg(count_if(F.col("seq") == "seq-verify-after-edit").alias("cycles"))
    mean = per_run.groupBy("model").agg(F.avg("cycles").alias("mean"), F.sum("cycles").alias("total"))
    return middle(per_run, ["model"], "cycles").drop("n").join(mean, "model")


def labels_per_run(sequenced: DataFrame, labels: list[str]) -> DataFrame:
    """(model, seq, n, per_run): how often each label occurs, and on average over all runs of the model, zeros kept."""
    runs = sequenced.groupBy("model", "run_id").agg(*[count_if(F.col("seq") == x).alias(x) for x in labels])
    cells = F.array(*[F.struct(F.lit(x).alias("seq"), F.col(x).alias("n")) for x in labels])
    long = runs.select("model", F.explode(cells).alias("c"))
    return long.groupBy("model", F.col("c.seq").alias("seq")).agg(F.sum("c.n").alias("n"), F.avg("c.n").alias("per_run"))


def structural_markers(positions: DataFrame, runs: DataFrame) -> DataFrame:
    """Quartiles of each marker per model, and its medians by outcome; a missing outcome counts as unresolved."""
    long = positions.join(runs.select("run_id", F.coalesce("resolved", F.lit(False)).alias("won")), "run_id").select(
        "model", "won", F.explode(F.create_map(*[x for m in MARKERS for x in (F.lit(m), F.col(m))])).alias("marker", "at")
    )
    return quartiles_and_medians(long, ["marker", "model"], "at", {"resolved_median": F.col("won"), "unresolved_median": ~F.col("won")})


def per_repo(steps: DataFrame, runs: DataFrame, top: int = 12, least: int = 3) -> DataFrame:
    """The ``top`` repositories by runs, by model; rates only with ``least`` runs or more."""
    own = steps.groupBy("run_id").agg(F.count("*").alias("steps"), count_if(F.col("category") == "verify").alias("v"), count_if(F.col("category") == "edit").alias("e"))
    j = runs.join(own, "run_id")
    sizes = j.groupBy("repo").agg(F.count("*").alias("n_repo"))
    best = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n_repo"), "repo"))).where(F.col("place") <= top)
    out = j.join(F.broadcast(best.select("repo")), "repo").groupBy("repo", "model").agg(
        F.count("*").alias("n"), F.avg("steps").alias("avg_steps"), count_if(F.col("resolved")).alias("n_resolved"), F.sum("steps").alias("_s"), F.sum("v").alias("_v"), F.sum("e").alias("_e")
    )
    return out.select(
        "repo", "model", "n", "avg_steps", F.when(F.col("n") >= least, F.col("n_resolved") / F.col("n")).alias("resolve_rate"),
        (F.col("_v") / F.col("_s")).alias("verify_share"), (F.col("_e") / F.col("_s")).alias("edit_share"), F.try_divide(F.col("_v"), F.col("_e")).alias("verify_per_edit"),
    )


def step_histogram(per_run: DataFrame, width: int = 5) -> DataFrame:
    return per_run.groupBy("model", (F.floor(F.col("steps") / width) * width).alias("from_steps")).agg(F.count("*").alias("n"))


def phase_profile(steps: DataFrame, least: int = 5) -> DataFrame:
    """Mean share of each letter in each of 20 progress bins over the runs of a model with ``least`` steps or more.

    Empty bins of a run count as 0, and the grid of bins and letters is dense.
    """
    n = F.count("*").over(Window.partitionBy("run_id"))
    long = steps.withColumn("n", n).where(F.col("n") >= least).withColumn("bin", progress_bin(F.col("step_idx"), F.col("n")))
    counts = long.groupBy("model", "run_id", "bin", "letter").agg(F.count("*").alias("k"))
    shares = counts.withColumn("s", share("k", "run_id", "bin")).groupBy("model", "bin", "letter").agg(F.sum("s").alias("s"))
    runs = long.groupBy("model").agg(F.count_distinct("run_id").alias("n_runs"))
    grid = runs.select("model", "n_runs", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(BINS - 1).cast("bigint"))).alias("bin")).select(
        "model", "n_runs", "bin", F.explode(F.array(*map(F.lit, dims.LETTERS.values()))).alias("letter")
    )
    return grid.join(shares, ["model", "bin", "letter"], "left").select("model", "bin", "letter", (F.coalesce("s", F.lit(0.0)) / F.col("n_runs")).alias("mean_share"))


def phase_heatmap(profile: DataFrame) -> DataFrame:
    """The profile of the seven working letters, each column made to sum to 1."""
    part = profile.where("letter not in ('X', 'O')")
    total = F.sum("mean_share").over(Window.partitionBy("model", "bin"))
    return part.select("model", "bin", "letter", F.try_divide(F.col("mean_share"), total).alias("share"))


def phase_bands(profile: DataFrame, bands: dict[str, list[str]], without: tuple[str, ...] = ()) -> DataFrame:
    """(model, bin, band, share): letters of the profile summed into bands; the bands that are left make up 1 in each column.

    The share is null in a column where all of them are 0.
    """
    of = F.create_map(*[F.lit(x) for band, letters in bands.items() if band not in without for x in [y for k in letters for y in (k, band)]])
    part = profile.withColumn("band", of[F.col("letter")]).where("band is not null").groupBy("model", "bin", "band").agg(F.sum("mean_share").alias("s"))
    return part.select("model", "bin", "band", F.try_divide(F.col("s"), F.sum("s").over(Window.partitionBy("model", "bin"))).alias("share"))


def bigram_matrix(pairs: DataFrame) -> DataFrame:
    """All 9 x 9 cells per model, as shares of all bigrams of the model."""
    letters = F.array(*map(F.lit, dims.LETTERS.values()))
    total = pairs.groupBy("model").agg(F.sum("n").alias("total"))
    grid = total.select("model", "total", F.explode(letters).alias("a")).select("model", "total", "a", F.explode(letters).alias("b"))
    return grid.join(pairs, ["model", "a", "b"], "left").select("model", "a", "b", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / F.col("total")).alias("share"))


def run_metadata(per_run: DataFrame, runs: DataFrame) -> DataFrame:
    j = per_run.select("run_id", "steps").join(runs, "run_id")
    sums = j.groupBy("model").agg(
        F.sum("steps").alias("total_steps"), F.avg("steps").alias("avg_steps"), F.min("steps").alias("min_steps"), F.max("steps").alias("max_steps"),
        count_if(F.col("resolved")).alias("n_resolved"), (count_if(F.col("resolved")) / F.count("*")).alias("resolve_rate"),
    )
    return nearest_quartiles(j, ["model"], "steps").join(sums, "model")


def work_done(sequenced: DataFrame, runs: DataFrame) -> DataFrame:
    """(model, work_done, resolved, n): whether tests passed after the last source edit, against the outcome."""
    done = sequenced.groupBy("run_id").agg(F.bool_or(F.col("seq") == "seq-work-done").alias("work_done"))
    return runs.join(done, "run_id").groupBy("model", "work_done", F.coalesce("resolved", F.lit(False)).alias("resolved")).agg(F.count("*").alias("n"))


def post_edit_tail(steps: DataFrame, runs: DataFrame) -> DataFrame:
    """Per model, over the runs with a source edit: quartiles of where the last one is, in per cent of the run's steps, and
    how large a part of all their steps comes after it."""
    edit = F.col("intent").isin(dims.SOURCE_EDIT_STEPS)
    last = steps.join(runs.select("run_id"), "run_id", "left_semi").groupBy("run_id", "model").agg(F.max(F.when(edit, F.col("step_idx"))).alias("last"), F.count("*").alias("n")).where("last is not null")
    at = last.select("model", "n", (F.col("n") - 1 - F.col("last")).alias("after"), (F.col("last") * 100.0 / F.greatest(F.col("n") - 1, F.lit(1))).alias("at"))
    tail = at.groupBy("model").agg((F.sum("after") / F.sum("n")).alias("tail_share"))
    return nearest_quartiles(at, ["model"], "at").join(tail, "model")


def intents_among(steps: DataFrame, intents: list[str]) -> DataFrame:
    """(model, intent, n, share) of the given intents among themselves, also over all models (null), zeros kept."""
    counts = steps.where(F.col("intent").isin(intents)).groupingSets([["model", "intent"], ["intent"]], "model", "intent").agg(F.count("*").alias("n"))
    grid = counts.select("model").distinct().select("model", F.explode(F.array(*map(F.lit, intents))).alias("intent"))
    both = grid.alias("g").join(counts.alias("c"), F.col("g.model").eqNullSafe(F.col("c.model")) & (F.col("g.intent") == F.col("c.intent")), "left")
    return both.select("g.model", "g.intent", F.coalesce("c.n", F.lit(0)).alias("n")).withColumn("share", share("n", "model"))


def classification_table(steps: DataFrame) -> DataFrame:
    """(category, intent, model, n, pct): counts with subtotals of each category and the whole (nulls), per cent of the model's steps."""
    counts = steps.groupingSets([["model", "category", "intent"], ["model", "category"], ["model"]], "model", "category", "intent").agg(F.count("*").alias("n"))
    total = F.max("n").over(Window.partitionBy("model"))  # the model's own row
    return counts.select("category", "intent", "model", "n", (F.col("n") * 100.0 / total).alias("pct"))


def all_models(rows: DataFrame, name: str = "all") -> DataFrame:
    """The rows as if of one model, for a mart over all models."""
    return rows.withColumn("model", F.lit(name))


def edit_markers(positions: DataFrame) -> DataFrame:
    """(model, marker, n, median, p25, p75): where the first and the last edit are, over the runs with an edit."""
    cells = F.array(*[F.struct(F.lit(m).alias("marker"), F.col(m).alias("at")) for m in ("first_edit", "last_edit")])
    return nearest_quartiles(positions.select("model", F.explode(cells).alias("c")).select("model", "c.marker", "c.at"), ["model", "marker"], "at")


def submission_funnel(runs: DataFrame) -> DataFrame:
    status = F.col("exit_status")
    return runs.groupBy("model").agg(
        F.count("*").alias("n"), count_if(status == "submitted").alias("clean"), count_if(status.startswith("submitted (")).alias("with_error"),
        count_if(~status.startswith("submitted")).alias("not_submitted"), count_if(F.col("resolved")).alias("n_resolved"),
    )


def failure_rates(steps: DataFrame) -> DataFrame:
    failed = count_if(F.col("mode").isNotNull())
    return steps.groupBy("model").agg(F.count_distinct("run_id").alias("n_runs"), F.count("*").alias("n_steps"), failed.alias("n_failures"), (failed / F.count("*")).alias("rate"))


def failure_modes(steps: DataFrame) -> DataFrame:
    return steps.where("mode is not null").groupBy("model", "mode").agg(F.count("*").alias("n"), F.count_distinct("run_id").alias("n_runs"))


def failure_families(steps: DataFrame) -> DataFrame:
    family = F.create_map(*[F.lit(x) for pair in dims.MODE_FAMILY.items() for x in pair])
    counts = steps.where("mode is not null").groupBy("model", family[F.col("mode")].alias("family")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", share("n", "model"))


def mode_share(steps: DataFrame, modes: list[str]) -> DataFrame:
    """Per model: how many of its failures are of the given modes, and their share; models without a failure have no share."""
    held = F.coalesce(F.col("mode").isin(modes), F.lit(False))
    failed, some = count_if(F.col("mode").isNotNull()), count_if(held)
    return steps.groupBy("model").agg(failed.alias("n_failures"), some.alias("n"), F.try_divide(some.cast("double"), failed).alias("share"))


def failure_samples(steps: DataFrame, most: int = 4, action_chars: int = 600, observation_chars: int = 800) -> DataFrame:
    """A top-k report: the first failure of each mode in a run, of the first ``most`` runs of a model and mode."""
    first = steps.where("mode is not null").groupBy("model", "mode", "run_id").agg(F.min_by(F.struct("step_idx", "action", "observation"), "step_idx").alias("s"))
    place = F.row_number().over(Window.partitionBy("model", "mode").orderBy("run_id"))
    return first.withColumn("place", place).where(F.col("place") <= most).select(
        "model", "mode", "place", "run_id", "s.step_idx", F.left("s.action", F.lit(action_chars)).alias("action"), F.left("s.observation", F.lit(observation_chars)).alias("observation")
    )


def run_stats(steps: DataFrame) -> DataFrame:
    """Tool time, action counts and text volumes of each run; the median is the upper middle value."""
    text = lambda c: F.coalesce(F.sum(F.length(c)), F.lit(0))
    acts = [count_if(F.col("act") == a).alias(f"n_{a}") for a in ("bash", "view", "edit", "create", "search_find", "submit", "other")]
    seconds = F.coalesce("execution_time", F.lit(0.0))
    out = steps.withColumn("seconds", seconds).groupBy("run_id", "model").agg(
        F.count("*").alias("steps"), F.sum("seconds").alias("tool_time"), F.avg("seconds").alias("tool_time_mean"), F.max("seconds").alias("tool_time_max"),
        F.expr("percentile_disc(0.5) within group (order by seconds desc)").alias("tool_time_median"),  # from above, so the upper one
        count_if(F.col("seconds") > 10).alias("over_10s"), count_if(F.col("seconds") > 60).alias("over_60s"), *acts,
        text("observation").alias("observation_chars"), text("action").alias("action_chars"), text("thought").alias("thought_chars"),
    )
    return out


def model_summary(runs: DataFrame, stats: DataFrame) -> DataFrame:
    j = runs.join(stats.drop("model"), "run_id")
    sums = j.groupBy("model").agg(
        F.avg("cost").alias("mean_cost"), F.min("cost").alias("min_cost"), F.max("cost").alias("max_cost"), F.sum("cost").alias("total_cost"),
        F.try_divide(F.sum("cost"), count_if(F.col("resolved")).cast("double")).alias("cost_per_resolve"),
        F.try_divide(F.sum("cost") * 1e6, F.sum("tokens_sent").cast("double")).alias("cost_per_million_sent"),
        F.avg("tokens_sent").alias("mean_sent"), F.avg("tokens_received").alias("mean_received"),
        F.avg(F.col("tokens_sent") / F.greatest("api_calls", F.lit(1))).alias("mean_sent_per_call"),
        F.avg("tool_time").alias("mean_tool_time"), F.avg("steps").alias("mean_steps"), F.avg("observation_chars").alias("mean_observation_chars"),
    )
    return middle(j, ["model"], "cost", "median_cost").join(sums, "model")


def outcome_breakdown(runs: DataFrame, stats: DataFrame) -> DataFrame:
    """Means of overlapping groups: resolved, unresolved (a missing outcome is in neither), not submitted."""
    group = F.array_compact(
        F.array(F.when(F.col("resolved"), F.lit("resolved")), F.when(~F.col("resolved"), F.lit("unresolved")), F.when(~F.col("has_patch"), F.lit("not_submitted")))
    )
    j = runs.join(stats.select("run_id", "steps", "tool_time"), "run_id").withColumn("outcome", F.explode(group))
    return j.groupBy("model", "outcome").agg(F.count("*").alias("n"), F.avg("cost").alias("mean_cost"), F.avg("steps").alias("mean_steps"), F.avg("tool_time").alias("mean_tool_time"))


def tail_mix(steps: DataFrame, start: str = "0.7") -> DataFrame:
    """Intents of the last part of each run, from step floor(start * n) on; ``start`` is a decimal, as 0.7 in binary is below it:
    of 90 steps it gave 62."""
    n = F.count("*").over(Window.partitionBy("run_id"))
    late = steps.withColumn("n", n).where(F.col("step_idx") >= F.floor(F.col("n") * F.lit(Decimal(start))))
    return late.groupBy("model", "intent").agg(F.count("*").alias("n")).withColumn("share", share("n", "model"))


def step_ecdf(per_run: DataFrame, cap: int = 250, width: int = 5) -> DataFrame:
    """Share of a model's runs with up to so many steps; longer runs than ``cap`` are in no bin but in the total."""
    total = per_run.groupBy("model").agg(F.count("*").alias("total"))
    bins = per_run.where(F.col("steps") <= cap).groupBy("model", (F.ceil(F.col("steps") / width) * width).alias("upto")).agg(F.count("*").alias("n"))
    running = F.sum("n").over(Window.partitionBy("model").orderBy("upto"))
    return bins.join(total, "model").select("model", "upto", "n", (running / F.col("total")).alias("ecdf"))


def taxonomy_counts(steps: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Every intent of the taxonomy with its count per model, zeros kept."""
    counts = steps.groupBy("intent", "model").agg(F.count("*").alias("n"))
    models = counts.select("model").distinct()
    return taxonomy.crossJoin(F.broadcast(models)).join(counts, ["intent", "model"], "left").select("category", "intent", "model", F.coalesce("n", F.lit(0)).alias("n"))


def ecdf_points(per_run: DataFrame, cap: int = 250, width: int = 5) -> DataFrame:
    """(model, bin, n, x, y): bins of steps with the share of a model's runs up to them, drawn at ``cap`` at most."""
    bins = per_run.groupBy("model", (F.floor(F.col("steps") / width) * width).alias("bin")).agg(F.count("*").alias("n"))
    model = Window.partitionBy("model")
    y = F.sum("n").over(model.orderBy("bin")) / F.sum("n").over(model)
    return bins.select("model", "bin", "n", F.least("bin", F.lit(cap)).alias("x"), y.alias("y"))


def ecdf_summary(per_run: DataFrame, cap: int = 250, width: int = 5) -> DataFrame:
    """(model, total, censored, median): the share of runs from ``cap`` on, and the median on the straight line from the last
    point below one half, or from the origin, to the first that isn't."""
    points = ecdf_points(per_run, cap, width)
    order = Window.partitionBy("model").orderBy("bin")
    x0, y0 = F.coalesce(F.lag("x").over(order), F.lit(0)), F.coalesce(F.lag("y").over(order), F.lit(0.0))
    at = points.select("*", (x0 + (0.5 - y0) * (F.col("x") - x0) / (F.col("y") - y0)).alias("cross"))
    reached = F.when(F.col("y") >= 0.5, F.col("bin"))
    early = F.sum(F.when(F.col("bin") < cap, F.col("n")).otherwise(0))
    return at.groupBy("model").agg(F.sum("n").alias("total"), (1 - early / F.sum("n")).alias("censored"), F.min_by("cross", reached).alias("median"))
