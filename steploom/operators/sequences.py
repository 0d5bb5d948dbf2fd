"""Sequence layer of runs: labels from neighbouring steps, positions, transitions, progress bins, encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.text import command_signature, first_line, nth_word, text

BINS = 20


def sequence_labels(steps: DataFrame) -> DataFrame:
    """Labelled steps with ``seq``. All windows partition by the run first, so one shuffle serves them all."""
    run = Window.partitionBy("run_id").orderBy("step_idx")
    before, whole = run.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("run_id")
    at, intent = F.col("step_idx"), F.col("intent")
    verify, repro, edit = intent.isin(*dims.VERIFY_STEPS), intent.isin(*dims.REPRO_STEPS), intent.isin(*dims.EDIT_STEPS)
    s = steps.withColumn("_sig", F.when(verify | repro, command_signature(F.col("action"))).otherwise(F.lit("")))
    s = s.withColumn("_path", nth_word(first_line(text(F.col("action"))), 2))
    latest = lambda kind: F.coalesce(F.max(F.when(kind, at)).over(before), F.lit(-1))
    previous = lambda kind: F.last(F.when(kind, F.col("_sig")), ignorenulls=True).over(before)
    s = s.withColumn("_edit", latest(edit)).withColumn("_verify", latest(verify)).withColumn("_repro", latest(repro))
    s = s.withColumn("_vsig", previous(verify)).withColumn("_rsig", previous(repro)).withColumn("_failed", F.coalesce(F.lag(intent).over(run).isin(*dims.FAILED_VERIFY_STEPS), F.lit(False)))
    s = s.withColumn("_source", F.max(F.when(intent.isin(*dims.SOURCE_EDIT_STEPS), at)).over(whole))
    s = s.withColumn("_done", F.min(F.when(verify & (F.col("outcome") == "pass") & (at > F.col("_source")), at)).over(whole))
    same_path = Window.partitionBy("run_id", "_path").orderBy("step_idx").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_edited", (F.col("_path") != "") & (F.coalesce(F.sum(edit.cast("int")).over(same_path), F.lit(0)) > 0))

    def again(kind: str, last: Column, signature: Column) -> Column:
        return (
            F.when(F.col("_edit") > last, f"seq-{kind}-after-edit")
            .when((last >= 0) & (F.col("_sig") != "") & (F.col("_sig") == signature), f"seq-{kind}-rerun-same-command")
            .when(last >= 0, f"seq-{kind}-rerun-no-edit")
            .otherwise("seq-none")
        )

    failed = F.col("_failed")
    seq = (
        F.when(at == F.col("_done"), "seq-work-done")
        .when(verify, again("verify", F.col("_verify"), F.col("_vsig")))
        .when(repro, again("repro", F.col("_repro"), F.col("_rsig")))
        .when(edit & failed, "seq-edit-after-failed-verify")
        .when(intent.isin(*dims.READ_STEPS) & failed, "seq-diagnose-read-after-failed-verify")
        .when(intent.isin(*dims.READ_STEPS) & F.col("_edited"), "seq-reread-edited-file")
        .when(intent.isin(*dims.SEARCH_STEPS) & failed, "seq-diagnose-search-after-failed-verify")
        .when((intent == "submit") & (F.col("_verify") >= 0), "seq-submit-after-verify")
        .otherwise("seq-none")
    )
    return s.withColumn("seq", seq).drop("_sig", "_path", "_edit", "_verify", "_repro", "_vsig", "_rsig", "_failed", "_source", "_done", "_edited")


def positions(steps: DataFrame) -> DataFrame:
    """Per run: number of steps, and where marked steps are, in per cent of the run; null without such a step."""
    at, n = F.col("step_idx"), F.count("*")
    share = lambda index: index * 100.0 / F.greatest(n - 1, F.lit(1))
    edit, verify = F.col("category") == "edit", F.col("category") == "verify"
    first, last = (lambda c: F.min(F.when(c, at))), (lambda c: F.max(F.when(c, at)))
    return steps.groupBy("run_id", "model").agg(
        n.alias("steps"),
        share(first(edit)).alias("first_edit"),
        share(last(edit)).alias("last_edit"),
        share(first(verify)).alias("first_verify"),
        share(last(verify)).alias("last_verify"),
        share(first(F.col("outcome") == "pass")).alias("first_verify_pass"),
        share(first(F.col("intent") == "submit")).alias("submit"),
    )


MARKERS = ["first_edit", "last_edit", "first_verify", "last_verify", "first_verify_pass", "submit"]


def bigrams(steps: DataFrame) -> DataFrame:
    """(model, a, b, n): letters of consecutive steps of a run."""
    following = F.lead("letter").over(Window.partitionBy("run_id").orderBy("step_idx"))
    pairs = steps.select("model", F.col("letter").alias("a"), following.alias("b")).where(F.col("b").isNotNull())
    return pairs.groupBy("model", "a", "b").agg(F.count("*").alias("n"))


def progress_bin(index: Column, n: Column, bins: int = BINS) -> Column:
    """The bin of a step where bin b begins at floor(b * n / bins)."""
    return F.floor((bins * (index + 1) + n - 1) / n) - 1


def run_strings(steps: DataFrame, symbol: str = "letter") -> DataFrame:
    """(run_id, model, sequence): one symbol per step. A run is one string by nature."""
    ordered = F.sort_array(F.collect_list(F.struct("step_idx", symbol)))
    return steps.groupBy("run_id", "model").agg(F.array_join(F.transform(ordered, lambda s: s[symbol]), "").alias("sequence"))


def run_lengths(steps: DataFrame, symbol: str = "letter") -> DataFrame:
    """(run_id, island, symbol, first_step, length): runs of equal symbols."""
    run = Window.partitionBy("run_id").orderBy("step_idx")
    change = F.coalesce((F.lag(symbol).over(run) != F.col(symbol)).cast("int"), F.lit(0))
    marked = steps.withColumn("_change", change).withColumn("island", F.sum("_change").over(run))
    return marked.groupBy("run_id", "island").agg(F.first(symbol).alias("symbol"), F.min("step_idx").alias("first_step"), F.count("*").alias("length"))


#: Fixed value: the symbols of base intents, in the order that they are given out.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def symbols(steps: DataFrame) -> DataFrame:
    """(intent, symbol): the intents that occur, in order, with a symbol each; an error if there are more than symbols."""
    found = steps.select("intent").distinct()
    n = found.count()
    if n > len(ALPHABET):
        raise ValueError(f"{n} intents for {len(ALPHABET)} symbols")
    place = F.row_number().over(Window.orderBy("intent"))  # as many rows as symbols at most
    return found.select("intent", F.substring(F.lit(ALPHABET), place, F.lit(1)).alias("symbol"))


def intent_strings(steps: DataFrame) -> DataFrame:
    """(run_id, model, sequence): one symbol of ``symbols`` per step."""
    return run_strings(steps.join(F.broadcast(symbols(steps)), "intent"), "symbol")


def find_runs(strings: DataFrame, contains: str = "", models: list[str] | None = None, repos: list[str] | None = None, tasks: list[str] | None = None, submitted_only: bool = False, sort: str = "name") -> DataFrame:
    """Runs of ``strings(run_id, model, repo, task, submitted, steps, sequence)`` that meet all conditions, and their ``place``.

    ``contains`` is looked for in any case. ``sort`` is ``steps_desc``, ``steps_asc`` or ``name`` (repository, task, model);
    equal ones go by run.
    """
    out = strings.where(F.contains(F.upper("sequence"), F.upper(F.lit(contains.strip()))))
    for column, values in (("model", models), ("repo", repos), ("task", tasks)):
        out = out.where(F.col(column).isin(*values)) if values else out
    out = out.where("submitted") if submitted_only else out
    by = {"steps_desc": [F.desc("steps")], "steps_asc": [F.asc("steps")], "name": [F.asc("repo"), F.asc("task"), F.asc("model")]}[sort]
    return out.orderBy(*by, "run_id")
