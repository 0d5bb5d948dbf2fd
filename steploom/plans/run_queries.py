"""Queries over runs and steps, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.outcomes import repo_of_instance as repo_of
from ..functions.text import command_signature as signature_of
from ..functions.text import git_subcommand as subcommand_of
from ..functions.text import strip_wrappers, unwrap_command
from ..operators import marts, pairing, sequences
from ..sources import ingest
from . import fixtures
from .fixtures import BASE_SQL
from .templates import GIT, SIGNATURES, STEPS
from .transcript_files import shared_path

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function of (spark, sf_dir); ``sql`` continues the common table expressions."""

    def keep(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = BASE_SQL + sql
        return f

    return keep


def sequenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.sequence_labels(fixtures.labelled(spark, sf_dir))


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.run_stats(fixtures.actions(spark, sf_dir))


def per_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.steps(spark, sf_dir).groupBy("run_id", "model").agg(F.count("*").alias("steps"))


@query("select run_id, model, step_idx, action_chars > 0 as has_action, action_chars, observation_chars, execution_time from steps")
def steps(spark, sf_dir):
    s = fixtures.steps(spark, sf_dir)
    chars = lambda c: F.length(F.coalesce(c, F.lit(""))).cast("long")
    return s.select("run_id", "model", "step_idx", (chars("action") > 0).alias("has_action"), chars("action").alias("action_chars"), chars("observation").alias("observation_chars"), "execution_time")


@query("select run_id, step_idx, intent from steps")
def step_intent(spark, sf_dir):
    return fixtures.labelled(spark, sf_dir).select("run_id", "step_idx", "intent")


@query("select run_id, step_idx, category || '.' || intent as hierarchical, letter, phase from steps")
def step_hierarchy(spark, sf_dir):
    return fixtures.labelled(spark, sf_dir).select("run_id", "step_idx", F.concat_ws(".", "category", "intent").alias("hierarchical"), "letter", "phase")


@query("select run_id, step_idx, outcome from steps")
def verify_outcome(spark, sf_dir):
    return fixtures.labelled(spark, sf_dir).select("run_id", "step_idx", "outcome")


@query("select run_id, step_idx, mode from steps where mode is not null")
def failure_mode(spark, sf_dir):
    return fixtures.failures(spark, sf_dir).where("mode is not null").select("run_id", "step_idx", "mode")


@query("select run_id, step_idx, act from steps")
def action_category(spark, sf_dir):
    return fixtures.actions(spark, sf_dir).select("run_id", "step_idx", "act")


@query("select model, intent, count(*) as n, count(*)::double / sum(count(*)) over (partition by model) as share from steps group by model, intent")
def intent_frequencies(spark, sf_dir):
    return marts.intent_frequencies(fixtures.labelled(spark, sf_dir))


@query("""select s.model, category, count(*) as n, count(*)::double / sum(count(*)) over (partition by s.model) as share,
  count(*)::double / (select count(*) from runs r where r.model = s.model) as per_run
from steps s group by s.model, category""")
def category_frequencies(spark, sf_dir):
    return marts.category_frequencies(fixtures.labelled(spark, sf_dir), fixtures.runs(spark, sf_dir))


@query("select * from (select model, phase, count(*) as n, 100.0::double * count(*) / sum(count(*)) over (partition by model) as pct from steps group by model, phase) where phase is not null")
def phase_frequencies(spark, sf_dir):
    return marts.phase_frequencies(fixtures.labelled(spark, sf_dir))


@query(""", f as (select model, intent, 100.0::double * count(*) / sum(count(*)) over (partition by model) as p from steps group by 1, 2),
w as (select intent, coalesce(max(p) filter (model = 'claude45'), 0) as claude45, coalesce(max(p) filter (model = 'gpt5'), 0) as gpt5,
  coalesce(max(p) filter (model = 'gemini25pro'), 0) as gemini25pro, coalesce(max(p) filter (model = 'glm45'), 0) as glm45 from f group by 1)
select *, greatest(claude45, gpt5, gemini25pro, glm45) as largest from w where greatest(claude45, gpt5, gemini25pro, glm45) > 1.5""")
def intent_comparison(spark, sf_dir):
    return marts.intent_comparison(fixtures.labelled(spark, sf_dir), fixtures.MODELS)


@query("""select model, count(*) filter (outcome = 'pass') as n_pass, count(*) filter (outcome = 'fail') as n_fail, count(*) filter (outcome = '') as n_unknown,
  count(*) as total, 100.0::double * count(*) filter (outcome = 'pass') / nullif(count(*) filter (outcome <> ''), 0) as pass_pct from steps group by model""")
def verify_outcomes(spark, sf_dir):
    return marts.verify_outcomes(fixtures.labelled(spark, sf_dir))


@query("select model, intent, count(*) as n, count(*)::double / sum(count(*)) over (partition by model) as share from steps where category = 'verify' group by model, intent")
def verify_subintents(spark, sf_dir):
    return marts.intent_frequencies(fixtures.labelled(spark, sf_dir).where("category = 'verify'"))


_LIST = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"
#: The sequence layer in SQL. Verifying templates have different signatures, so equal signatures are equal templates.
SEQ_SQL = f""", kinds as (
  select *, intent in {_LIST(dims.VERIFY_STEPS)} as v, intent in {_LIST(dims.REPRO_STEPS)} as p, intent in {_LIST(dims.EDIT_STEPS)} as e,
         intent in {_LIST(dims.SOURCE_EDIT_STEPS)} as se, intent in {_LIST(dims.READ_STEPS)} as rd, intent in {_LIST(dims.SEARCH_STEPS)} as sr,
         count(*) over (partition by run_id) as n
  from steps),
hist as (
  select *,
    coalesce(max(case when e then step_idx end) over w, -1) as le, coalesce(max(case when v then step_idx end) over w, -1) as lv,
    coalesce(max(case when p then step_idx end) over w, -1) as lp,
    coalesce(lag(intent) over (partition by run_id order by step_idx) in {_LIST(dims.FAILED_VERIFY_STEPS)}, false) as fb,
    max(case when se then step_idx end) over (partition by run_id) as lse
  from kinds window w as (partition by run_id order by step_idx rows between unbounded preceding and 1 preceding)),
done as (select run_id, min(step_idx) as at from hist where v and outcome = 'pass' and step_idx > lse group by 1),
seqs as (
  select h.*, case
    when d.at = h.step_idx then 'seq-work-done'
    when v and le > lv then 'seq-verify-after-edit'
    when v and lv >= 0 and h.tpl = x.tpl then 'seq-verify-rerun-same-command'
    when v and lv >= 0 then 'seq-verify-rerun-no-edit'
    when p and le > lp then 'seq-repro-after-edit'
    when p and lp >= 0 and h.tpl = y.tpl then 'seq-repro-rerun-same-command'
    when p and lp >= 0 then 'seq-repro-rerun-no-edit'
    when e and fb then 'seq-edit-after-failed-verify'
    when rd and fb then 'seq-diagnose-read-after-failed-verify'
    when rd and path <> '' and exists (select 1 from kinds k where k.run_id = h.run_id and k.step_idx < h.step_idx and k.e and k.path = h.path) then 'seq-reread-edited-file'
    when sr and fb then 'seq-diagnose-search-after-failed-verify'
    when intent = 'submit' and lv >= 0 then 'seq-submit-after-verify'
    else 'seq-none' end as seq
  from hist h
  left join (select run_id as r1, step_idx as i1, tpl from steps) x on x.r1 = h.run_id and x.i1 = h.lv
  left join (select run_id as r2, step_idx as i2, tpl from steps) y on y.r2 = h.run_id and y.i2 = h.lp
  left join done d on d.run_id = h.run_id)
"""


@query(SEQ_SQL + "select run_id, step_idx, seq from seqs")
def sequence_labels(spark, sf_dir):
    return sequenced(spark, sf_dir).select("run_id", "step_idx", "seq")


@query(SEQ_SQL + "select model, seq, count(*) as n from seqs where seq <> 'seq-none' group by model, seq")
def sequence_label_counts(spark, sf_dir):
    return marts.sequence_label_counts(sequenced(spark, sf_dir))


@query(SEQ_SQL + """, c as (select model, run_id, count(*) filter (seq = 'seq-verify-after-edit') as cycles from seqs group by 1, 2)
select model, median(cycles)::double as median, avg(cycles) as mean, cast(sum(cycles) as bigint) as total from c group by model""")
def edit_verify_cycles(spark, sf_dir):
    return marts.edit_verify_cycles(sequenced(spark, sf_dir))


POS_SQL = """, pos as (
  select run_id, model, count(*) as steps,
    min(step_idx) filter (category = 'edit') * 100.0::double / greatest(count(*) - 1, 1) as first_edit, max(step_idx) filter (category = 'edit') * 100.0::double / greatest(count(*) - 1, 1) as last_edit,
    min(step_idx) filter (category = 'verify') * 100.0::double / greatest(count(*) - 1, 1) as first_verify, max(step_idx) filter (category = 'verify') * 100.0::double / greatest(count(*) - 1, 1) as last_verify,
    min(step_idx) filter (outcome = 'pass') * 100.0::double / greatest(count(*) - 1, 1) as first_verify_pass, min(step_idx) filter (intent = 'submit') * 100.0::double / greatest(count(*) - 1, 1) as submit
  from steps group by run_id, model)
"""


@query(POS_SQL + "select * from pos")
def positions(spark, sf_dir):
    return sequences.positions(fixtures.labelled(spark, sf_dir))


@query(POS_SQL + """, long as (
  select 'first_edit' as marker, run_id, model, first_edit as spot from pos union all select 'last_edit', run_id, model, last_edit from pos
  union all select 'first_verify', run_id, model, first_verify from pos union all select 'last_verify', run_id, model, last_verify from pos
  union all select 'first_verify_pass', run_id, model, first_verify_pass from pos union all select 'submit', run_id, model, submit from pos),
l as (select long.*, coalesce(resolved, false) as won from long join runs using (run_id) where spot is not null)
select marker, l.model, count(*) as n, median(spot) as median, list(spot order by spot)[count(*) // 4 + 1] as p25, list(spot order by spot)[count(*) * 3 // 4 + 1] as p75,
  median(spot) filter (won) as resolved_median, median(spot) filter (not won) as unresolved_median from l group by 1, 2""")
def structural_markers(spark, sf_dir):
    return marts.structural_markers(sequences.positions(fixtures.labelled(spark, sf_dir)), fixtures.runs(spark, sf_dir))


@query(""", own as (select run_id, count(*) as steps, count(*) filter (category = 'verify') as v, count(*) filter (category = 'edit') as e from steps group by 1),
top as (select repo from runs group by repo order by count(*) desc, repo limit 12)
select repo, model, count(*) as n, avg(steps) as avg_steps, case when count(*) >= 3 then count(*) filter (resolved)::double / count(*) end as resolve_rate,
  sum(v)::double / sum(steps) as verify_share, sum(e)::double / sum(steps) as edit_share, sum(v)::double / nullif(sum(e), 0) as verify_per_edit
from runs join own using (run_id) where repo in (select repo from top) group by 1, 2""")
def per_repo(spark, sf_dir):
    return marts.per_repo(fixtures.labelled(spark, sf_dir), fixtures.runs(spark, sf_dir))


@query(", c as (select run_id, model, count(*) as steps from steps group by 1, 2) select model, steps // 5 * 5 as from_steps, count(*) as n from c group by 1, 2")
def step_histogram(spark, sf_dir):
    return marts.step_histogram(per_run(spark, sf_dir))


PROFILE_SQL = """, nn as (select *, count(*) over (partition by run_id) as n from steps),
b as (select model, run_id, letter, (20 * (step_idx + 1) + n - 1) // n - 1 as bin from nn where n >= 5),
k as (select model, run_id, bin, letter, count(*)::double / sum(count(*)) over (partition by run_id, bin) as s from b group by 1, 2, 3, 4),
grid as (select m.model, m.n_runs, g.bin, x.letter from (select model, count(distinct run_id) as n_runs from b group by 1) m,
  (select range as bin from range(20)) g, (select distinct letter from tax) x),
prof as (select grid.model, grid.bin, grid.letter, coalesce(sum(s), 0) / any_value(n_runs) as mean_share
  from grid left join k on k.model = grid.model and k.bin = grid.bin and k.letter = grid.letter group by 1, 2, 3)
"""


@query(PROFILE_SQL + "select * from prof")
def phase_profile(spark, sf_dir):
    return marts.phase_profile(fixtures.labelled(spark, sf_dir))


@query(PROFILE_SQL + "select model, bin, letter, mean_share / nullif(sum(mean_share) over (partition by model, bin), 0) as share from prof where letter not in ('X', 'O')")
def phase_heatmap(spark, sf_dir):
    return marts.phase_heatmap(marts.phase_profile(fixtures.labelled(spark, sf_dir)))


@query(""", p as (select model, letter as a, lead(letter) over (partition by run_id order by step_idx) as b from steps),
c as (select model, a, b, count(*) as n from p where b is not null group by 1, 2, 3),
t as (select model, sum(n) as total from c group by 1),
l as (select distinct letter from tax)
select t.model, x.letter as a, y.letter as b, coalesce(c.n, 0) as n, coalesce(c.n, 0)::double / total as share
from t cross join l x cross join l y left join c on c.model = t.model and c.a = x.letter and c.b = y.letter""")
def bigram_matrix(spark, sf_dir):
    return marts.bigram_matrix(sequences.bigrams(fixtures.labelled(spark, sf_dir)))


@query(""", c as (select run_id, count(*) as steps from steps group by 1)
select model, count(*) as n, median(steps)::double as median, list(steps order by steps)[count(*) // 4 + 1] as p25, list(steps order by steps)[count(*) * 3 // 4 + 1] as p75,
  cast(sum(steps) as bigint) as total_steps, avg(steps) as avg_steps, min(steps) as min_steps, max(steps) as max_steps,
  count(*) filter (resolved) as n_resolved, count(*) filter (resolved)::double / count(*) as resolve_rate from c join runs using (run_id) group by model""")
def run_metadata(spark, sf_dir):
    return marts.run_metadata(per_run(spark, sf_dir), fixtures.runs(spark, sf_dir))


@query("select exit_status, count(*) filter (model = 'claude45') as claude45, count(*) filter (model = 'gpt5') as gpt5, count(*) filter (model = 'gemini25pro') as gemini25pro, count(*) filter (model = 'glm45') as glm45, count(*) as total from runs group by 1")
def exit_status_counts(spark, sf_dir):
    wide = fixtures.runs(spark, sf_dir).groupBy("exit_status").pivot("model", fixtures.MODELS).count().na.fill(0)
    return wide.withColumn("total", sum((F.col(m) for m in fixtures.MODELS), F.lit(0)))


WORK_SQL = SEQ_SQL + ", wd as (select run_id, bool_or(seq = 'seq-work-done') as work_done from seqs group by 1)\n"


@query(WORK_SQL + "select model, work_done, coalesce(resolved, false) as resolved, count(*) as n from runs join wd using (run_id) group by 1, 2, 3")
def work_done_confusion(spark, sf_dir):
    return marts.work_done(sequenced(spark, sf_dir), fixtures.runs(spark, sf_dir))


@query("select model, count(*) as n, count(*) filter (exit_status = 'submitted') as clean, count(*) filter (starts_with(exit_status, 'submitted (')) as with_error, count(*) filter (not starts_with(exit_status, 'submitted')) as not_submitted, count(*) filter (resolved) as n_resolved from runs group by model")
def submission_funnel(spark, sf_dir):
    return marts.submission_funnel(fixtures.runs(spark, sf_dir))


@query("select model, count(distinct run_id) as n_runs, count(*) as n_steps, count(mode) as n_failures, count(mode)::double / count(*) as rate from steps group by model")
def failure_rates(spark, sf_dir):
    return marts.failure_rates(fixtures.failures(spark, sf_dir))


@query("select model, mode, count(*) as n, count(distinct run_id) as n_runs from steps where mode is not null group by 1, 2")
def failure_modes(spark, sf_dir):
    return marts.failure_modes(fixtures.failures(spark, sf_dir))


@query(f", fam(family, mode) as ({dims.values_sql([(f, m) for m, f in dims.MODE_FAMILY.items()])}) select model, family, count(*) as n, count(*)::double / sum(count(*)) over (partition by model) as share from steps join fam using (mode) group by 1, 2")
def failure_families(spark, sf_dir):
    return marts.failure_families(fixtures.failures(spark, sf_dir))


@query(""", f as (select model, mode, run_id, min(step_idx) as step_idx from steps where mode is not null group by 1, 2, 3),
r as (select *, row_number() over (partition by model, mode order by run_id) as place from f)
select r.model, r.mode, place, r.run_id, r.step_idx, least(action_chars, 600) as action_chars, least(observation_chars, 800) as observation_chars
from r join steps s on s.run_id = r.run_id and s.step_idx = r.step_idx where place <= 4""")
def failure_samples(spark, sf_dir):
    s = marts.failure_samples(fixtures.failures(spark, sf_dir))
    return s.select("model", "mode", "place", "run_id", "step_idx", F.length("action").alias("action_chars"), F.length("observation").alias("observation_chars"))


STATS_SQL = """, st as (
  select run_id, model, count(*) as steps, sum(coalesce(execution_time, 0)) as tool_time, avg(coalesce(execution_time, 0)) as tool_time_mean, max(coalesce(execution_time, 0)) as tool_time_max,
    list(coalesce(execution_time, 0) order by coalesce(execution_time, 0))[count(*) // 2 + 1] as tool_time_median,
    count(*) filter (execution_time > 10) as over_10s, count(*) filter (execution_time > 60) as over_60s,
    count(*) filter (act = 'bash') as n_bash, count(*) filter (act = 'view') as n_view, count(*) filter (act = 'edit') as n_edit, count(*) filter (act = 'create') as n_create,
    count(*) filter (act = 'search_find') as n_search_find, count(*) filter (act = 'submit') as n_submit, count(*) filter (act = 'other') as n_other,
    cast(sum(observation_chars) as bigint) as observation_chars, cast(sum(action_chars) as bigint) as action_chars, cast(sum(k) as bigint) as thought_chars
  from steps group by run_id, model)
"""


@query(STATS_SQL + "select * from st")
def run_stats(spark, sf_dir):
    return stats(spark, sf_dir)


@query(STATS_SQL + "select model, cast(sum(observation_chars) as bigint) as observation_chars, cast(sum(action_chars) as bigint) as action_chars, cast(sum(thought_chars) as bigint) as thought_chars from st group by 1")
def content_volume(spark, sf_dir):
    return stats(spark, sf_dir).groupBy("model").agg(*[F.sum(c).alias(c) for c in ("observation_chars", "action_chars", "thought_chars")])


@query(STATS_SQL + """select model, count(*) as n, median(cost) as median_cost, avg(cost) as mean_cost, min(cost) as min_cost, max(cost) as max_cost, sum(cost) as total_cost,
  sum(cost) / nullif(count(*) filter (resolved), 0) as cost_per_resolve, sum(cost) * 1e6 / nullif(sum(tokens_sent), 0) as cost_per_million_sent,
  avg(tokens_sent) as mean_sent, avg(tokens_received) as mean_received, avg(tokens_sent::double / greatest(api_calls, 1)) as mean_sent_per_call,
  avg(tool_time) as mean_tool_time, avg(steps) as mean_steps, avg(observation_chars) as mean_observation_chars
from runs join (select * exclude (model) from st) s using (run_id) group by model""")
def model_summary(spark, sf_dir):
    return marts.model_summary(fixtures.runs(spark, sf_dir), stats(spark, sf_dir))


@query(STATS_SQL + """, g as (
  select 'resolved' as outcome, run_id from runs where resolved union all select 'unresolved', run_id from runs where not resolved union all select 'not_submitted', run_id from runs where not has_patch)
select runs.model, outcome, count(*) as n, avg(cost) as mean_cost, avg(steps) as mean_steps, avg(tool_time) as mean_tool_time
from g join runs using (run_id) join st using (run_id) group by 1, 2""")
def outcome_breakdown(spark, sf_dir):
    return marts.outcome_breakdown(fixtures.runs(spark, sf_dir), stats(spark, sf_dir))


PAIR_SQL = STATS_SQL + """, rr as (select runs.*, steps, tool_time from runs join st using (run_id)),
pa as (select *, row_number() over (partition by instance_no order by run_id desc) as o from rr where model = 'claude45'),
pb as (select *, row_number() over (partition by instance_no order by run_id desc) as o from rr where model = 'gpt5'),
two as (select a.instance_no, a.repo,
  a.run_id as run_id_a, a.exit_status as exit_a, a.has_patch as has_patch_a, a.patch_chars as patch_chars_a, a.resolved as resolved_a, a.cost as cost_a, a.tokens_sent as tokens_sent_a,
  a.tokens_received as tokens_received_a, a.api_calls as api_calls_a, a.steps as steps_a, a.tool_time as tool_time_a,
  b.run_id as run_id_b, b.exit_status as exit_b, b.has_patch as has_patch_b, b.patch_chars as patch_chars_b, b.resolved as resolved_b, b.cost as cost_b, b.tokens_sent as tokens_sent_b,
  b.tokens_received as tokens_received_b, b.api_calls as api_calls_b, b.steps as steps_b, b.tool_time as tool_time_b
  from pa a join pb b on a.instance_no = b.instance_no and a.o = 1 and b.o = 1),
sub as (select * from two where has_patch_a and has_patch_b),
met as (
  select 'cost' as metric, cost_a::double as x, cost_b::double as y from sub union all select 'tokens_sent', tokens_sent_a, tokens_sent_b from sub
  union all select 'tokens_received', tokens_received_a, tokens_received_b from sub union all select 'api_calls', api_calls_a, api_calls_b from sub
  union all select 'steps', steps_a, steps_b from sub union all select 'tool_time', tool_time_a, tool_time_b from sub union all select 'patch_chars', patch_chars_a, patch_chars_b from sub)
"""


def joined_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = fixtures.runs(spark, sf_dir).join(stats(spark, sf_dir).select("run_id", "steps", "tool_time"), "run_id")
    return pairing.pairs(runs, "claude45", "gpt5")


@query(PAIR_SQL + "select * exclude (exit_a, exit_b) from sub")
def paired_runs(spark, sf_dir):
    return pairing.flat(pairing.submitted(joined_pairs(spark, sf_dir)))


@query(PAIR_SQL + """select (select count(*) from sub) as paired,
  (select count(*) from pa full join pb on pa.instance_no = pb.instance_no where pa.run_id is null or pb.run_id is null) as skipped_unpaired,
  (select count(*) from two) - (select count(*) from sub) as skipped_unsubmitted""")
def pairing_coverage(spark, sf_dir):
    return pairing.coverage(joined_pairs(spark, sf_dir))


@query(PAIR_SQL + "select instance_no, cost_a, cost_b, steps_a, steps_b from two where resolved_a and resolved_b")
def paired_both_resolved(spark, sf_dir):
    return pairing.flat(pairing.both(joined_pairs(spark, sf_dir)).where("a.resolved and b.resolved")).select("instance_no", "cost_a", "cost_b", "steps_a", "steps_b")


UNSUB = """, un as (select instance_no, case when has_patch_a then 'a_only' when has_patch_b then 'b_only' else 'neither' end as submitted_by, exit_a, exit_b,
  coalesce(resolved_a, false) as resolved_a, coalesce(resolved_b, false) as resolved_b, cost_a, cost_b from two where not (has_patch_a and has_patch_b))
"""


@query(PAIR_SQL + UNSUB + "select * from un")
def paired_unsubmitted(spark, sf_dir):
    return pairing.unsubmitted(joined_pairs(spark, sf_dir))


@query(PAIR_SQL + UNSUB + "select submitted_by, count(*) as n, avg(cost_a) as mean_cost_a, avg(cost_b) as mean_cost_b, count(*) filter (resolved_a or resolved_b) as other_resolved from un group by 1")
def unsubmitted_summary(spark, sf_dir):
    won = marts.count_if(F.col("resolved_a") | F.col("resolved_b"))
    return pairing.unsubmitted(joined_pairs(spark, sf_dir)).groupBy("submitted_by").agg(
        F.count("*").alias("n"), F.avg("cost_a").alias("mean_cost_a"), F.avg("cost_b").alias("mean_cost_b"), won.alias("other_resolved")
    )


@query(PAIR_SQL + "select case when coalesce(resolved_a, false) and coalesce(resolved_b, false) then 'both' when coalesce(resolved_a, false) then 'a_only' when coalesce(resolved_b, false) then 'b_only' else 'neither' end as resolved_by, count(*) as n from sub group by 1")
def paired_outcomes(spark, sf_dir):
    p = pairing.submitted(joined_pairs(spark, sf_dir))
    return p.groupBy(pairing.resolved_by(p).alias("resolved_by")).agg(F.count("*").alias("n"))


@query(PAIR_SQL + "select metric, avg(x) as mean_a, avg(y) as mean_b, case when avg(y) > 0.5 then avg(x) / avg(y) end as ratio from met group by 1")
def paired_report(spark, sf_dir):
    return pairing.report(joined_pairs(spark, sf_dir))


@query(PAIR_SQL + """select metric, count(*) as n, quantile_cont(x / y, 0.25) as p25, quantile_cont(x / y, 0.5) as median, quantile_cont(x / y, 0.75) as p75,
  count(*) filter (x / y < 1) as lower, count(*) filter (x / y > 1) as higher from met where x > 0 and y > 0 group by 1""")
def paired_ratios(spark, sf_dir):
    return pairing.ratios(joined_pairs(spark, sf_dir))


@query(PAIR_SQL + """select count(*) as n, avg(cost_b - cost_a) as mean_cost_delta, count(*) filter (cost_b > cost_a) as b_dearer,
  avg(case when patch_chars_a > 0 then tokens_received_a::double / patch_chars_a else 0 end) as tokens_per_char_a, sum(cost_a) / nullif(sum(patch_chars_a), 0) as cost_per_char_a,
  avg(case when patch_chars_b > 0 then tokens_received_b::double / patch_chars_b else 0 end) as tokens_per_char_b, sum(cost_b) / nullif(sum(patch_chars_b), 0) as cost_per_char_b
from two where resolved_a and resolved_b""")
def head_to_head(spark, sf_dir):
    return pairing.head_to_head(joined_pairs(spark, sf_dir))


@query(WORK_SQL + PAIR_SQL + """, both_ids as (select run_id_a as run_id from sub union all select run_id_b from sub)
select model, work_done, coalesce(resolved, false) as resolved, count(*) as n from runs join wd using (run_id) where run_id in (select run_id from both_ids) group by 1, 2, 3""")
def work_done_paired(spark, sf_dir):
    p = pairing.submitted(joined_pairs(spark, sf_dir))
    ids = p.select(F.explode(F.array("a.run_id", "b.run_id")).alias("run_id"))
    return marts.work_done(sequenced(spark, sf_dir), fixtures.runs(spark, sf_dir).join(ids, "run_id", "left_semi"))


@query(", q as (select *, count(*) over (partition by run_id) as n from steps) select model, intent, count(*) as n, count(*)::double / sum(count(*)) over (partition by model) as share from q where step_idx >= floor(n * 0.7) group by 1, 2")
def tail_mix(spark, sf_dir):
    return marts.tail_mix(fixtures.labelled(spark, sf_dir))


@query("select count(*) as n_runs, count(distinct instance_no) as n_instances, count(distinct repo) as n_repos from runs")
def corpus_counts(spark, sf_dir):
    return fixtures.runs(spark, sf_dir).agg(F.count("*").alias("n_runs"), F.count_distinct("instance_no").alias("n_instances"), F.count_distinct("repo").alias("n_repos"))


@query(", c as (select intent, model, count(*) as n from steps group by 1, 2) select category, tax.intent, m.model, coalesce(c.n, 0) as n from tax cross join (select distinct model from steps) m left join c on c.intent = tax.intent and c.model = m.model")
def taxonomy_counts(spark, sf_dir):
    return marts.taxonomy_counts(fixtures.labelled(spark, sf_dir), fixtures.taxonomy(spark).select("intent", "category"))


@query(""", c as (select run_id, model, count(*) as steps from steps group by 1, 2),
b as (select model, cast(ceil(steps / 5.0) * 5 as bigint) as upto, count(*) as n from c where steps <= 250 group by 1, 2)
select model, upto, n, sum(n) over (partition by model order by upto)::double / (select count(*) from c where c.model = b.model) as ecdf from b""")
def step_ecdf(spark, sf_dir):
    return marts.step_ecdf(per_run(spark, sf_dir))


@query("select run_id, model, string_agg(letter, '' order by step_idx) as sequence from steps group by 1, 2")
def sequence_strings(spark, sf_dir):
    return sequences.run_strings(fixtures.labelled(spark, sf_dir))


@query("select run_id, model from (select run_id, model, string_agg(letter, '' order by step_idx) as s from steps group by 1, 2) where contains(s, 'EV')")
def sequence_search(spark, sf_dir):
    return sequences.run_strings(fixtures.labelled(spark, sf_dir)).where(F.contains("sequence", F.upper(F.lit("ev")))).select("run_id", "model")


@query(""", c as (select *, case when lag(letter) over (partition by run_id order by step_idx) <> letter then 1 else 0 end as ch from steps),
i as (select *, sum(ch) over (partition by run_id order by step_idx) as island from c)
select run_id, cast(island as bigint) as island, any_value(letter) as symbol, min(step_idx) as first_step, count(*) as length from i group by 1, 2""")
def sequence_rle(spark, sf_dir):
    return sequences.run_lengths(fixtures.labelled(spark, sf_dir))


@query(f"""select (array{fixtures.MODELS})[doc_id % 4 + 1] as model, case when doc_id % 17 = 5 then -1 - doc_id else doc_id // 4 end as instance_id,
  coalesce(quality = 1, false) as resolved from labels""")
def resolution_dim(spark, sf_dir):
    """Outcomes written as a file with a published header and outside names of the models, and read by the reader; models
    that it doesn't know are left out."""
    path = shared_path(spark, "outcomes")
    shown = F.concat(F.lit("Model "), "model")
    known = fixtures.outcomes(spark, sf_dir).select(shown.alias("metadata.model_name"), F.col("instance_id").alias("metadata.instance_id"), F.col("resolved").alias("metadata.resolved"))
    other = known.withColumn("metadata.model_name", F.lit("another model"))
    known.unionByName(other).write.option("header", True).csv(path)
    read = ingest.outcome_table(spark, path, {f"Model {m}": m for m in fixtures.MODELS})
    return read.select("model", F.col("instance_id").cast("bigint").alias("instance_id"), "resolved")


@query("select r.run_id, r.model, exists (select 1 from labels where doc_id = r.run_id and quality = 1) as resolved from runs r")
def runs_resolved(spark, sf_dir):
    r = fixtures.runs(spark, sf_dir).select("run_id", "model", F.col("instance_no").alias("instance_id"))
    return ingest.with_resolution(r, fixtures.outcomes(spark, sf_dir)).select("run_id", "model", "resolved")


@query("""select r.run_id, r.model, coalesce(case when r.run_id % 3 = 0 then r.resolved end, c.resolved) as resolved
from runs r left join runs c on c.instance_no = r.instance_no and c.model = 'claude45'""")
def runs_eval(spark, sf_dir):
    """Runs with evaluations of two scopes: one run in three has one of its own model, all share the first model's."""
    r = fixtures.runs(spark, sf_dir).select("run_id", "model", F.col("instance_no").alias("instance_id"), "resolved")
    known = r.where("resolved is not null")
    own = known.where("run_id % 3 = 0").select(F.col("model").alias("scope"), "instance_id", "resolved")
    shared = known.where("model = 'claude45'").select(F.lit("__all__").alias("scope"), "instance_id", "resolved")
    return ingest.with_outcomes(r.drop("resolved"), own.unionByName(shared)).select("run_id", "model", "resolved")


@query(", m as (select case when model in ('claude45', 'gpt5') then 'frontier' else model end as model, intent from steps) select model, intent, count(*) as n, count(*)::double / sum(count(*)) over (partition by model) as share from m group by 1, 2")
def merge_models(spark, sf_dir):
    groups = spark.createDataFrame([("claude45", "frontier"), ("gpt5", "frontier")], "model string, merged string")
    s = fixtures.labelled(spark, sf_dir).join(F.broadcast(groups), "model", "left").withColumn("model", F.coalesce("merged", "model"))
    return marts.intent_frequencies(s)


@query("select model, category, count(*) as n from steps group by grouping sets ((model, category), (category))")
def combined_summary(spark, sf_dir):
    return fixtures.labelled(spark, sf_dir).groupingSets([["model", "category"], ["category"]], "model", "category").agg(F.count("*").alias("n"))


@query("select category, intent, count(*) as n from steps where category in ('git', 'housekeeping') group by grouping sets ((category, intent), (category), ())")
def cleanup_decomposition(spark, sf_dir):
    return fixtures.labelled(spark, sf_dir).where("category in ('git', 'housekeeping')").rollup("category", "intent").agg(F.count("*").alias("n"))


@query("""select run_id, model, regexp_replace(repo, '^.*/', '') || case when run_id % 5 = 1 then '-' || left(md5(run_id::varchar), 6) else '' end as place from runs""")
def repo_of_instance(spark, sf_dir):
    """Repository names out of instance ids: with a commit, with a version behind it, with neither, and with too few hex digits for a commit."""
    run, place = F.col("run_id"), F.substring_index("repo", "/", -1)
    commit = F.left(F.md5(run.cast("string")), F.when(run % 5 == 1, 6).otherwise((run % 26 + 7).cast("int")))
    version = F.when((run % 3 == 0) & (run % 5 != 1), "-v1-0").otherwise("")
    instance = F.when(run % 5 == 0, place).otherwise(F.concat(place, F.lit("-"), commit, version))
    return fixtures.runs(spark, sf_dir).select("run_id", "model", repo_of(instance).alias("place"))


_SIGNED = dims.values_sql([(k, SIGNATURES.get(a, " ".join((a or "").split("\n")[0].lower().split())), GIT.get(a, "")) for k, (a, *_) in enumerate(STEPS)])


@query(f", sg(tpl, signature, git) as ({_SIGNED}) select run_id, step_idx, signature from steps join sg using (tpl)")
def command_signature(spark, sf_dir):
    return fixtures.steps(spark, sf_dir).select("run_id", "step_idx", signature_of(F.col("action")).alias("signature"))


@query(f", sg(tpl, signature, git) as ({_SIGNED}) select model, git, count(*) as n from steps join sg using (tpl) where git <> '' group by 1, 2")
def git_subcommand(spark, sf_dir):
    found = F.explode(F.array(subcommand_of(strip_wrappers(unwrap_command(F.col("action"))))))
    return fixtures.steps(spark, sf_dir).select("model", found.alias("git")).where("git <> ''").groupBy("model", "git").agg(F.count("*").alias("n"))
