"""Queries of the finer tables: bands, subtotals, combined and baseline marts, streamed marts, outcome files. Each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.outcomes import repo_of_task as task_repo
from ..operators import marts, pairing, sequences
from ..operators import sessions as S
from ..operators.labels import taxonomy
from ..sources import ingest
from ..streaming import marts as streamed
from . import fixtures
from . import run_queries as R
from . import session_queries as Q
from . import transcript_files as files

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str, base: str = fixtures.BASE_SQL):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = base + sql
        return f

    return keep


_in = R._LIST


@query(R.SEQ_SQL + f""", key(seq) as ({dims.values_sql([(k,) for k in dims.KEY_SEQUENCES])}), m as (select model, count(distinct run_id) as n_runs from seqs group by 1)
select m.model, key.seq, count(s.seq) as n, count(s.seq)::double / any_value(n_runs) as per_run from m cross join key left join seqs s on s.model = m.model and s.seq = key.seq group by 1, 2""")
def key_sequences(spark, sf_dir):
    return marts.labels_per_run(R.sequenced(spark, sf_dir), dims.KEY_SEQUENCES)


def _band_sql(bands: dict[str, list[str]]) -> str:
    rows = dims.values_sql([(k, band) for band, letters in bands.items() for k in letters])
    return R.PROFILE_SQL + f""", bd(letter, band) as ({rows}), bs as (select model, bin, band, sum(mean_share) as s from prof join bd using (letter) group by 1, 2, 3)
select model, bin, band, s / nullif(sum(s) over (partition by model, bin), 0) as share from bs"""


@query(_band_sql(dims.BANDS))
def phase_bands(spark, sf_dir):
    return marts.phase_bands(marts.phase_profile(fixtures.labelled(spark, sf_dir)), dims.BANDS)


@query(_band_sql({k: v for k, v in dims.SESSION_BANDS.items() if k != "git"}))
def phase_bands_without_git(spark, sf_dir):
    return marts.phase_bands(marts.phase_profile(fixtures.labelled(spark, sf_dir)), dims.SESSION_BANDS, without=("git",))


@query(f"""select model, count(mode) as n_failures, count(*) filter (mode in {_in(dims.WRAPPER_MODES)}) as n,
  count(*) filter (mode in {_in(dims.WRAPPER_MODES)})::double / nullif(count(mode), 0) as share from steps group by 1""")
def wrapper_failures(spark, sf_dir):
    return marts.mode_share(fixtures.failures(spark, sf_dir), dims.WRAPPER_MODES)


@query(R.PAIR_SQL + f""", ids as (select run_id_a as run_id from sub union all select run_id_b from sub),
la as (select run_id, model, max(step_idx) filter (intent in {_in(dims.SOURCE_EDIT_STEPS)}) as last, count(*) as n from steps where run_id in (select run_id from ids) group by 1, 2),
tl as (select model, n, n - 1 - last as after, last * 100.0::double / greatest(n - 1, 1) as spot from la where last is not null)
select model, count(*) as n, median(spot) as median, list(spot order by spot)[count(*) // 4 + 1] as p25, list(spot order by spot)[count(*) * 3 // 4 + 1] as p75, sum(after)::double / sum(n) as tail_share from tl group by 1""")
def post_edit_tail(spark, sf_dir):
    p = pairing.submitted(R.joined_pairs(spark, sf_dir))
    ids = p.select(F.explode(F.array("a.run_id", "b.run_id")).alias("run_id"))
    return marts.post_edit_tail(fixtures.labelled(spark, sf_dir), ids)


@query(f""", iv(intent) as ({dims.values_sql([(k,) for k in dims.INLINE_INTENTS])}), st as (select model, intent from steps where intent in (select intent from iv)),
c as (select model, intent, count(*) as n from st group by 1, 2 union all select null, intent, count(*) from st group by 2),
g as (select * from (select distinct model from c) m cross join iv)
select g.model, g.intent, coalesce(c.n, 0) as n, coalesce(c.n, 0)::double / sum(coalesce(c.n, 0)) over (partition by g.model) as share from g left join c on c.model is not distinct from g.model and c.intent = g.intent""")
def inline_snippets(spark, sf_dir):
    return marts.intents_among(fixtures.labelled(spark, sf_dir), dims.INLINE_INTENTS)


@query(""", c as (select model, category, intent, count(*) as n from steps group by grouping sets ((model, category, intent), (model, category), (model)))
select category, intent, model, n, n * 100.0::double / max(n) over (partition by model) as pct from c""")
def classification_table(spark, sf_dir):
    return marts.classification_table(fixtures.labelled(spark, sf_dir))


@query(R.PROFILE_SQL.replace("select *, count(*) over (partition by run_id) as n from steps", "select * replace ('all' as model), count(*) over (partition by run_id) as n from steps") + "select model, bin, letter, mean_share from prof")
def combined_profile(spark, sf_dir):
    return marts.phase_profile(marts.all_models(fixtures.labelled(spark, sf_dir)))


_MARKS = """, mk as (select model, 'first_edit' as marker, first_edit as spot from pos union all select model, 'last_edit', last_edit from pos),
em as (select model, marker, count(spot) as n, median(spot) as median, list(spot order by spot)[count(*) // 4 + 1] as p25, list(spot order by spot)[count(*) * 3 // 4 + 1] as p75 from mk where spot is not null group by 1, 2)
"""


@query(R.POS_SQL + _MARKS.replace("select model, 'first", "select 'all' as model, 'first").replace("select model, 'last", "select 'all', 'last") + """select em.*, (select count(*) from runs) as n_runs,
  (select count(*) filter (resolved) * 100.0::double / count(*) from runs) as resolve_rate from em""")
def combined_markers(spark, sf_dir):
    """First and last edits over the runs of all models, with how many there are and how many are resolved."""
    runs = fixtures.runs(spark, sf_dir).agg(F.count("*").alias("n_runs"), (marts.count_if(F.col("resolved")) * 100.0 / F.count("*")).alias("resolve_rate"))
    marks = marts.edit_markers(sequences.positions(marts.all_models(fixtures.labelled(spark, sf_dir))))
    return marks.crossJoin(F.broadcast(runs))  # one row


@query("""select run_id, case when run_id % 11 = 0 then 'unknown/unknown' else split_part(repo, '/', 1) || '/' || split_part(repo, '/', 2) || case when run_id % 3 = 0 then '-web' else '' end
    || case when run_id % 5 = 1 then '-' || left(md5(run_id::varchar), 6) else '' end end as place, case when run_id % 11 = 0 then '' else repo end as plain_place from runs""")
def repo_of_task(spark, sf_dir):
    """Organisation and repository out of task ids by both readings: with and without a prefix, a commit, a version, hyphens."""
    run, parts = F.col("run_id"), F.split("repo", "/")
    commit = F.left(F.md5(run.cast("string")), F.when(run % 5 == 1, 6).otherwise((run % 26 + 7).cast("int")))
    version = F.when((run % 3 == 0) & (run % 5 != 1), "-v1-0").otherwise("")
    task = F.concat(
        F.when(run % 4 != 0, "instance_").otherwise(""), parts[0], F.when(run % 11 == 0, "_").otherwise("__"), parts[1], F.when(run % 3 == 0, "-web").otherwise(""),
        F.when(run % 5 == 0, "").otherwise(F.concat(F.lit("-"), commit, version)),
    )
    return fixtures.runs(spark, sf_dir).select("run_id", task_repo(task).alias("place"), task_repo(task, with_commit=True).alias("plain_place"))


def session_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calls of sessions of one model as the steps of runs, with the session as run."""
    own = S.session_models(Q.model_names(spark, sf_dir)).where("single").select("session", "model")
    c = Q.labelled_calls(spark, sf_dir).join(own, "session").join(F.broadcast(taxonomy(spark, session=True)), "intent")  # a row per intent
    order = Window.partitionBy("session").orderBy("turn", "j")
    return c.select(F.col("session").alias("run_id"), "model", (F.row_number().over(order) - 1).alias("step_idx"), "intent", "category", "letter", F.lit("").alias("outcome"))


_SESSION_STEPS = """, ss as (
  select c.session as run_id, model, step_idx, intent, category, letter, '' as outcome
  from (select session, row_number() over (partition by session order by turn, j) - 1 as step_idx, case when m = 0 then intent_none else intent end as intent from calls) c
  join (select session, model from info where single) i using (session) join tax using (intent)),
bl(model, baseline) as (""" + dims.values_sql(list(Q.BASELINES.items())) + ")\n"


_POSITIONS = lambda x, steps: f""", pos{x} as (
  select run_id, model, min(step_idx) filter (category = 'edit') * 100.0::double / greatest(count(*) - 1, 1) as first_edit, max(step_idx) filter (category = 'edit') * 100.0::double / greatest(count(*) - 1, 1) as last_edit
  from {steps} group by 1, 2),
mk{x} as (select model, 'first_edit' as marker, first_edit as spot from pos{x} union all select model, 'last_edit', last_edit from pos{x}),
em{x} as (select model, marker, count(*) as n, median(spot) as median, list(spot order by spot)[count(*) // 4 + 1] as p25, list(spot order by spot)[count(*) * 3 // 4 + 1] as p75 from mk{x} where spot is not null group by 1, 2)
"""  # noqa: E731
_PROFILE = lambda x, steps, tax: f""", b{x} as (select model, run_id, letter, (20 * (step_idx + 1) + n - 1) // n - 1 as bin from (select *, count(*) over (partition by run_id) as n from {steps}) where n >= 5),
k{x} as (select model, run_id, bin, letter, count(*)::double / sum(count(*)) over (partition by run_id, bin) as s from b{x} group by 1, 2, 3, 4),
g{x} as (select m.model, m.n_runs, g.bin, t.letter from (select model, count(distinct run_id) as n_runs from b{x} group by 1) m, (select range as bin from range(20)) g, (select distinct letter from {tax}) t),
p{x} as (select g{x}.model, g{x}.bin, g{x}.letter, coalesce(sum(s), 0) / any_value(n_runs) as mean_share
  from g{x} left join k{x} on k{x}.model = g{x}.model and k{x}.bin = g{x}.bin and k{x}.letter = g{x}.letter group by 1, 2, 3)
"""  # noqa: E731


@query(_SESSION_STEPS + _POSITIONS("1", "ss") + _POSITIONS("2", "st") + """select baseline, a.marker, a.model, a.n, a.median, a.p25, a.p75, b.n as base_n, b.median as base_median, b.p25 as base_p25, b.p75 as base_p75
from em1 a join bl using (model) left join em2 b on b.model = baseline and b.marker = a.marker""", Q._run_sql(""))
def baseline_markers(spark, sf_dir):
    """Where first and last edits are in sessions, beside the runs of the model that each session model is compared with."""
    marks = lambda steps: marts.edit_markers(sequences.positions(steps))
    return S.beside_baseline(marks(session_steps(spark, sf_dir)), marks(fixtures.labelled(spark, sf_dir)), Q.BASELINES, ["marker"])


@query(_SESSION_STEPS + _PROFILE("1", "ss", "tax") + _PROFILE("2", "st", "rtax") + """select baseline, a.bin, a.letter, a.model, a.mean_share, b.mean_share as base_mean_share
from p1 a join bl using (model) left join p2 b on b.model = baseline and b.bin = a.bin and b.letter = a.letter""", Q._run_sql(""))
def baseline_profile(spark, sf_dir):
    """The shape of sessions, letters by progress, beside the shape of the runs they are compared with."""
    return S.beside_baseline(marts.phase_profile(session_steps(spark, sf_dir)), marts.phase_profile(fixtures.labelled(spark, sf_dir)), Q.BASELINES, ["bin", "letter"])


def stream_sessions(spark: SparkSession, sf_dir: str) -> str:
    """Marts streamed from the transcripts in two goes, a third of the sessions first; their path."""
    path = files.shared_path(spark, "stream")
    lines = files.transcript_rows(spark, sf_dir)

    def steps(session: SparkSession, paths: list[str], pattern: str) -> DataFrame:
        return streamed.label_events(files.read_packed(session, paths))

    for part in ("session % 3 = 1", "session % 3 <> 1"):
        files.write_lines(lines.where(part), f"{path}/files")
        streamed.stream_marts(spark, f"{path}/files", path, pattern="*.txt", steps=steps)
    return path


_STREAM = """, l as (select session, (array['claude-opus-4-6', 'claude-sonnet-4-5', 'gpt-5.4', 'gemini-2.5-pro', 'glm-4.5'])[session % 5 + 1] as model, case when m = 0 then intent_none else intent end as intent from calls)
"""


@query(_STREAM + "select model, intent, count(*) as n, count(distinct session) as n_runs from l group by 1, 2", Q.BASE_SQL)
def streamed_intents(spark, sf_dir):
    return streamed.read_streamed(spark, stream_sessions(spark, sf_dir), "intents")


@query(_STREAM + "select model, phase, count(*) as n from l join tax using (intent) group by 1, 2", Q.BASE_SQL)
def streamed_phases(spark, sf_dir):
    return streamed.read_streamed(spark, stream_sessions(spark, sf_dir), "phases")
