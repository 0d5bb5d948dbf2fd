"""Queries over session transcripts derived from the conversations, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.sessions import issue_keys as keys_of
from ..functions.sessions import normalize_model as normalised
from ..functions.sessions import with_tool_intent
from ..operators import marts
from ..operators import sessions as S
from ..operators.labels import taxonomy
from .fixtures import table
from .templates import MESSAGES, NO_RESULT, TOOLS

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
RAW_MODELS = ["global.anthropic.claude-opus-4.6", "us.anthropic.claude-sonnet-4.5", "gpt-5.4", "gemini-2.5-pro", "glm-4.5"]
MODELS = ["claude-opus-4-6", "claude-sonnet-4-5", "gpt-5.4", "gemini-2.5-pro", "glm-4.5"]
ISSUES = "https://github.com/o/r/issues/"


def _element(values: list[str], index):
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "session")


def name_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session, line_no, name): a draft name comes first in some sessions, an empty one last in others."""
    one, s = turns(spark, sf_dir).select("session").distinct(), F.col("session")
    kind = F.when(s % 3 == 1, "Issue: ").otherwise("PR: ")
    name = F.when(s % 3 == 0, "").otherwise(F.concat(kind, F.lit(ISSUES), (s % 28).cast("string")))
    draft = one.where("session % 5 = 0 and session % 3 <> 0").select("session", F.lit(0).alias("line_no"), F.concat(F.lit("Draft "), s.cast("string")).alias("name"))
    emptied = one.where("session % 2 = 0").select("session", F.lit(2).alias("line_no"), F.when(s % 4 == 0, "").alias("name"))
    return draft.unionByName(one.select("session", F.lit(1).alias("line_no"), name.alias("name"))).unionByName(emptied)


def session_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session, name): one row per session, with its last name that isn't empty."""
    return S.session_names(name_events(spark, sf_dir)).select("session", F.col("last_name").alias("name"))


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session, turn, stop_reason): one row per assistant turn; some have an empty reason or none."""
    reason = F.get(F.array(F.lit("length"), F.lit("stop"), F.lit(None), F.lit("")), ((F.col("session") + F.col("turn")) % 4).cast("int"))
    return turns(spark, sf_dir).where("role = 'assistant'").select("session", "turn", reason.alias("stop_reason"))


def model_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session, line_no, model): raw model names in order; every eleventh session has a second one."""
    one = turns(spark, sf_dir).select("session").distinct()
    first = one.select("session", F.lit(0).alias("line_no"), _element(RAW_MODELS, F.col("session") % 5).alias("model"))
    second = one.where("session % 11 = 0").select("session", F.lit(1).alias("line_no"), F.lit("gpt-5.4-mini").alias("model"))
    return first.unionByName(second).withColumn("model", normalised(F.col("model")))


def user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session, turn, text): a template, in front of it being what tells its class, then a link in some, then the turn's own text."""
    t = turns(spark, sf_dir).where("role = 'user'")
    said = spark.createDataFrame([(k, m[0]) for k, m in enumerate(MESSAGES)], "mt int, said string")
    t = t.withColumn("mt", ((F.col("session") * 7 + F.col("turn")) % len(MESSAGES)).cast("int")).join(F.broadcast(said), "mt")
    first = F.min("turn").over(S.Window.partitionBy("session")) == F.col("turn")
    link = F.when(first & (F.col("session") % 6 == 0), F.concat(F.lit(" " + ISSUES), ((F.col("session") + 1) % 28).cast("string"))).otherwise("")
    return t.select("session", "turn", F.concat("said", link, F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"))


CALL_FIELDS = "tt int, name string, path string, command string, pattern string, has_range boolean, old_text string"


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls of the assistant turns: session, turn, j, call_id and the template's fields."""
    t = turns(spark, sf_dir).where("role = 'assistant'").select("session", "turn", F.explode(F.sequence(F.lit(0), F.length(F.coalesce("text", F.lit(""))) % 4)).alias("j"))
    t = t.withColumn("tt", ((F.col("session") + 3 * F.col("turn") + F.col("j")) % len(TOOLS)).cast("int")).withColumn("call_id", F.concat_ws("-", "session", "turn", "j"))
    return t.join(F.broadcast(spark.createDataFrame([(k, *r[:6]) for k, r in enumerate(TOOLS)], CALL_FIELDS)), "tt")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of the calls: none for some, a second and opposite one for others."""
    own = spark.createDataFrame([(k, r[7], r[6]) for k, r in enumerate(TOOLS)], "tt int, result string, is_error boolean")
    c = calls(spark, sf_dir).select("session", "turn", "j", "call_id", "tt").join(F.broadcast(own), "tt").withColumn("m", (F.col("session") + F.col("turn") + F.col("j")) % 13)
    first = c.where("m <> 0").select("session", "call_id", F.lit(0).alias("line_no"), "result", "is_error")
    again = c.where("m = 1").select("session", "call_id", F.lit(1).alias("line_no"), F.lit("second").alias("result"), (~F.col("is_error")).alias("is_error"))
    return first.unionByName(again)


def session_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_info(spark, sf_dir).join(S.session_models(model_names(spark, sf_dir)), "session")


def first_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_turns(spark, sf_dir).groupBy("session").agg(F.min_by("text", "turn").alias("first_text"))


def bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session, key): issues that sessions refer to."""
    s = session_info(spark, sf_dir).join(first_text(spark, sf_dir), "session", "left")
    return s.select("session", F.explode(keys_of(F.col("name"), F.col("first_text"))).alias("key"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = S.with_result(calls(spark, sf_dir), results(spark, sf_dir), last=True)
    order = S.Window.partitionBy("session").orderBy("turn")
    return S.ship_signals(done, user_turns(spark, sf_dir).withColumn("message_index", F.row_number().over(order)))


def labelled_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = S.messages(user_turns(spark, sf_dir), calls(spark, sf_dir))
    return m.join(S.session_models(model_names(spark, sf_dir)).where("single").select("session", "model"), "session")


def labelled_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_tool_intent(S.with_result(calls(spark, sf_dir), results(spark, sf_dir)))


def _tools() -> list[tuple]:
    """(tt, name, command, is_error, result, intent, intent without a result, path)"""
    return [(k, r[0], r[2], r[6], r[7], r[8], NO_RESULT.get((r[0], r[1], r[2], r[6]), r[8]), r[1]) for k, r in enumerate(TOOLS)]


BASE_SQL = f"""with tools(tt, name, command, bad, result, intent, intent_none, path) as ({dims.values_sql(_tools())}),
said(mt, text, first_class, later_class) as ({dims.values_sql([(k, *m) for k, m in enumerate(MESSAGES)])}),
tax(intent, category, letter, phase) as ({dims.values_sql(dims.taxonomy(True))}),
info as (
  select conv_id as session, case when conv_id % 3 = 0 then '' else case conv_id % 3 when 1 then 'Issue: ' else 'PR: ' end || '{ISSUES}' || (conv_id % 28) end as name,
         conv_id % 11 <> 0 as single,
         case when conv_id % 11 <> 0 then (array['claude-opus-4-6', 'claude-sonnet-4-5', 'gpt-5.4', 'gemini-2.5-pro', 'glm-4.5'])[conv_id % 5 + 1] end as model
  from (select distinct conv_id from conversations)),
calls as (
  select conv_id as session, turn, j, conv_id || '-' || turn || '-' || j as call_id, (conv_id + turn + j) % 13 as m, t.*
  from (select conv_id, turn, unnest(range(0, length(coalesce(text, '')) % 4 + 1)) as j from conversations where role = 'assistant') c
  join tools t on t.tt = (c.conv_id + 3 * c.turn + c.j) % {len(TOOLS)}),
um as (
  select conv_id as session, turn, row_number() over (partition by conv_id order by turn) as message_index, mt, body
  from (select conv_id, turn, coalesce(text, '') as body, (conv_id * 7 + turn) % {len(MESSAGES)} as mt from conversations where role = 'user')),
spoken as (
  select um.*, first_class, later_class, said.text || case when message_index = 1 and session % 6 = 0 then ' {ISSUES}' || ((session + 1) % 28) else '' end || ' ' || body as text
  from um join said using (mt)),
msgs as (
  select um.session, um.turn, um.message_index, um.text,
         case when (case when message_index = 1 then first_class else later_class end) = 'authorize_work' and length(trim(regexp_replace(um.text, '\\s+', ' ', 'g'))) > 220
                and regexp_matches(lower(um.text), 'should|instead|@packages/|model selector|wraps the|use ') then 'solution_steer'
              when message_index = 1 then first_class else later_class end as class,
         coalesce((select count(*) from calls c where c.session = um.session and c.turn < um.turn), 0) as steps_before,
         coalesce((select count(*) from calls c where c.session = um.session), 0) as total_steps
  from spoken um),
mm as (
  select msgs.*, info.model, case when total_steps > 0 then steps_before * 100.0::double / total_steps else 0 end as progress
  from msgs join info using (session) where single),
bridge as (
  select distinct session, cast(session % 28 as varchar) as key from info where name <> ''
  union select session, cast((session + 1) % 28 as varchar) from um where message_index = 1 and session % 6 = 0),
users as (
  select session, count(*) as n_user, arg_max(text, message_index) as last_text from msgs group by 1),
acts as (
  select session,
    bool_or(coalesce(contains(command, 'git push'), false) and ok and not (m <> 0 and contains(result, 'rejected'))) as pushed,
    bool_or(coalesce(contains(command, 'gh issue close'), false) and ok) as closed, bool_or(coalesce(contains(command, 'gh pr merge'), false) and ok) as merged,
    bool_or(coalesce(contains(command, 'gh issue close'), false)) as close_called, bool_or(coalesce(contains(command, 'gh pr merge'), false)) as merge_called,
    bool_or(coalesce(contains(command, 'gh issue comment'), false) and ok) as commented, bool_or(coalesce(contains(command, 'git commit'), false)) as committed,
    bool_or(coalesce(contains(command, 'git commit'), false) and ok) as commit_ok,
    bool_or(name in ('edit', 'write') and path in ('/r/demo.ts', '/r/check.ts', '/r/new.ts', '/r/a.ts', '/r/a.spec.ts', '/r/verify.ts')) as source_edit
  from (select *, case when m = 0 then true when m = 1 then bad else not bad end as ok from calls) group by 1),
sig as (
  select info.session, coalesce(n_user, 0) as n_user, coalesce(pushed, false) as pushed, coalesce(closed, false) as closed, coalesce(merged, false) as merged, coalesce(close_called, false) as close_called, coalesce(merge_called, false) as merge_called, coalesce(commented, false) as commented,
    coalesce(committed, false) as committed, coalesce(commit_ok, false) as commit_ok, coalesce(source_edit, false) as source_edit, false as any_close, false as last_close,
    coalesce(n_user >= 2 and (contains(last_text, 'commit and push') or contains(last_text, 'lgtm')), false) as last_closeout,
    coalesce(n_user >= 2 and (contains(last_text, 'brittle') or contains(last_text, 'we established that')), false) as last_blame
  from info left join users using (session) left join acts using (session) where users.session is not null or acts.session is not null),
kinds as (select *, case when pushed then 'push' when merged then 'gh_merge' when closed then 'gh_close' when commented and any_close then 'gh_comment' when last_close then 'user_close' else '' end as kind from sig),
ship as (select info.session, info.model, coalesce(pushed or close_called or merge_called, false) as shipped from info left join sig using (session) where single)
"""


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = BASE_SQL + sql
        return f

    return keep


@query("select session, turn, j, name, coalesce(command, '') as command, path from calls")
def tool_calls(spark, sf_dir):
    return calls(spark, sf_dir).select("session", "turn", "j", "name", F.coalesce("command", F.lit("")).alias("command"), "path")


@query("""select session, call_id, case when m = 0 then '' else result end as first_result, case when m = 0 then false else bad end as first_error,
  case m when 0 then '' when 1 then 'second' else result end as last_result, case m when 0 then false when 1 then not bad else bad end as last_error from calls""")
def toolcall_results(spark, sf_dir):
    c, r = calls(spark, sf_dir), results(spark, sf_dir)
    first = S.with_result(c, r).select("session", "call_id", F.col("result").alias("first_result"), F.col("is_error").alias("first_error"))
    last = S.with_result(c, r, last=True).select("session", "call_id", F.col("result").alias("last_result"), F.col("is_error").alias("last_error"))
    return first.join(last, ["session", "call_id"])


@query("select session, call_id, case when m = 0 then intent_none else intent end as intent from calls")
def toolcall_intent(spark, sf_dir):
    return labelled_calls(spark, sf_dir).select("session", "call_id", "intent")


@query("select intent, count(*) as n from calls where starts_with(intent, 'git-') group by 1")
def git_intent(spark, sf_dir):
    return labelled_calls(spark, sf_dir).where("intent like 'git-%'").groupBy("intent").agg(F.count("*").alias("n"))


@query(", l as (select i.model, case when m = 0 then intent_none else calls.intent end as intent from calls join info i using (session) where single) select model, category, count(*) as n, count(*)::double / sum(count(*)) over (partition by model) as share from l join tax using (intent) group by 1, 2")
def session_categories(spark, sf_dir):
    own = S.session_models(model_names(spark, sf_dir)).where("single").select("session", "model")
    tax = taxonomy(spark, session=True)
    c = labelled_calls(spark, sf_dir).join(own, "session").join(F.broadcast(tax), "intent")
    return c.groupBy("model", "category").agg(F.count("*").alias("n")).withColumn("share", marts.share("n", "model"))


@query("select session, coalesce(model, (array['claude-opus-4-6', 'claude-sonnet-4-5', 'gpt-5.4', 'gemini-2.5-pro', 'glm-4.5'])[session % 5 + 1] || ',gpt-5.4-mini') as models, single, model from info")
def session_models(spark, sf_dir):
    return S.session_models(model_names(spark, sf_dir))


@query("select session, case when single then model else (array['claude-opus-4-6', 'claude-sonnet-4-5', 'gpt-5.4', 'gemini-2.5-pro', 'glm-4.5'])[session % 5 + 1] end as model from info")
def normalize_model(spark, sf_dir):
    return model_names(spark, sf_dir).where("line_no = 0").select("session", "model")


@query("select session, model from info where single and model in ('gpt-5.4', 'glm-4.5') and starts_with(lower(name), 'issue:')")
def session_filter(spark, sf_dir):
    s = session_table(spark, sf_dir)
    return s.where(S.selected(s, ["gpt-5.4", "glm-4.5"], ["Issue:"])).select("session", "model")


@query("select count(*) as n_all, count(*) filter (single and starts_with(lower(name), 'issue:')) as n_selected, count(*) filter (not (single and starts_with(lower(name), 'issue:'))) as n_left_out from info")
def filtered_sessions(spark, sf_dir):
    s = session_table(spark, sf_dir)
    own = s.where(S.selected(s, MODELS, ["issue:"])).select("session").withColumn("chosen", F.lit(True))
    joined = s.join(own, "session", "left")
    return joined.agg(F.count("*").alias("n_all"), F.count("chosen").alias("n_selected"), marts.count_if(F.col("chosen").isNull()).alias("n_left_out"))


@query("""select info.session, coalesce(last_reason = 'stop', false) or coalesce(f, false) as completed from info
left join (select conv_id as session, arg_max(reason, turn) as last_reason
  from (select conv_id, turn, (array['length', 'stop', null, ''])[(conv_id + turn) % 4 + 1] as reason from conversations where role = 'assistant') where reason <> '' group by 1) using (session)
left join (select session, bool_or(name = 'finish_and_exit') as f from calls group by 1) c using (session)""")
def session_completion(spark, sf_dir):
    return S.completion(session_info(spark, sf_dir), stops(spark, sf_dir), calls(spark, sf_dir))


@query("""select info.session, case when info.session % 5 = 0 and info.session % 3 <> 0 then 'Draft ' || info.session else name end as first_name, name as last_name, text as first_text from info
left join (select session, text from msgs where message_index = 1) m using (session)""")
def session_names(spark, sf_dir):
    return S.session_names(name_events(spark, sf_dir)).join(first_text(spark, sf_dir), "session", "left")


@query("select session, turn, message_index, class from mm")
def user_message_class(spark, sf_dir):
    return labelled_messages(spark, sf_dir).select("session", "turn", "message_index", "class")


@query("select session, message_index, steps_before, total_steps, progress, least(19, floor(progress / 5))::bigint as bin from mm")
def user_message_progress(spark, sf_dir):
    return labelled_messages(spark, sf_dir).select("session", "message_index", "steps_before", "total_steps", "progress", "bin")


@query("select class, model, session, message_index, progress, text from mm")
def user_message_listing(spark, sf_dir):
    return labelled_messages(spark, sf_dir).select("class", "model", "session", "message_index", "progress", "text").orderBy("class", "model", "session", "message_index")


_EXCLUSIVE = lambda q: f"case when count(*) = 1 then min(v) else (list(v order by v)[greatest(1, least({q} * (count(*) + 1) // 4, count(*) - 1))] * (4 - ({q} * (count(*) + 1) - 4 * greatest(1, least({q} * (count(*) + 1) // 4, count(*) - 1)))) + list(v order by v)[greatest(1, least({q} * (count(*) + 1) // 4, count(*) - 1)) + 1] * ({q} * (count(*) + 1) - 4 * greatest(1, least({q} * (count(*) + 1) // 4, count(*) - 1)))) / 4 end"
_FIRST = lambda key, source: f"""first as (select session, model, {key} as key, arg_min(progress, message_index) as v from {source} group by 1, 2, 3),
sp as (
  select model, key, median(v) as median, {_EXCLUSIVE(1)} as p25, {_EXCLUSIVE(3)} as p75 from first group by 1, 2
  union all select null, key, median(v), {_EXCLUSIVE(1)}, {_EXCLUSIVE(3)} from first group by 2),
cn as (
  select model, {key} as key, count(*) as n_messages, count(distinct session) as n_sessions from {source} group by 1, 2
  union all select null, {key}, count(*), count(distinct session) from {source} group by 2),
al as (select model, count(*) as am, count(distinct session) as asn from {source} group by 1 union all select null, count(*), count(distinct session) from {source})
select cn.model, cn.key as {key}, n_messages, n_sessions, n_messages::double / am as message_share, n_sessions::double / asn as session_share, median, p25, p75
from cn join al on al.model is not distinct from cn.model join sp on sp.model is not distinct from cn.model and sp.key = cn.key"""  # noqa: E731


@query(", " + _FIRST("class", "mm"))
def user_message_stats(spark, sf_dir):
    return S.message_stats(labelled_messages(spark, sf_dir))


@query("select class, least(19, floor(progress / 5))::bigint as bin, count(distinct session) as n_sessions, count(distinct session)::double / (select count(distinct session) from mm) as share from mm group by 1, 2")
def user_message_timing(spark, sf_dir):
    return S.message_timing(labelled_messages(spark, sf_dir))


@query(", mac as (select *, case class when 'authorize_work' then 'authorization' when 'workflow_closeout' then 'closeout' else 'steering' end as macro from mm where class <> 'task_brief'), " + _FIRST("macro", "mac"))
def intervention_markers(spark, sf_dir):
    return S.macro_stats(labelled_messages(spark, sf_dir), S.MACROS)


@query(", mac as (select *, case class when 'task_brief' then 'analysis_start' when 'authorize_work' then 'work_start' when 'workflow_closeout' then 'workflow_closeout' else 'solution_steering' end as macro from mm), " + _FIRST("macro", "mac"))
def intervention_starts(spark, sf_dir):
    return S.macro_stats(labelled_messages(spark, sf_dir), S.START_MACROS)


@query("select session, key from bridge")
def issue_keys(spark, sf_dir):
    return bridge(spark, sf_dir)


@query("select session, n_user, pushed, closed, merged, close_called, merge_called, commented, committed, commit_ok, any_close, last_close, last_closeout, last_blame, source_edit from sig")
def ship_signals(spark, sf_dir):
    return signals(spark, sf_dir)


@query("select session, kind from kinds")
def resolution_kind(spark, sf_dir):
    return signals(spark, sf_dir).select("session", S.resolution_kind().alias("kind"))


@query("""select session, case when n_user <= 1 then 'failure' when not source_edit and not committed then 'failure' when (pushed or close_called or merge_called) and last_blame then 'ambiguous'
  when pushed or close_called or merge_called then 'success' when commit_ok and last_closeout then 'ambiguous' else 'failure' end as label from sig""")
def session_success(spark, sf_dir):
    return signals(spark, sf_dir).select("session", S.success_label().alias("label"))


@query(", l as (select model, case when n_user <= 1 then 'failure' when not source_edit and not committed then 'failure' when (pushed or close_called or merge_called) and last_blame then 'ambiguous' when pushed or close_called or merge_called then 'success' when commit_ok and last_closeout then 'ambiguous' else 'failure' end as label from sig join info using (session) where single) select model, label, count(*) as n from l group by grouping sets ((model, label), (label))")
def session_success_counts(spark, sf_dir):
    own = S.session_models(model_names(spark, sf_dir)).where("single").select("session", "model")
    rows = signals(spark, sf_dir).select("session", S.success_label().alias("label")).join(own, "session")
    return rows.groupingSets([["model", "label"], ["label"]], "model", "label").agg(F.count("*").alias("n"))


def chosen_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session_table(spark, sf_dir).where("single")
    kinds = signals(spark, sf_dir).select("session", S.resolution_kind().alias("kind"))
    return s.withColumn("chosen", S.selected(s, MODELS, ["issue:"])).join(kinds, "session", "left").select("session", "model", "chosen", F.coalesce("kind", F.lit("")).alias("kind"))


@query(""", c as (select info.session, info.model, starts_with(lower(name), 'issue:') as chosen, coalesce(kind, '') as kind from info left join kinds using (session) where single),
att as (select distinct model, key from c join bridge using (session) where chosen), won as (select distinct model, key from c join bridge using (session) where kind <> '')
select model, count(*) as n_sessions, count(*) filter (kind = 'push') as n_push, count(*) filter (kind = 'gh_merge') as n_gh_merge, count(*) filter (kind = 'gh_close') as n_gh_close,
  count(*) filter (kind = 'gh_comment') as n_gh_comment, count(*) filter (kind = 'user_close') as n_user_close,
  (select count(*) from att where att.model = c.model) as n_attempted, (select count(*) from att join won using (model, key) where att.model = c.model) as n_resolved
from c where chosen group by model""")
def issue_resolution(spark, sf_dir):
    return S.issue_resolution(chosen_sessions(spark, sf_dir), bridge(spark, sf_dir))


@query(""", c as (select info.session, info.model, starts_with(lower(name), 'issue:') as chosen, coalesce(kind, '') as kind from info left join kinds using (session) where single),
att as (select distinct model, key from c join bridge using (session) where chosen), won as (select distinct model, key from c join bridge using (session) where kind <> ''),
m as (select model, count(*) as n_sessions, count(*) filter (kind = 'push') as n_push, count(*) filter (kind = 'gh_merge') as n_gh_merge, count(*) filter (kind = 'gh_close') as n_gh_close,
  count(*) filter (kind = 'gh_comment') as n_gh_comment, count(*) filter (kind = 'user_close') as n_user_close,
  (select count(*) from att where att.model = c.model) as n_attempted, (select count(*) from att join won using (model, key) where att.model = c.model) as n_resolved
  from c where chosen group by model),
t as (select * from m union all select null, sum(n_sessions), sum(n_push), sum(n_gh_merge), sum(n_gh_close), sum(n_gh_comment), sum(n_user_close), sum(n_attempted), sum(n_resolved) from m)
select model, cast(n_sessions as bigint) as n_sessions, cast(n_push as bigint) as n_push, cast(n_gh_merge as bigint) as n_gh_merge, cast(n_gh_close as bigint) as n_gh_close, cast(n_gh_comment as bigint) as n_gh_comment,
  cast(n_user_close as bigint) as n_user_close, cast(n_attempted as bigint) as n_attempted, cast(n_resolved as bigint) as n_resolved,
  case when n_attempted > 0 then n_resolved * 100.0::double / n_attempted else 0 end as rate from t""")
def issue_totals(spark, sf_dir):
    return S.with_issue_totals(S.issue_resolution(chosen_sessions(spark, sf_dir), bridge(spark, sf_dir)))


def shipped_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session_table(spark, sf_dir).where("single").select("session", "model")
    sig = signals(spark, sf_dir).select("session", S.shipped().alias("shipped"))
    return s.join(sig, "session", "left").select("session", "model", F.coalesce("shipped", F.lit(False)).alias("shipped"))


RESCUE = ", won as (select distinct model, key from ship join bridge using (session) where shipped), resc as (select s.session, s.model, s.shipped, not s.shipped and exists (select 1 from bridge b join won w on w.key = b.key where b.session = s.session and w.model = s.model) as rescued from ship s)\n"


@query(RESCUE + "select * from resc")
def peer_rescue(spark, sf_dir):
    return S.peer_rescue(shipped_sessions(spark, sf_dir), bridge(spark, sf_dir))


@query(RESCUE + """select 'session' as scheme, model, count(*) as n, count(*) filter (shipped) as n_shipped from resc group by 2
union all select 'rescue', model, count(*), count(*) filter (shipped or rescued) from resc group by 2
union all select 'issue', model, count(*), count(*) filter (w) from (select distinct s.model, b.key, won.key is not null as w from ship s join bridge b using (session) left join won on won.model = s.model and won.key = b.key) group by 2""")
def resolution_schemes(spark, sf_dir):
    ship, links = shipped_sessions(spark, sf_dir), bridge(spark, sf_dir)
    r = S.peer_rescue(ship, links)
    count = lambda df, scheme, won: df.groupBy("model").agg(F.count("*").alias("n"), marts.count_if(won).alias("n_shipped")).select(F.lit(scheme).alias("scheme"), "model", "n", "n_shipped")
    issues = links.join(ship, "session").select("model", "key").distinct().join(S.resolved_issues(ship, links).withColumn("w", F.lit(True)), ["model", "key"], "left")
    return count(r, "session", F.col("shipped")).unionByName(count(r, "rescue", F.col("shipped") | F.col("rescued"))).unionByName(count(issues, "issue", F.col("w")))


@query(""", w as (select session, single, model, case when starts_with(lower(name), 'pr:') then 'pr' when starts_with(lower(name), 'issue:') then 'issue' else 'other' end as prefix from info),
pp as (select distinct b.session, o.session as peer from bridge b join bridge o on b.key = o.key and b.session <> o.session),
j as (select w.session, w.model, count(q.session) as peers, count(*) filter (q.model = w.model) as same, count(*) filter (q.model <> w.model) as diff,
    count(*) filter (q.prefix = 'pr') as pr, count(*) filter (q.prefix = 'other') as other
  from w left join pp on pp.session = w.session left join w q on q.session = pp.peer
  where w.single and w.session in (select session from bridge) group by 1, 2)
select model, count(*) filter (peers = 0) as no_peer, cast(sum(same) as bigint) as same_model, cast(sum(diff) as bigint) as other_model,
  cast(sum(pr) as bigint) as pr_peers, cast(sum(other) as bigint) as other_peers from j group by model""")
def peer_landscape(spark, sf_dir):
    low = F.lower("name")
    prefix = F.when(low.startswith("pr:"), "pr").when(low.startswith("issue:"), "issue").otherwise("other")
    return S.peer_landscape(session_table(spark, sf_dir).select("session", "model", prefix.alias("prefix")), bridge(spark, sf_dir))


COMPARED = """, sa as (select intent, model, 100.0::double * count(*) / sum(count(*)) over (partition by model) as p from st group by 1, 2),
a as (select intent, max(p) filter (model = 'claude45') as claude45, max(p) filter (model = 'gpt5') as gpt5 from sa where model in ('claude45', 'gpt5') group by 1),
b as (select i.model, case when m = 0 then intent_none else calls.intent end as intent from calls join info i using (session) where single),
sb as (select intent, model, 100.0::double * count(*) / sum(count(*)) over (partition by model) as p from b group by 1, 2),
c as (select intent, max(p) filter (model = 'gpt-5.4') as gpt_5_4, max(p) filter (model = 'claude-opus-4-6') as claude_opus_4_6 from sb
  where model in ('gpt-5.4', 'claude-opus-4-6') group by 1)
"""


def _run_sql(sql: str) -> str:
    """The sessions' common table expressions, with the labelled steps of the runs as ``st``."""
    from .fixtures import BASE_SQL as RUNS

    runs = RUNS.replace("with recursive ", ", ").replace("tax(intent, category, letter, phase) as", "rtax(intent, category, letter, phase) as").replace("join tax using", "join rtax using").replace("\nsteps as (", "\nst as (")
    return BASE_SQL.rstrip() + runs + sql


@query()
def intent_comparison_4way(spark, sf_dir):
    """Intents of two run models and two session models per 100 steps of each, side by side, with where each is shown."""
    from .fixtures import labelled

    def rates(steps, models):
        n = steps.where(F.col("model").isin(*models)).groupBy("intent", "model").agg(F.count("*").alias("n"))
        rate = n.withColumn("p", F.col("n") * 100.0 / F.sum("n").over(S.Window.partitionBy("model")))
        return rate.groupBy("intent").agg(*[F.max(F.when(F.col("model") == m, F.col("p"))).alias(name) for m, name in models.items()], F.lit(True).alias("shown"))

    own = S.session_models(model_names(spark, sf_dir)).where("single").select("session", "model")
    a = rates(labelled(spark, sf_dir), {"claude45": "claude45", "gpt5": "gpt5"}).withColumnRenamed("shown", "in_runs")
    b = rates(labelled_calls(spark, sf_dir).join(own, "session"), {"gpt-5.4": "gpt_5_4", "claude-opus-4-6": "claude_opus_4_6"}).withColumnRenamed("shown", "in_sessions")
    return a.join(b, "intent", "full_outer").na.fill(False, ["in_runs", "in_sessions"])


ORACLES["intent_comparison_4way"] = _run_sql(
    COMPARED + "select coalesce(a.intent, c.intent) as intent, claude45, gpt5, gpt_5_4, claude_opus_4_6, a.intent is not null as in_runs, c.intent is not null as in_sessions from a full join c on a.intent = c.intent"
)

#: Session models and the run models they are compared with.
BASELINES = {"claude-opus-4-6": "claude45", "claude-sonnet-4-5": "claude45", "gpt-5.4": "gpt5", "gemini-2.5-pro": "gemini25pro", "glm-4.5": "glm45"}


@query()
def baseline_comparison(spark, sf_dir):
    """Each session model beside its baseline: steps per session and per run, and how often they end well."""
    from .fixtures import runs, steps

    per = calls(spark, sf_dir).groupBy("session").agg(F.count("*").alias("n"))
    ours = shipped_sessions(spark, sf_dir).join(per, "session", "left").groupBy("model").agg(F.avg(F.coalesce("n", F.lit(0))).alias("steps"), F.avg(F.col("shipped").cast("int")).alias("rate"))
    base = runs(spark, sf_dir).join(steps(spark, sf_dir).groupBy("run_id").agg(F.count("*").alias("n")), "run_id")
    base = base.groupBy(F.col("model").alias("baseline")).agg(F.avg("n").alias("base_steps"), F.avg(F.coalesce(F.col("resolved"), F.lit(False)).cast("int")).alias("base_rate"))
    names = spark.createDataFrame(list(BASELINES.items()), "model string, baseline string")
    return F.broadcast(names).join(ours, "model", "left").join(base, "baseline", "left").select("model", "baseline", "steps", "rate", "base_steps", "base_rate")


ORACLES["baseline_comparison"] = _run_sql(
    f""", bl(model, baseline) as ({dims.values_sql(list(BASELINES.items()))}),
o as (select s.model, avg(coalesce((select count(*) from calls c where c.session = s.session), 0)) as steps, avg(shipped::int) as rate from ship s group by 1),
r as (select model as baseline, avg((select count(*) from st where st.run_id = runs.run_id)) as base_steps, avg(coalesce(resolved, false)::int) as base_rate from runs group by 1)
select bl.model, bl.baseline, steps, rate, base_steps, base_rate from bl left join o using (model) left join r using (baseline)"""
)
