"""The registered query of each training-data operator: production parameters over the whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, exact_dedup, filter_audit, jaccard_join, license_scan, mixing, ngram_lm, packing, quality_rules, resampling, substring_dedup, target_draw, warc
from .common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


ORACLES["op1_exact_dedup"] = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm
  from documents)
select doc_id,
       first_value(doc_id) over w as keep_id,
       count(*) over (partition by norm) as group_size,
       row_number() over w = 1 as kept,
       sha256(norm) as text_sha256
from d window w as (partition by norm order by n desc, doc_id)
"""


@query
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licence_report(table(spark, sf_dir, "documents"))


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


ORACLES["op8_mixing"] = r"""
with recursive d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
         md5(cast(doc_id as varchar)) as digest
  from documents),
s as (
  select source, cast(sum(size) as bigint) as source_size,
         (array[5.0, 2.0, 1.0])[(row_number() over (order by source is null, source) - 1) % 3 + 1]::double as weight
  from d group by source),
f as (
  select *, 3.0::double * source_size as cap, 3.0::double * source_size / weight as full_at from s),
levels as (
  select a.source, a.full_at,
         ((select sum(source_size) from f) - coalesce((select sum(b.cap) from f b where b.full_at < a.full_at), 0.0))
         / (select sum(b.weight) from f b where b.full_at >= a.full_at) as level
  from f a),
water as (select min_by(level, full_at) as level from levels where full_at > level),
t as (
  select f.source, source_size,
         case when water.level is null or full_at <= water.level then cap else water.level * weight end::double as target
  from f, water),
r as (
  select d.doc_id, d.source, d.size, t.source_size, t.target,
         case when t.source_size > 0 then t.target / t.source_size else 0.0 end::double as rate,
         row_number() over (partition by d.source
           order by case when size > 0 then floor(8 * log2(size)) else -1 end, ('0x' || substr(digest, 1, 8))::bigint, size, doc_id) as rank,
         ('0x' || substr(md5('mix:' || coalesce(d.source, chr(0) || 'null')), 1, 5))::int / 1048576.0::double as u
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
       cast(floor(u + rate * rank) - floor(u + rate * (rank - 1)) as bigint) * size as taken,
       cast(floor(u + rate * rank) - floor(u + rate * (rank - 1)) as bigint) as copies
from r
"""


def template_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -7: both turns hold control strings of a common template."""
    says = "'</s>[INST] ok [/INST]'"
    return spark.sql(f"select * from values (-7L, 0L, 'user', {says}), (-7L, 1L, 'assistant', {says}) as t(conv_id, turn, role, text)")


@query
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(template_conversation(spark))
    made = chat_format.format_conversations(turns.withColumn("parts", chat_format.text_part("text")))
    # Everything below is read back from the formatted string and its loss mask.
    back = made.withColumn("back", chat_format.parse_turns("formatted")).withColumn("loss", chat_format.loss_text("formatted", "loss_spans"))
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLES["op9_chat_format"] = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (
  select *, length(role) + length(text) + 4 * (length(text) - length(replace(text, '&', '')))
            + 3 * len(regexp_extract_all(text, '<(?:/?s>|\||</?SYS>)')) + 5 * len(regexp_extract_all(text, '\[/?INST\]'))
            + length('<|turn|>') + length('<|text|>') + 1 + length('<|end|>') + 1 as chars
  from c)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(chars) as bigint) as formatted_chars
from e group by conv_id
"""


@query
def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


@query
def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_corpus(table(spark, sf_dir, "documents"), order=3)


@query
def op11_target_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_draw.draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op12_filter_audit"] = r"""
with base as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words
  from documents),
flags as (
  select doc_id, part, len(words) < 200 as a, 100 * len(list_distinct(words)) < 50 * len(words) as b,
         100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) as c,
         regexp_matches(text, '[#$%&*|]') as d, coalesce(doc_id > min(doc_id) over (partition by text), false) as e,
         doc_id in (select doc_id from labels where quality = 1) as good, doc_id in (select doc_id from labels where toxic = 1) as toxic
  from base),
masks as (
  select part, a::int + 2 * b::int + 4 * c::int + 8 * d::int + 16 * e::int as mask, count(*) as n,
         count(*) filter (good) as n_good, count(*) filter (toxic) as n_toxic
  from flags group by all),
letters(letter, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders as (
  select u.letter || v.letter || w.letter || x.letter || y.letter as filter_order, [u.bit, v.bit, w.bit, x.bit, y.bit] as bits
  from letters u, letters v, letters w, letters x, letters y where u.bit + v.bit + w.bit + x.bit + y.bit = 31
    and len(list_distinct([u.bit, v.bit, w.bit, x.bit, y.bit])) = 5),
steps as (
  select filter_order, step, bits[step] as own, cast(coalesce(list_sum(bits[1:step - 1]), 0) as int) as earlier
  from orders, (select unnest(range(1, 6)) as step)),
found as (
  select part, filter_order, step, own,
         cast(sum(n) filter (mask & (own | earlier) = 0) as bigint) as kept,
         cast(sum(n) filter (mask & own <> 0 and mask & earlier = 0) as bigint) as removed,
         cast(sum(n) filter (mask & own <> 0 and mask & earlier <> 0) as bigint) as redundant,
         cast(sum(n) filter (mask = own) as bigint) as unique_fails,
         cast(sum(n_good) filter (mask & own <> 0 and mask & earlier = 0) as bigint) as good_lost,
         cast(sum(n_toxic) filter (mask & own <> 0 and mask & earlier = 0) as bigint) as toxic_lost
  from masks, steps group by all)
select part, filter_order, cast(step as int) as step, coalesce(kept, 0) as kept, coalesce(removed, 0) as removed, coalesce(redundant, 0) as redundant,
       coalesce(unique_fails, 0) as unique_fails, coalesce(good_lost, 0) as good_lost, coalesce(toxic_lost, 0) as toxic_lost,
       cast(sum(coalesce(removed, 0)) over (partition by part, own) as bigint) as shapley
from found
"""


@query
def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages")).drop("intact")


ORACLES["op13_warc"] = """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
k as (select *, octet_length(payload) as size, case when octet_length(payload) >= 1000 then max(page_id) over (partition by payload) end as keeper from p)
select page_id, cast(size as bigint) as payload_bytes, sha1(payload) as payload_digest,
       case when keeper > page_id then 'revisit' else 'response' end as record_type, case when keeper > page_id then keeper end as refers_to
from k
"""
