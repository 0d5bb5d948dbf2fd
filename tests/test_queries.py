"""Every query beside its SQL on the smallest tables, plans, and invariants."""

import os

import duckdb
import pytest

from steploom.plans import detail_queries, fixtures, run_queries, session_queries, stored_queries, transcript_files

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = {**run_queries.QUERIES, **session_queries.QUERIES, **transcript_files.QUERIES, **stored_queries.QUERIES, **detail_queries.QUERIES}
ORACLES = {**run_queries.ORACLES, **session_queries.ORACLES, **transcript_files.ORACLES, **stored_queries.ORACLES, **detail_queries.ORACLES}
#: Cheap to run one by one; the rest are held against their SQL by compare.py on larger tables.
CHECKED = [
    "category_frequencies", "sequence_labels", "structural_markers", "phase_heatmap", "bigram_matrix", "run_stats", "paired_ratios", "work_done_paired", "user_message_stats", "toolcall_intent",
    "toolcall_results", "issue_resolution", "resolution_schemes", "peer_landscape", "session_success",
    "steps", "runs_resolved", "runs_eval", "repo_of_instance", "session_completion", "session_names", "user_message_class", "intent_comparison_4way",
    "transcript_sessions", "transcript_categories", "ledger_calls", "paired_sections", "run_stats_export", "step_ecdf_summary",
    "key_sequences", "phase_bands_without_git", "wrapper_failures", "post_edit_tail", "inline_snippets", "classification_table", "combined_markers", "repo_of_task", "baseline_markers",
    "baseline_profile", "streamed_intents", "intervention_starts", "issue_totals", "resolution_dim",
]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    order = sorted(df.columns)
    result = db.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == order
    want = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in result.fetchall())
    got = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    assert got == want and (got or name in ("work_done_paired", "paired_ratios"))


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES) and len(QUERIES) > 70


def test_one_shuffle_labels_the_sequence(spark):
    plan = run_queries.sequenced(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_shares_sum_to_one(spark):
    from pyspark.sql import functions as F

    shares = QUERIES["intent_frequencies"](spark, SF).groupBy("model").agg(F.sum("share").alias("s")).collect()
    assert all(r.s == pytest.approx(1) for r in shares)
    bigrams = QUERIES["bigram_matrix"](spark, SF).agg(F.sum("n")).first()[0]
    steps = fixtures.steps(spark, SF)
    assert bigrams == steps.count() - steps.select("run_id").distinct().count()


def test_entry_works_without_the_training_subpackage(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and entry.entry(spark).count() > 0
    assert os.path.exists(os.path.join(os.path.dirname(entry.__file__), "bench.py"))
