"""Null ids, repeated rows, empty and long texts and clashing column names, through every operator on documents."""

import collections
import random

import public_tokenizers
import pytest

from steploom.llm import exact_dedup, filter_audit, jaccard_join, license_scan, mixing, ngram_lm, packing, quality_rules, resampling, substring_dedup, target_draw

from .test_operators import docs, labels  # noqa: F401

PATH = public_tokenizers.path("word_bpe_49k.json")
#: Names that the operators use inside.
CLASHING = ["id", "norm", "hash", "best", "n", "same", "kept", "words", "size", "rank", "weight", "score", "piece", "start", "form", "component_id", "copies", "own_sha", "kept_id", "label"]


@pytest.fixture(scope="module")
def awkward_rows():
    r = random.Random(11)
    vocabulary = [f"w{r.randrange(900)}" for _ in range(900)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    long, twice = text(180_000), text(90)  # about 0.8 MB: more than a slice
    made = [(1, text(70)), (2, None), (3, ""), (4, " \t\n"), (5, long), (6, twice), (6, twice), (None, twice), (None, None), (7, long + " end"), (None, twice)]
    return [(i, t, ("a", None, "b")[len(t or "") % 3]) for i, t in made + [(k, text(r.randrange(1, 120))) for k in range(10, 40)]]


@pytest.fixture(scope="module")
def awkward_docs(spark, awkward_rows):
    plain = spark.createDataFrame(awkward_rows, "doc_id long, text string, source string").repartition(5)
    return plain.selectExpr("*", *[f"'x' as {c}" for c in CLASHING])


ROW_EACH = {
    "exact": lambda d, labels, spark: exact_dedup.exact_groups(d),
    "language model": lambda d, labels, spark: ngram_lm.score_corpus(d),
    "licences": lambda d, labels, spark: license_scan.licence_report(d),
    "quality": lambda d, labels, spark: quality_rules.judge(d, labels),
    "jaccard": lambda d, labels, spark: jaccard_join.jaccard_components(d),
    "mixing": lambda d, labels, spark: mixing.mix(d),
    "substrings": lambda d, labels, spark: substring_dedup.remove_repeats(d),
    "draw": lambda d, labels, spark: target_draw.draw(d, spark.createDataFrame([("w1 w2 w3",), (None,)], "text string")),
}


@pytest.mark.parametrize("name", ROW_EACH)
def test_a_row_for_each_row(spark, awkward_docs, awkward_rows, labels, name):  # noqa: F811
    """Every row is answered once, whatever its id; rows that repeat are answered alike."""
    out = ROW_EACH[name](awkward_docs, labels, spark).collect()
    assert collections.Counter(x.doc_id for x in out) == collections.Counter(i for i, *_ in awkward_rows)
    kept_once = {"kept", "copies", "rank", "intervals", "taken"}
    alike = {tuple(v for c, v in x.asDict().items() if c not in kept_once) for x in out if x.doc_id == 6}
    assert len({str(a) for a in alike}) == 1


def test_pieces_hold_every_row(awkward_docs, awkward_rows):
    out = packing.pack(awkward_docs, PATH).collect()
    assert collections.Counter(x.doc_id for x in out if x.start == 0) == collections.Counter(i for i, *_ in awkward_rows)
    places = collections.defaultdict(list)
    for x in out:
        places[x.sequence_id].append((x.offset, x.length))
    for spans in places.values():
        spans.sort()
        assert [a for a, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))] and sum(n for _, n in spans) <= 4096


def test_rows_that_stay_keep_their_columns(awkward_docs, awkward_rows, labels):  # noqa: F811
    for made in (exact_dedup.drop_exact_copies(awkward_docs), quality_rules.good_rows(awkward_docs, labels), jaccard_join.one_of_each(awkward_docs), mixing.mixed_rows(awkward_docs)):
        assert made.columns == awkward_docs.columns
        assert {(x.doc_id, x.text, x.source) for x in made.collect()} <= set(awkward_rows)
    texts = [x.text for x in exact_dedup.drop_exact_copies(awkward_docs).collect()]
    assert len(texts) == len(set(texts)) == len({"".join((t or "").split()) for _, t, _ in awkward_rows})


def test_draws_and_audits_take_such_rows(spark, awkward_docs, awkward_rows, labels):  # noqa: F811
    drawn = resampling.resample(awkward_docs, labels).collect()
    assert {x.doc_id for x in drawn} <= {i for i, *_ in awkward_rows}
    parts = collections.Counter(s or "" for *_, s in awkward_rows)
    audited = filter_audit.audit(awkward_docs, labels).where("step = 1 and filter_order = 'ABCDE'").collect()
    assert {x.part: x.kept + x.removed for x in audited} == dict(parts)


def test_empty_tables_through_the_pipeline(docs, labels):  # noqa: F811
    none = docs.limit(0)
    for stage in (lambda d: quality_rules.good_rows(d, labels), exact_dedup.drop_exact_copies, lambda d: jaccard_join.one_of_each(d, size=5, num=80), mixing.mixed_rows):
        none = stage(none)
        assert none.columns == docs.columns and none.isEmpty()
    assert packing.pack(none, PATH).isEmpty()
