"""Each operator against a plain version, over the smallest table and over awkward rows."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from steploom.llm import chat_format, exact_dedup, gram_shards, hashed_ngrams, jaccard_join, license_scan, mixing, ngram_lm, packing, quality_rules, resampling, substring_dedup
from steploom.llm.queries import QUERIES

from . import brute

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, id int, n long, norm string"
AWKWARD = [None, "", " \t\n", "a", "A", "a b", "b a", "a b c", "a  b\tc", "é ü ß 日本", "x" * 30000, "la " * 3000, "\x00 \x01", "CC-BY cc by; All Rights Reserved"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and long texts, and columns with the operators' own names."""
    made = [(10_000 + k, t, None, None if k % 3 else "s", None, 1, 2, 3, "z") for k, t in enumerate(AWKWARD)]
    return spark.createDataFrame(made, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(awkward):
    return [(r.doc_id, r.text) for r in awkward.collect()]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def by_id(df, *cols):
    return {r[0]: tuple(r[c] for c in cols) for r in df.collect()}


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", ["docs", "awkward"])
def test_exact(request, name):
    df = request.getfixturevalue(name)
    got = by_id(exact_dedup.exact_groups(df), "keep_id", "group_size", "kept", "text_sha256")
    assert got == brute.exact([(r.doc_id, r.text) for r in df.collect()])


def test_exact_ties_nulls_and_collisions(spark, monkeypatch):
    df = spark.createDataFrame([(3, "ab"), (2, "ab"), (None, "a b"), (7, "ab"), (7, "ab")], "doc_id long, text string")
    got = exact_dedup.exact_groups(df).collect()
    assert {(r.keep_id, r.group_size) for r in got} == {(None, 5)}  # the longest text stays, whatever its id
    kept = exact_dedup.drop_exact_copies(df)
    assert [tuple(r) for r in kept.collect()] == [(None, "a b")] and kept.columns == df.columns
    twice = spark.createDataFrame([(7, "ab"), (7, "ab")], "doc_id long, text string")
    assert [tuple(r) for r in exact_dedup.drop_exact_copies(twice).collect()] == [(7, "ab")]
    # With a hash of one value for all texts, the comparison of bytes alone must tell them apart.
    mixed = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, "cd"), (4, "c d"), (5, "e")], "doc_id long, text string")
    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: F.lit("00" * 16))
    got = by_id(exact_dedup.exact_groups(mixed), "keep_id", "group_size", "kept")
    assert got == {1: (1, 2, True), 2: (1, 2, False), 3: (4, 2, False), 4: (4, 2, True), 5: (5, 1, True)}


def test_exact_rows_of_one_id_with_texts_of_two_lengths(spark):
    df = spark.createDataFrame([(1, "ab", "x"), (1, "a b", "y"), (1, "a b", "y"), (None, None, None), (None, "", "z")], "doc_id long, text string, kept_id string")
    got = exact_dedup.drop_exact_copies(df)
    assert got.columns == df.columns
    rows = [tuple(r) for r in got.collect()]
    assert (1, "a b", "y") in rows and len(rows) == 2 and [r[0] for r in rows].count(None) == 1


@pytest.mark.parametrize("shard_size", [6_000_000, 3_000])
def test_substring_dedup(docs, rows, awkward, odd, shard_size, monkeypatch):
    monkeypatch.setattr(gram_shards, "SHARD_HASHES", shard_size)
    monkeypatch.setattr(gram_shards, "MIN_SAMPLE_COUNT", 24 if shard_size > 10**6 else 1)
    df, all_rows = docs.select("doc_id", "text").union(awkward.select("doc_id", "text")), rows + odd
    assert by_id(substring_dedup.remove_repeats(df), "n_words", "n_removed", "kept_sha256") == brute.repeats(all_rows, 50)


def test_substring_intervals_and_null_ids(spark):
    r = random.Random(2)
    made = [(i, " ".join(r.choice("ab") for _ in range(r.randint(0, 40)))) for i in range(200)]
    out = substring_dedup.remove_repeats(spark.createDataFrame(made, "doc_id long, text string").repartition(4), 5).collect()
    assert {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in out} == brute.repeats(made, 5)
    for x in out:
        assert sum(x.intervals[1::2]) - sum(x.intervals[::2]) == x.n_removed
        assert len(x.kept_text.split()) == x.n_words - x.n_removed
    pair = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c"), (None, "a b c")], "doc_id long, text string")
    assert sorted((str(x.doc_id), x.n_removed) for x in substring_dedup.remove_repeats(pair, 2).collect()) == [("5", 0), ("5", 0), ("None", 3), ("None", 3)]


@pytest.mark.parametrize("hot", [False, True])
def test_jaccard(docs, rows, awkward, odd, hot, monkeypatch):
    if hot:
        monkeypatch.setattr(gram_shards, "SHARD_HASHES", 5_000)
        monkeypatch.setattr(gram_shards, "MIN_SAMPLE_COUNT", 2)
    df = docs.select("doc_id", "text").union(awkward.select("doc_id", "text"))
    assert by_id(jaccard_join.jaccard_components(df), "n_shingles", "component_id") == brute.jaccard(rows + odd)


def test_jaccard_of_a_family(spark):
    """One large family whose members are near the threshold, so that stars alone miss links."""
    r = random.Random(3)
    base = [r.choice("abcdefghijklmnopqrstuvw") + str(r.randint(0, 9)) for _ in range(120)]
    made = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randint(0, 7)):
            w[r.randrange(len(w))] = r.choice([f"zz{r.randint(0, 99)}", "k"])
        made.append((i, " ".join(w[: r.randint(90, 120)] if r.random() < 0.3 else w)))
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(5)
    assert by_id(jaccard_join.jaccard_components(df), "n_shingles", "component_id") == brute.jaccard(made)
    kept = {x.doc_id for x in jaccard_join.one_of_each(df).collect()}
    assert kept == {c for _, c in brute.jaccard(made).values()}


def test_rules(docs, rows, awkward, odd, labels):
    df = docs.select("doc_id", "text").union(awkward.select("doc_id", "text"))
    got = by_id(quality_rules.judge(df, labels), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == {i: brute.rules(t) for i, t in rows + odd}
    judged = quality_rules.judge(docs, labels)
    kept = {r.doc_id for r in judged.where("kept").collect()}
    good = quality_rules.good_rows(docs, labels)
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == kept
    assert judged.where("kept and base_failed").isEmpty()


def test_rules_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    train, test = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    got = quality_rules.judge(docs, train).where("not base_failed").join(test, "doc_id").select("kept", "quality").collect()
    assert len(got) > 100 and sum(r.kept == (r.quality == 1) for r in got) >= 0.97 * len(got)
    assert quality_rules.judge(docs, train.limit(0)).where("kept = base_failed").isEmpty()


def test_resampling(spark, docs, labels):
    out = resampling.resample(docs, labels, share=0.6)
    got = out.collect()
    n = docs.count()
    assert len(got) == n and sum(r.kept for r in got) == int(np.ceil(0.6 * n))
    assert min(r.gumbel_key for r in got if r.kept) >= max(r.gumbel_key for r in got if not r.kept)
    assert sorted(map(tuple, got)) == sorted(map(tuple, resampling.resample(docs, labels, share=0.6).collect()))
    good = {r.doc_id: r.quality for r in labels.collect()}
    worse = [r.log_weight for r in got if good.get(r.doc_id) == 0]
    assert np.mean(worse) < np.mean([r.log_weight for r in got if good.get(r.doc_id) == 1])
    same = spark.createDataFrame([(1, "abc"), (1, "abc"), (1, "abc"), (None, None)], "doc_id long, text string")
    assert sum(r.kept for r in resampling.resample(same, labels.limit(0), share=0.5).collect()) == 2


def test_log_weights_are_sums_of_log_ratios(docs, labels, rows):
    target, raw = hashed_ngrams.counts(docs, hashed_ngrams.trusted(labels))
    ratios = hashed_ngrams.log_ratios(target, raw)
    assert raw.sum() == sum(max(len(t.encode()) - 3, 0) for _, t in rows)
    got = by_id(resampling.log_weights(docs, labels), "log_weight")
    for i, t in rows[:20]:
        b = t.encode()
        own = hashed_ngrams.buckets(np.frombuffer(b, np.uint8))
        assert np.isclose(got[i][0], ratios[own].sum())


def test_packing(docs, rows, awkward, odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    df = docs.select("doc_id", "text").union(awkward.select("doc_id", "text"))
    got = packing.pack(df, path).collect()
    plain = packing.WordTokenizer(path).tokenizer
    ids = {i: [*plain.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows + odd}
    at = {}
    for p in sorted(got, key=lambda p: (p.doc_id, p.start)):
        assert p.start == at.get(p.doc_id, 0) and p.length > 0 and p.doc_tokens == len(ids[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes())
        at[p.doc_id] = p.start + p.length
    assert at == {i: len(x) for i, x in ids.items()}
    ends = {}
    for p in sorted(got, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == ends.get(p.sequence_id, 0)
        ends[p.sequence_id] = p.offset + p.length
    assert max(ends.values()) <= 4096
    tokens = sum(map(len, ids.values()))
    assert len(ends) * 4096 <= 1.05 * tokens + 4096


def test_word_tokenizer_equals_the_tokenizer():
    t = packing.tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    for text in ["a\tb\x85c \xa0 d'S it's I'LL ÀÉ x²³½ <|endoftext|> q", "Σας ΣΣ é́ K ﬁ", "ÿŸ ß a\x1cb", "\x00\x01a", " à", "x\x7f\xad\xb7", "", "日本 x"]:
        assert np.frombuffer(t.encode(text), "<u4").tolist() == t.tokenizer.encode(text, add_special_tokens=False).ids


def test_cutting_stock_holds_the_demand_and_nears_the_bound():
    r = np.random.default_rng(1)
    demand = np.bincount(r.integers(0, 256, 3000), minlength=256)
    patterns = packing.cutting_stock(demand, 256)
    assert (sum(p * n for p, n in patterns) == demand).all()
    assert all(p @ np.arange(1, 257) <= 256 for p, _ in patterns)
    used, bound = sum(n for _, n in patterns), demand @ np.arange(1, 257) / 256
    assert used <= 1.05 * bound + 10


def test_language_model(docs, rows, awkward, odd, monkeypatch):
    made, p, words = brute.kneser_ney(rows + odd)
    for size in (6_000_000, 5_000):
        monkeypatch.setattr(gram_shards, "SHARD_HASHES", size)
        df = docs.select("doc_id", "text").union(awkward.select("doc_id", "text"))
        got = by_id(ngram_lm.score_corpus(df), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
        assert got.keys() == made.keys()
        for i, x in made.items():
            assert got[i][:4] == x[:4] and got[i][4:] == pytest.approx(x[4:], rel=1e-9)
    assert sum(p("<s>", w) for w in words) + p("<s>", None) == pytest.approx(1)
    held = [x for x in made.values() if x[0]]
    assert sum(x[5] for x in held) > sum(x[4] for x in held)


def test_licences(docs, rows, awkward, odd):
    df = docs.select("doc_id", "text").union(awkward.select("doc_id", "text"))
    got = by_id(license_scan.licence_report(df), "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got == {i: brute.phrases(t) for i, t in rows + odd}


def test_licence_rules(spark):
    texts = {
        1: "Licensed under the Apache License, Version 2.0.",
        2: "Released under the MIT License. All rights reserved. All rights reserved.",
        3: "This work is licensed under the GNU General Public License, version 3.",
        4: "SPDX-License-Identifier: BSD-3-Clause\nCopyright (c) 2020 x",
        5: "Licensed under CC BY-NC 4.0.",
        6: "nothing of the kind",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = by_id(license_scan.licence_report(df), "labels", "score", "n_base", "first_word", "last_word")
    assert "apache-2.0" in got[1][0] and got[1][1] == 0.9 and "license-word" not in got[1][0]
    assert got[2] == ("mit,reserved", 0.9, 2, 5, 8)
    assert "gpl" in got[3][0].split(",") and "gpl-3.0" in got[3][0].split(",")
    assert "bsd-3-clause" in got[4][0] and "spdx-tag" not in got[4][0]
    assert {"cc-by", "cc-by-nc-4.0"} <= set(got[5][0].split(","))
    assert got[6] == ("", 0.0, 0, None, None)


def test_mixing(spark, docs):
    got = mixing.mix(docs).collect()
    sources = {}
    for r in got:
        s = sources.setdefault(r.source, [0, r.source_size, r.target])
        s[0] += r.copies * r.size
        assert 0 <= r.copies <= 3
    assert sum(s[2] for s in sources.values()) == pytest.approx(sum(s[1] for s in sources.values()))
    for name, (taken, size, target) in sources.items():
        largest = max(r.size for r in got if r.source == name)
        assert target <= 3 * size + 1e-6 and abs(taken - target) <= 2 * largest
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns and rows.count() == sum(r.copies for r in got)


def test_targets_by_resharing(spark):
    for sizes in ([("a", 100), ("b", 1), ("c", 5), (None, 40)], [("a", 0), ("b", 0)], [("x", 7)], [("p", 1), ("q", 1), ("r", 100), ("s", 3), ("t", 0)]):
        got = by_id(mixing.source_targets(spark.createDataFrame(sizes, "source string, source_size long")), "target")
        order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
        weight = {s: (5, 2, 1)[k % 3] for k, (s, _) in enumerate(order)}
        total, target = sum(n for _, n in sizes), {}
        free, left = dict(sizes), float(total)
        while free:
            level = left / sum(weight[s] for s in free)
            full = [s for s in free if level * weight[s] > 3 * free[s]]
            if not full:
                target |= {s: level * weight[s] for s in free}
                break
            for s in full:
                target[s] = 3.0 * free.pop(s)
                left -= target[s]
        assert {k: v[0] for k, v in got.items()} == pytest.approx(target)


def test_mixing_awkward(spark, awkward):
    got = mixing.mix(awkward).collect()
    assert len(got) == len(AWKWARD) and {r.source for r in got} == {None, "s"}
    twice = spark.createDataFrame([(1, "a b", "s")] * 3 + [(2, "a", "t")], "doc_id long, text string, source string")
    assert mixing.mixed_rows(twice).count() == sum(r.copies for r in mixing.mix(twice).collect())


def test_chat_parts(spark):
    part = "struct<type:string,text:string,ref:string,size:bigint>"
    made = [
        (1, 0, "user", [("text", "see <|image:1|> & <|end|>\n", None, None), ("image", None, "s3://a", 1568), ("audio", None, "b", None)]),
        (1, 1, "assistant", [("text", "</s>[INST] ok [/INST] &lt;", None, None), ("document", None, "c", 41)]),
        (2, None, None, None),
        (2, 1, "assist<|turn|>ant", [("text", None, None, None)]),
        (None, 0, "assistant", [("text", "x<", None, None)]),
    ]
    turns = spark.createDataFrame(made, f"conv_id long, turn long, role string, parts array<{part}>")
    out = chat_format.format_conversations(turns).withColumn("back", chat_format.parse_turns("formatted")).withColumn("loss", chat_format.loss_text("formatted", "loss_spans"))
    got = {r.conv_id: r for r in out.collect()}
    one = got[1]
    assert [(a.ordinal, a.type, a.ref, a.tokens) for a in one.attachments] == [(1, "image", "s3://a", 2), (2, "audio", "b", 1), (3, "document", "c", 11)]
    assert one.formatted.count("<|end|>") == 2 and one.formatted.count("<|image:1|>") == 1
    assert one.back[0].text == "see <|image:1|> & <|end|>\n<|image:1|><|audio:2|>"
    assert one.loss == "</s>[INST] ok [/INST] &lt;<|document:3|>"
    assert [(t.role, t.text) for t in got[2].back] == [("", ""), ("assist<|turn|>ant", "")] and got[2].loss == ""
    assert got[None].loss == "x<"


def test_chat_parts_forge_nothing_where_they_meet(spark):
    pieces = ["a<", "|end|>\n<", "|turn|>x", "[", "INST]", "</", "s>", "&", "lt;", "<|", "image:1|>", "", None, "<|#|>", "#|>"]
    draw = random.Random(5)
    made, want = [], {}
    for c in range(60):
        n = 0
        for t in range(4):
            parts, text = [], ""
            for _ in range(draw.randrange(6)):
                if draw.random() < 0.3:
                    n += 1
                    parts.append(("image", None, f"{c}/{n}", 10))
                    text += f"<|image:{n}|>"
                else:
                    parts.append(("text", draw.choice(pieces), None, None))
                    text += parts[-1][1] or ""
            role = draw.choice(["user", "assistant"])
            made.append((c, t, role, parts))
            want.setdefault(c, []).append((role, text))
    made += [(98, 0, "user", [("image", None, "r", 1)])] * 2 + [(99, 0, "user", [("text", "[INST] <|turn|> " * 20_000, None, None)] * 2)]
    turns = spark.createDataFrame(made, "conv_id long, turn long, role string, parts array<struct<type:string,text:string,ref:string,size:bigint>>").withColumn("formatted", F.lit("clash"))
    out = chat_format.format_conversations(turns).withColumn("back", chat_format.parse_turns("formatted")).withColumn("loss", chat_format.loss_text("formatted", "loss_spans"))
    for r in out.where("conv_id < 60").collect():
        assert [(t.role, t.text) for t in r.back] == want[r.conv_id]
        assert r.loss == "".join(text for role, text in want[r.conv_id] if role == "assistant")
        held = [int(x) for x in re.findall(r"<\|image:(\d+)\|>", r.formatted)]
        assert held == [a.ordinal for a in r.attachments] and all(a.ref == f"{r.conv_id}/{a.ordinal}" for a in r.attachments)
    again = out.where("conv_id = 98").first()  # rows that repeat
    assert [t.text for t in again.back] == ["<|image:1|>", "<|image:2|>"] and [a.ref for a in again.attachments] == ["r", "r"]
    long = out.where("conv_id = 99").first()
    assert len(long.back) == 1 and long.back[0].text == "[INST] <|turn|> " * 40_000
    assert chat_format.format_conversations(turns.limit(0)).count() == 0


def test_chat_round_trip(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    out = chat_format.format_conversations(turns.withColumn("parts", chat_format.text_part("text")))
    back = out.select("conv_id", F.posexplode(chat_format.parse_turns("formatted")).alias("k", "t")).select("conv_id", "t.role", "t.text")
    assert sorted(map(tuple, back.collect())) == sorted((r.conv_id, r.role, r.text or "") for r in turns.collect())


def test_empty_tables(spark, docs, labels):
    none = docs.limit(0)
    path = public_tokenizers.path("word_bpe_49k.json")
    for made in (
        exact_dedup.exact_groups(none),
        exact_dedup.drop_exact_copies(none),
        substring_dedup.remove_repeats(none),
        jaccard_join.jaccard_components(none),
        jaccard_join.one_of_each(none),
        quality_rules.judge(none, labels),
        quality_rules.good_rows(none, labels),
        resampling.resample(none, labels),
        packing.pack(none, path),
        ngram_lm.score_corpus(none),
        license_scan.licence_report(none),
        mixing.mix(none),
        mixing.mixed_rows(none),
    ):
        assert made.count() == 0


def test_pipeline(spark, docs, rows, labels):
    out = corpus_pipeline.run(spark, SF).collect()
    # The same by plain versions, but for the model of the first stage.
    kept = {r.doc_id for r in quality_rules.judge(docs, labels).where("kept").collect()}
    left = [(i, t) for i, t in rows if i in kept]
    one = brute.exact(left)
    left = [(i, t) for i, t in left if one[i][2]]
    near = brute.jaccard(left, 5, 80)
    left = docs.where(F.col("doc_id").isin([i for i, _ in left if near[i][1] == i]))
    copies = {r.doc_id: r.copies for r in mixing.mix(left).collect() if r.copies}
    starts = {}
    for r in out:
        if r.start == 0:
            starts[r.doc_id] = starts.get(r.doc_id, 0) + 1
    assert starts == copies
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near duplicates", "mixing", "packing"]
