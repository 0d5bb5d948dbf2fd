"""The rules of licences: gates let through whatever a rule matches, and a plain scanner finds the same."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from steploom.llm import license_scan

from . import brute
from .test_operators import SF, by_id


def matched(tree):
    """All texts that a parsed expression matches."""
    parts = []
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            parts.append([chr(arg)])
        elif name == "IN":
            parts.append([c for kind, v in arg for c in ([chr(v)] if str(kind) == "LITERAL" else map(chr, range(v[0], v[1] + 1)))])
        elif name == "BRANCH":
            parts.append([t for branch in arg[1] for t in matched(branch)])
        elif name == "SUBPATTERN":
            parts.append(list(matched(arg[3])))
        else:
            assert name == "MAX_REPEAT" and arg[:2] == (0, 1), name
            parts.append(["", *matched(arg[2])])
    return map("".join, itertools.product(*parts))


def test_gates_let_every_match_through():
    gate, lacking, n = re.compile(license_scan.GATE), set(), 0
    for _, keyword, expression, *_ in license_scan.rules():
        for t in matched(re._parser.parse(expression)):
            n += 1
            assert gate.search(f" {t} ") and "  " not in t, t
            if keyword not in f" {t} ":
                lacking.add(t[:22])
    # Other licences share these sentences, so they ask for the name elsewhere in the text.
    assert lacking == {"you may not use this f", "terms and conditions f"}
    assert n > 100_000 and len(license_scan.SIGNATURES) > 200


def test_other_names_of_mit(spark):
    texts = ["Licensed under the Expat License.", "X11 license", "SPDX-License-Identifier: X11", "License: Expat", "MIT License", "the expat parser on x11"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(license_scan.licence_report(df), "labels", "score")
    assert [got[k] for k in range(6)] == [("mit", 0.9), ("mit", 0.75), ("mit", 0.95), ("mit", 0.6), ("mit", 0.75), ("", 0.0)]


@pytest.mark.parametrize(
    "text, labels",
    [
        ("Licensed under GPLv3", "gpl-3.0"),
        ("under the LGPLv2.1 license", "lgpl-2.1"),
        ("released under AGPLv3", "agpl-3.0"),
        ("Apache License v2.0", "apache-2.0"),
        ("GNU GPL version 3 or later", "gpl-3.0"),
        ("GNU General Public License v3", "gpl,gpl-3.0"),
        ("see http://creativecommons.org/licenses/by-nc-sa/4.0/", "cc-by-nc-sa-4.0"),
        ("Redistributions of source code must retain the above copyright notice", "bsd"),
        ("a copy of the software", ""),
    ],
)
def test_versions_and_notices(spark, text, labels):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert license_scan.licence_report(df).first()["labels"] == labels


def test_rules_against_a_plain_scanner(spark):
    """Labels and scores of texts put together from what the rules match, and of the tables' own texts."""
    pick, rules = random.Random(5), license_scan.rules()
    pieces = [next(itertools.islice(matched(re._parser.parse(e)), k % 7, None), e) for k, (_, _, e, *_) in enumerate(rules)]
    pieces = [p for p in pieces if not re.search(r"[(\\[]", p)]
    texts = [", ".join(pick.choice(["nothing here", "apache", pick.choice(pieces).title()]) for _ in range(pick.randrange(1, 9))) for _ in range(400)]
    own = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where(F.lower("text").rlike("licen|copyright|rights|released")).collect()]
    rows = list(enumerate([*texts, *own, None, "", " \n", "mit license " * 3000]))
    got = by_id(license_scan.licence_report(spark.createDataFrame(rows, "doc_id long, text string")), "labels", "score")
    assert got == {i: brute.licences(t, rules) for i, t in rows}
    assert sum(bool(x[0]) for x in got.values()) > 300
