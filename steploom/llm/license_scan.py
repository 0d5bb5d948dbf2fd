"""Licence scans: ordered signature rules over the words of a text, all in column expressions.

A rule is a regular expression over the normal form of a text (its words in lower case, one space before each and
one at the end), gated by a keyword. One cheap expression decides whether a text can match any rule at all. Only
then are the rules whose keyword occurs run over it. Overlapping detections are resolved by priority and interval
containment.
"""

from __future__ import annotations

import itertools
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER
from .license_signatures import SIGNATURES

#: Base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Names of licences: label, keyword, expression of the name in normal form. ``{1}`` to ``{4}`` stand for that version as it is
#: written behind a name ("3", "v3", "version 3", "3 0"; "gplv3" too). One licence may have several names; they share its label.
LICENCES = (
    ("mit", " mit ", r"mit"),
    ("mit", " expat ", r"expat"),
    ("mit", " x11 ", r"x11"),
    ("mit-0", " mit ", r"mit (?:no attribution|0)"),
    ("apache-1.1", "apache", r"apache(?: software)?(?: licen[sc]e)?(?: version| v)? ?1 1"),
    ("apache-2.0", "apache", r"apache(?: software)?(?: licen[sc]e)?{2}"),
    ("apache", "apache licen", r"apache licen[sc]e"),
    ("bsd-2-clause", "bsd", r"(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)"),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd)"),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd)"),
    ("0bsd", "bsd", r"(?:0bsd|zero clause bsd|bsd zero clause)"),
    ("bsd", "bsd", r"(?:bsd|bsd style)"),
    ("isc", " isc ", r"isc"),
    ("zlib", "zlib", r"zlib(?: libpng)?"),
    ("libpng", "libpng", r"libpng"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl{2}?"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-1.0", "cc by", r"cc by{1}"),
    ("cc-by-2.0", "cc by", r"cc by 2 0"),
    ("cc-by-2.5", "cc by", r"cc by 2 5"),
    ("cc-by-3.0", "cc by", r"cc by{3}"),
    ("cc-by-4.0", "cc by", r"cc by{4}"),
    ("cc-by-sa-3.0", "cc by sa", r"cc by sa{3}"),
    ("cc-by-sa-4.0", "cc by sa", r"cc by sa{4}"),
    ("cc-by-nc-3.0", "cc by nc", r"cc by nc{3}"),
    ("cc-by-nc-4.0", "cc by nc", r"cc by nc{4}"),
    ("cc-by-nd-4.0", "cc by nd", r"cc by nd{4}"),
    ("cc-by-nc-sa-4.0", "cc by nc sa", r"cc by nc sa{4}"),
    ("cc-by-nc-nd-4.0", "cc by nc nd", r"cc by nc nd{4}"),
    ("cc-by", "commons attribution", r"(?:creative )?commons attribution"),
    ("cc-by-3.0", "commons attribution", r"creative commons attribution(?: unported)?{3}"),
    ("cc-by-4.0", "commons attribution", r"creative commons attribution(?: international)?{4}"),
    ("cc-by-sa", "commons attribution share", r"creative commons attribution share ?alike"),
    ("cc-by-sa-3.0", "commons attribution share", r"creative commons attribution share ?alike{3}"),
    ("cc-by-sa-4.0", "commons attribution share", r"creative commons attribution share ?alike{4}"),
    ("cc-by-nc", "commons attribution non", r"creative commons attribution non ?commercial"),
    ("cc-by-nc-4.0", "commons attribution non", r"creative commons attribution non ?commercial{4}"),
    ("cc-by-nc-sa-4.0", "commons attribution non", r"creative commons attribution non ?commercial share ?alike{4}"),
    ("cc-by-nd", "commons attribution no", r"creative commons attribution no ?deriv(?:ative)?s?"),
    ("cc-by-nd-4.0", "commons attribution no", r"creative commons attribution no ?deriv(?:ative)?s?{4}"),
    ("gpl", "gpl", r"(?:gnu )?gpl"),
    ("gpl-1.0", "gpl", r"(?:gnu )?gpl{1}"),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl{2}"),
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl{3}"),
    ("gpl-1.0", "general public", r"(?:gnu )?general public licen[sc]e(?: gpl)?{1}"),
    ("gpl-2.0", "general public", r"(?:gnu )?general public licen[sc]e(?: gpl)?{2}"),
    ("gpl-3.0", "general public", r"(?:gnu )?general public licen[sc]e(?: gpl)?{3}"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl"),
    ("lgpl-2.0", "lgpl", r"(?:gnu )?lgpl{2}"),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl(?: version| v|v)? ?2 1"),
    ("lgpl-3.0", "lgpl", r"(?:gnu )?lgpl{3}"),
    ("lgpl", "general public", r"(?:gnu )?(?:lesser|library) general public licen[sc]e"),
    ("lgpl-2.0", "library general", r"(?:gnu )?library general public licen[sc]e{2}"),
    ("lgpl-2.1", "lesser general", r"(?:gnu )?lesser general public licen[sc]e(?: version| v)? ?2 1"),
    ("lgpl-3.0", "lesser general", r"(?:gnu )?lesser general public licen[sc]e{3}"),
    ("agpl", "agpl", r"(?:gnu )?agpl"),
    ("agpl-3.0", "agpl", r"(?:gnu )?agpl{3}"),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[sc]e"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public licen[sc]e{3}"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[sc]e"),
    ("gfdl-1.2", "free documentation", r"(?:gnu )?free documentation licen[sc]e(?: version| v)? ?1 2"),
    ("gfdl-1.3", "free documentation", r"(?:gnu )?free documentation licen[sc]e(?: version| v)? ?1 3"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[sc]e(?: version| v)? ?1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[sc]e{2}"),
    ("mpl-2.0", "mpl", r"mpl{2}"),
    ("epl-1.0", "eclipse", r"eclipse public licen[sc]e{1}"),
    ("epl-2.0", "eclipse", r"eclipse public licen[sc]e{2}"),
    ("edl-1.0", "eclipse", r"eclipse distribution licen[sc]e{1}?"),
    ("cddl-1.0", "common development", r"common development and distribution licen[sc]e"),
    ("cpl-1.0", "common public", r"common public licen[sc]e"),
    ("eupl-1.2", "european union public", r"european union public licen[sc]e"),
    ("artistic-1.0", "artistic", r"artistic licen[sc]e{1}?"),
    ("artistic-2.0", "artistic", r"artistic licen[sc]e{2}"),
    ("bsl-1.0", "boost", r"boost software licen[sc]e{1}?"),
    ("busl-1.1", "business source", r"business source licen[sc]e"),
    ("elastic-2.0", "elastic", r"elastic licen[sc]e{2}?"),
    ("sspl-1.0", "server side public", r"server side public licen[sc]e"),
    ("ofl-1.1", "open font", r"(?:sil )?open font licen[sc]e"),
    ("odbl-1.0", "open database", r"open database licen[sc]e"),
    ("odc-by-1.0", "open data commons", r"open data commons attribution"),
    ("pddl-1.0", "public domain dedication", r"public domain dedication(?: and licen[sc]e)?"),
    ("psf-2.0", "python software", r"python software foundation licen[sc]e"),
    ("php-3.01", " php ", r"php licen[sc]e"),
    ("ruby", " ruby ", r"ruby licen[sc]e"),
    ("openssl", "openssl", r"openssl licen[sc]e"),
    ("postgresql", "postgresql", r"postgresql licen[sc]e"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)?"),
    ("upl-1.0", "universal permissive", r"universal permissive licen[sc]e"),
    ("vim", " vim ", r"vim licen[sc]e"),
    ("w3c", " w3c ", r"w3c(?: software)?(?: notice)?(?: and)? licen[sc]e"),
    ("ms-pl", "microsoft public", r"microsoft public licen[sc]e"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[sc]e"),
    ("openrail", "openrail", r"(?:creativeml |bigscience )?openrail(?: m)?"),
    ("llama", "llama", r"llama [2-4] community licen[sc]e"),
)

#: Forms in which a licence is named: priority (1 is strongest), weight, expression around the name, extra gate word.
FORMS = (
    ("tag", 1, 0.95, r"spdx licen[sc]e identifier {name}"),
    ("grant", 1, 0.9, r"(?:licen[sc]ed|released|distributed|published|available|provided) under (?:the )?(?:terms of (?:the )?)?{name}(?: licen[sc]e)?"),
    ("title", 2, 0.75, r"{name} licen[sc]e"),
    ("see", 2, 0.6, r"licen[sc]e (?:is |the )?{name}"),
)

#: A text in which no word starts so matches no rule and no base phrase.
STARTS = (
    "additional use", "advertising ", "affero", "agpl", "altered source", "any later", "apache ", "artistic", "as a special", "as is without", "attribution", "autoconf", "available under",
    "based in part", "between the python", "bsd 2", "bsd 3", "binary forms", "buy me a beer", "cc by", "cc0", "cddl", "claim that you", "classpath exception", "commercial ", "commons clause", "confidential", "copyleft", "copyright",
    "creative commons", "creativecommons", "derivative", "distributed", "dual licen", "eclipse", "endorse or", "eric young", "fitness", "following acknowledgement", "fraud", "free software",
    "freedom to", "functionality of the", "gcc runtime", "gemma terms", "gnu ", "good not evil", "gpl", "heirs and", "hereby", "hosted or managed", "implied warranties", "independent jpeg", "independent modules",
    "initial developer", "interacting with it", "invariant sections", "itself", "larger work", "lgpl", "liab", "licen", "llama materials", "machine executable", "may not be used", "misrepresented", "mozilla", "mpl ",
    "ms pl", "mulan", "neither the name", "no part of", "no warrant", "odbl", "openssl", "permission", "permitted", "personal use", "php software", "procurement", "proprietary", "prior written", "provided",
    "public domain", "publicdomain", "published", "python", "read this agreement", "redistribut", "registered trade", "relinquishment", "representations", "reproduced", "research ", "reserved font", "released",
    "rights reserved", "royalty", "ruby", "same terms as", "secret", "secrets", "software developed", "spdx", "sublicen", "syscall", "terms and conditions for", "this software", "trade secret", "trademark", "trademarks", "unauthorized",
    "united states government", "unlicense", "use based", "uses the db", "uses the library", "want to", "warrant", "without restriction", "x consortium", "you may ",
)
#: The same by first letters, so that a word is held against few of them.
GATE = " (?:" + "|".join(f"{c}(?:{'|'.join(w[1:] for w in of)})" for c, of in itertools.groupby(sorted(STARTS), lambda w: w[0])) + ")"
#: Between words. Capitals are lower-cased later, and only where a rule may match, so they count as letters here.
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _named(name: str) -> str:
    """The expression of a name, with its version in any form."""
    for k in "1234":
        name = name.replace(f"{{{k}}}?", f"(?:{{{k}}})?").replace(f"{{{k}}}", rf"(?: version | version|v| v| v | )?{k}(?: 0)?")
    return name


def rules() -> list[tuple[str, str, str, int, float, bool]]:
    """(label, keyword, expression, priority, weight, base), in order."""
    out = [(label, f" {phrase} ", phrase, 2, 0.5, True) for phrase, label in BASE]
    for label, keyword, name in LICENCES:
        out += [(label, keyword, form.format(name=_named(name)), priority, weight, False) for _, priority, weight, form in FORMS]
    return out + [(label, keyword, expression, priority, weight, False) for label, keyword, expression, priority, weight in SIGNATURES]


def _rule_table() -> Column:
    """All rules as one constant, grouped by the first word of their keyword: where that doesn't occur, neither does the keyword."""
    first = lambda r: r[1].split()[0]
    rows = [
        {"word": word, "rules": [{"label": a, "keyword": k, "regex": f"(?<= ){e}(?= )", "priority": p, "weight": w, "base": b} for a, k, e, p, w, b in of]}
        for word, of in itertools.groupby(sorted(rules(), key=first), first)
    ]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<word:string,rules:array<struct<label:string,keyword:string,regex:string,priority:int,weight:double,base:boolean>>>>")


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


DETECTION = "array<struct<start:int,neg_end:int,priority:int,label:string,weight:double,base:boolean>>"


def _detections(form: Column, rule: Column) -> Column:
    """Where one rule matches: word intervals, from the pieces between its matches."""
    pieces, hits = F.split(form, rule["regex"]), F.regexp_extract_all(form, rule["regex"], F.lit(0))
    zero = F.struct(F.lit(-1).alias("at"), F.array().cast(DETECTION).alias("found"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + _spaces(pair["piece"])
        one = F.struct(
            start.cast("int").alias("start"),
            (-(start + _spaces(pair["hit"]) + 1)).cast("int").alias("neg_end"),
            rule["priority"].alias("priority"),
            rule["label"].alias("label"),
            rule["weight"].alias("weight"),
            rule["base"].alias("base"),
        )
        return F.struct((start + _spaces(pair["hit"])).cast("int").alias("at"), F.concat(acc["found"], F.array(one)).alias("found"))

    pairs = F.transform(hits, lambda h, i: F.struct(F.get(pieces, i).alias("piece"), h.alias("hit")))
    return F.aggregate(pairs, zero, step, lambda acc: acc["found"])


def _survivors(found: Column) -> Column:
    """Detections that no stronger or equal one contains. They run by start, longest first, then priority."""
    zero = F.struct(*(F.lit(0).alias(f"end{p}") for p in (1, 2, 3)), F.array().cast(DETECTION).alias("kept"))

    def step(acc: Column, d: Column) -> Column:
        end, p = -d["neg_end"], d["priority"]
        reach = F.when(p == 1, acc["end1"]).when(p == 2, F.greatest(acc["end1"], acc["end2"])).otherwise(F.greatest(acc["end1"], acc["end2"], acc["end3"]))
        ends = [F.when(p == k, F.greatest(acc[f"end{k}"], end)).otherwise(acc[f"end{k}"]).cast("int").alias(f"end{k}") for k in (1, 2, 3)]
        return F.struct(*ends, F.when(reach >= end, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(d))).alias("kept"))

    return F.aggregate(F.array_sort(found), zero, step, lambda acc: acc["kept"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, detections, survivors, ...): one row per input row, without a shuffle.

    Base phrases report all their places; the labels are the base labels and those of the surviving detections. The
    score is the largest weight among surviving detections and base phrases, 0 without any. Null and empty texts have
    no words and no label; ties between rules that match the same words go by priority, then label. Rows that repeat
    are scanned each; null ids are kept; extra columns are ignored; an empty table gives an empty result.
    """
    squeezed = F.trim(F.regexp_replace(F.coalesce(text_col, F.lit("")), NOT_WORD, " "))
    rows = docs.select(F.col(id_col), F.concat(F.lit(" "), squeezed, F.lit(" ")).alias("form"))
    n_words = F.when(F.length("form") == 2, F.lit(0)).otherwise(_spaces(F.col("form")) - 1).cast("long")
    rows = rows.select(id_col, n_words.alias("n_words"), F.when(F.col("form").rlike(f"(?i){GATE}"), F.translate("form", UPPER, LOWER)).alias("form"))
    groups = F.filter(_rule_table(), lambda g: F.contains(F.col("form"), g["word"]))
    active = F.filter(F.flatten(F.transform(groups, lambda g: g["rules"])), lambda r: F.contains(F.col("form"), r["keyword"]))
    found = F.when(F.col("form").isNotNull(), F.flatten(F.transform(active, lambda r: _detections(F.col("form"), r))))
    rows = rows.withColumn("detections", F.coalesce(found, F.array().cast(DETECTION))).drop("form")
    return rows.withColumn("survivors", _survivors(F.col("detections")))


def licence_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score): one row per input row.

    Null and empty texts have no words, no places, empty labels and a score of 0; first_word and last_word are null without
    a base phrase. Ties, repeated rows, null ids and extra columns are as in ``scan``; an empty table gives an empty result.
    """
    base = F.filter("detections", lambda d: d["base"])
    names = lambda found: F.transform(found, lambda d: d["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    rows = scan(docs, id_col, text_col).withColumn("places", base)
    return rows.select(
        id_col,
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda d: d["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform("places", lambda d: d["start"])).cast("long").alias("last_word"),
        joined(names(F.col("places"))).alias("base_labels"),
        joined(F.concat(names(F.col("places")), names(F.col("survivors")))).alias("labels"),
        F.coalesce(F.array_max(F.transform(F.concat("places", "survivors"), lambda d: d["weight"])), F.lit(0.0)).alias("score"),
    )
