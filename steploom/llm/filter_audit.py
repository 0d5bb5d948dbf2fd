"""Filter interaction audit: what each filter removes, finds removed already, or alone removes, in every order of filters.

Each filter has a table of the ids that fail it. All counts come from left-anti and left-semi joins of these tables:

* removed by a filter behind a prefix of others: its failing ids, without (left-anti) those that fail a filter of the prefix;
* redundant: its failing ids that also (left-semi) fail a filter of the prefix;
* failing it alone: its failing ids, without those that fail any other;
* label losses: the same with the failing ids that are also (left-semi) ids of good or of toxic documents;
* survivors: all ids of the part without those that the filters so far removed.

What a prefix removes doesn't depend on its order, so the joins are over 16 sets of earlier filters for each filter rather
than over all orders; orders are put together from those counts.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, UPPER, Scratch, common_rows, materialise

#: Filters in the order of their bits.
FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MIN_WORDS = 200


def bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def text_failures(text: Column) -> Column:
    """The letters of the filters of A to D that a text fails, as an array."""
    words = F.regexp_extract_all(text, F.lit(f"[^{SPACE[1:]}+"), F.lit(0))
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    failed = {
        "A": F.size(words) < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }
    return F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in failed.items())))


def _repeats(base: DataFrame, work: Scratch) -> DataFrame:
    """Rows of ``base`` whose text a row of a smaller id has too."""
    groups = base.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null")
    met = common_rows(base.select("row", "doc_id", "part", "digest"), work.table(groups, "texts"), "digest", base.count())
    return met.where("doc_id > first_id").select("row", "doc_id", "part")


def failing_ids(docs: DataFrame, work: Scratch, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(parts, failing): the rows of each part, and one table of failing ids for each filter, read as one with a column ``filter``."""
    text = F.coalesce(text_col, F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(source_col, F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text_failures(text).alias("failed"))
    base = work.table(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    failing = base.select("row", "doc_id", "part", F.explode("failed").alias("filter")).unionByName(_repeats(base, work).withColumn("filter", F.lit("E")))
    return base.groupBy("part").agg(F.count("*").alias("n")), work.table(failing, "failing", by="filter")


def _earlier(mine: DataFrame, failing: DataFrame, how: str) -> DataFrame:
    """(tag, part, filter, earlier, n): ids of ``mine`` counted behind each set of other filters; ``how`` says whether they
    must (left_semi) or must not (left_anti) fail one of the set."""
    own = F.col("bit")
    sets = mine.withColumn("earlier", F.explode(F.filter(F.sequence(F.lit(0), F.lit(2 ** len(FILTERS) - 1)), lambda s: s.bitwiseAND(own) == 0)))
    other = failing.select(F.col("row").alias("other_row"), F.col("bit").alias("other_bit"))
    met = sets.join(other, (F.col("row") == F.col("other_row")) & (F.col("earlier").bitwiseAND(F.col("other_bit")) != 0), how)
    return met.groupBy("tag", "part", "filter", "earlier").agg(F.count("*").alias("n"))


def _rules() -> Column:
    """One struct per order and step: filter_order, step, filter, earlier."""
    rows = [(order, k + 1, letter, sum(map(bit, order[:k]))) for order in ORDERS for k, letter in enumerate(order)]
    return F.from_json(
        F.lit("[" + ",".join(f'{{"filter_order":"{o}","step":{s},"filter":"{f}","earlier":{e}}}' for o, s, f, e in rows) + "]"),
        "array<struct<filter_order:string,step:int,filter:string,earlier:int>>",
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per part (source), order of the five filters and step: part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley.

    A fails texts of fewer than 200 words, B those with fewer than half as many different words as words, C those with
    capitals on more than two of 100 code points, D those with a character of ``#$%&*|``, E those that equal a text of
    a smaller id. Null texts and null sources count as empty; a null id is neither smaller nor larger than another and has
    no label. Rows that repeat an id count each, and don't fail E by one another. Documents are good or toxic if any of
    their labels says so. Extra columns are ignored; without rows there are no parts and no result.

    Only failing ids are shuffled, by row, and each meets the sets of earlier filters inside its task.
    """
    with Scratch(docs.sparkSession, "audit") as work:
        parts, failing = failing_ids(docs, work, id_col, text_col, source_col)
        failing = failing.withColumn("bit", F.element_at(F.create_map(*(F.lit(x) for k in FILTERS for x in (k, bit(k)))), F.col("filter")))
        # The failing ids of all documents, of good and of toxic ones, as one table with a tag.
        tagged = failing.withColumn("tag", F.lit("all"))
        for tag, column in (("good", "quality"), ("toxic", "toxic")):
            ids = labels.where(f"{column} = 1").select(F.col("doc_id").alias("label_id"))
            tagged = tagged.unionByName(failing.join(ids, F.col("doc_id") == F.col("label_id"), "left_semi").withColumn("tag", F.lit(tag)))
        tagged = work.table(tagged, "tagged")
        kept_out = work.table(_earlier(tagged, failing, "left_anti"), "removed")
        seen = _earlier(tagged.where("tag = 'all'"), failing, "left_semi")
        keys = ["part", "filter", "earlier"]
        pick = lambda tag: F.coalesce(F.sum(F.when(F.col("tag") == tag, F.col("n"))), F.lit(0)).alias(tag)
        counts = kept_out.unionByName(seen.withColumn("tag", F.lit("redundant"))).groupBy(*keys).agg(*map(pick, ("all", "redundant", "good", "toxic")))
        # Over all orders, a set of k earlier filters stands before a filter k! (4 - k)! times; all four others: it fails alone.
        times = F.element_at(F.array(*(F.lit(factorial(k) * factorial(len(FILTERS) - 1 - k)) for k in range(len(FILTERS)))), F.bit_count("earlier") + 1)
        alone = F.coalesce(F.sum(F.when(F.bit_count("earlier") == len(FILTERS) - 1, F.col("all"))), F.lit(0))
        filters = counts.groupBy("part", "filter").agg(F.sum(F.col("all") * times).alias("shapley"), alone.alias("unique_fails"))
        steps = parts.select("part", F.col("n").alias("total"), F.explode(_rules()).alias("r")).select("part", "total", "r.*")
        rows = steps.join(counts, keys, "left").join(filters, ["part", "filter"], "left").na.fill(0)
        so_far = Window.partitionBy("part", "filter_order").orderBy("step")
        result = rows.select(
            "part", "filter_order", "step", (F.col("total") - F.sum("all").over(so_far)).alias("kept"), F.col("all").alias("removed"), "redundant",
            "unique_fails", F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley",
        )
        return materialise(result, "audit")
