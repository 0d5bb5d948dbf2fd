"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, Scratch, materialise, unused

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: A source is repeated this often at most.
MAX_REPEATS = 3
#: Documents of a source are ranked in blocks: by the binary logarithm of their size, in eighths, and a hash of the id,
#: in as many ranges as keep this many documents in a block even if all are of one source and size.
BLOCK_ROWS = 100_000


def word_count(text: str | Column) -> Column:
    """Number of runs of characters other than white space; null counts 0."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), f"[^\\x20\\x09-\\x0D]+", "w")
    return F.length(F.regexp_replace(squeezed, SPACE, "")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) for ``sizes(source, source_size)``, one row per source.

    Water-filling: a source gets level * weight, but max_repeats times its size at most. The sources are sorted by
    the level at which they are full; the first k are full, and the rest share what is left by weight, at the
    smallest k for which no further one is above. This is where resharing the excess again and again ends.
    Sources without words get 0. The windows read one row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    capped = sizes.select("source", "source_size", weight.alias("weight"), (F.lit(float(max_repeats)) * F.col("source_size")).alias("cap"))
    capped = capped.withColumn("full_at", F.col("cap") / F.col("weight"))
    before = Window.orderBy("full_at", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    leveled = capped.withColumn("level", level)
    # The first source that isn't full at its level sets the level of the rest.
    first = F.min(F.when(F.col("full_at") > F.col("level"), F.struct("full_at", "level"))).over(everything)
    return leveled.withColumn("set", first["level"]).select(
        "source", "source_size", F.when(F.col("set").isNull() | (F.col("full_at") <= F.col("set")), F.col("cap")).otherwise(F.col("set") * F.col("weight")).alias("target")
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = "mix") -> DataFrame:
    """(id, source, size, source_size, target, copies): how often the mix takes each row.

    A source's expected copies per document are target / source_size. Their running sum over the source's documents
    plus one offset is rounded down; a document is taken once per integer that the sum passes. The documents run in
    order of size, so that what is taken follows the target in words, not only in documents.

    The running sum has two levels: blocks of a source (size class, range of a hash of the id) are counted and summed
    in a small table, then each block ranks its own documents. The order doesn't depend on the number of blocks.
    Null source is a source of its own, sorted last; null text has size 0; null ids are ranked by an empty hash;
    rows that repeat are separate documents. Empty tables give an empty result. Extra columns are ignored.
    """
    with Scratch(docs.sparkSession, "mixing") as work:
        return materialise(_mix(docs, id_col, text_col, source_col, weights, max_repeats, seed, work).drop("mark"), "mix")


def _mix(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple, max_repeats: int, seed: str, work: Scratch) -> DataFrame:
    size = word_count(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(source_col, text_col).alias("mark"))
    digest = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))
    rows = rows.withColumn("class", F.when(F.col("size") > 0, F.floor(8 * F.log2(F.col("size").cast("double")))).otherwise(-1).cast("int"))
    rows = work.table(rows.withColumn("hash", F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")), "sizes")
    bits = max(0, math.ceil(math.log2(max(rows.count(), 1) / BLOCK_ROWS)))
    rows = rows.withColumn("bin", F.shiftright("hash", 32 - bits))
    blocks = work.table(rows.groupBy("source", "class", "bin").agg(F.count("*").alias("n"), F.sum("size").alias("words")), "blocks")
    totals = blocks.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = work.table(source_targets(totals, weights, max_repeats), "targets")
    up_to = Window.partitionBy("source").orderBy("class", "bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("source", "class", "bin", F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("start"))
    starts = work.table(starts.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select("b.*", "source_size", "target"), "starts")
    place = Window.partitionBy("source", "class", "bin").orderBy("hash", "size", F.col("id").isNull(), "id")
    ranked = rows.withColumn("rank", F.row_number().over(place))
    r, b = ranked.alias("r"), starts.alias("b")
    joined = r.join(b, F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.class") == F.col("b.class")) & (F.col("r.bin") == F.col("b.bin"))).select(
        "r.id", "r.source", "r.size", "r.mark", "b.source_size", "b.target", (F.col("start") + F.col("rank")).alias("rank")
    )
    # An offset in steps of 2**-20 keeps whole rates exact.
    tag = F.md5(F.concat(F.lit(seed + ":"), F.coalesce("source", F.lit("\x00null"))))
    offset = F.conv(F.substring(tag, 1, 5), 16, 10).cast("double") / F.lit(float(16**5))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = joined.withColumn("rate", rate).withColumn("offset", offset)
    crossed = F.floor(F.col("offset") + F.col("rate") * F.col("rank")) - F.floor(F.col("offset") + F.col("rate") * (F.col("rank") - 1))
    copies = F.least(F.greatest(crossed, F.floor("rate")), F.ceil("rate")).cast("long")
    return joined.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", copies.alias("copies"), "mark")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = "mix") -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as the mix takes it.

    The copies of rows that repeat an id, a text and a source are dealt to them evenly. An empty table gives an empty
    result.
    """
    m_id, m_mark, m_sum, m_n, m_nth, m_copy = unused(docs, "mix_id", "mix_mark", "mix_sum", "mix_n", "mix_nth", "mix_copy")
    with Scratch(docs.sparkSession, "mixing") as work:
        plan = _mix(docs, id_col, text_col, source_col, weights, max_repeats, seed, work)
        plan = plan.groupBy(F.col(id_col).alias(m_id), F.col("mark").alias(m_mark)).agg(F.sum("copies").alias(m_sum), F.count("*").alias(m_n))
        plan = materialise(plan.where(F.col(m_sum) > 0), "mix")
    rows = docs.join(plan, F.col(id_col).eqNullSafe(F.col(m_id)) & (F.xxhash64(source_col, text_col) == F.col(m_mark)))
    once = rows.where(F.col(m_n) == 1)
    if not plan.where(F.col(m_n) > 1).isEmpty():
        again = rows.where(F.col(m_n) > 1).withColumn(m_nth, F.row_number().over(Window.partitionBy(m_id, m_mark).orderBy(F.lit(1))))
        total, nth, n = F.col(m_sum), F.col(m_nth), F.col(m_n)
        share = F.floor(total * nth / n) - F.floor(total * (nth - 1) / n)
        once = once.unionByName(again.withColumn(m_sum, share).where(F.col(m_sum) > 0).drop(m_nth))
    return once.withColumn(m_copy, F.explode(F.sequence(F.lit(1), F.col(m_sum)))).select(*docs.columns)
