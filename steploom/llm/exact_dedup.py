"""Exact dedup: group by a 128-bit content hash, keep one stable row, compare bytes inside the groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Scratch, materialise, unused


def normalised(text: str | Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", "")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes without white space are equal. The row with the longest original text
    (code points) stays, then the smallest id; a null id sorts last. Null and empty texts are one group. Rows that
    repeat an id and a text are counted, and each copy of the best row says kept. Extra columns are ignored.
    An empty table gives an empty result.

    The bytes are compared by the aggregate of a group: its smallest and its largest text are the same only if all its
    texts are. Tasks aggregate their rows before they shuffle them, so a group with a third of all rows is one row of a
    task, and a text is shuffled once. Rows then meet their group without their text, in a join that adaptive execution
    can split. Groups of different texts (a collision of the 128-bit hash) are made again by the text itself.
    """
    return _groups(docs, id_col, text_col).select(id_col, "keep_id", "group_size", "kept", "text_sha256")


def _groups(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """What ``exact_groups`` returns, with the length of each original text as n_chars."""
    text = F.coalesce(text_col, F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.length(text).alias("n_chars"), normalised(text_col).alias("norm"))
    rows = rows.withColumn("hash", F.unhex(F.md5("norm")))
    # One order for "best row": longer first, then smaller id, null ids last.
    rank = F.struct((-F.col("n_chars")).alias("neg"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id"))
    stats = F.min(rank).alias("best"), F.count("*").alias("n")
    with Scratch(docs.sparkSession, "exact") as work:
        groups = work.table(rows.groupBy("hash").agg(*stats, (F.min("norm") == F.max("norm")).alias("same")), "groups")
        narrow = rows.select("id", "n_chars", "hash", F.unhex(F.sha2("norm", 256)).alias("sha"))
        found = _verdict(narrow.join(groups.where("same"), "hash"), id_col)
        mixed = groups.where("not same").select("hash")
        if not mixed.isEmpty():
            apart = rows.join(mixed, "hash")
            apart = apart.join(apart.groupBy("hash", "norm").agg(*stats), ["hash", "norm"])
            found = found.unionByName(_verdict(apart.withColumn("sha", F.unhex(F.sha2("norm", 256))), id_col))
        return materialise(found, "exact")


def _verdict(rows: DataFrame, id_col: str) -> DataFrame:
    return rows.select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("id").eqNullSafe(F.col("best.id")) & (F.col("n_chars") == -F.col("best.neg"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "n_chars",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: of each group the longest text, then the smallest id, null ids last.

    Of rows that repeat an id, a length and a normalised text, one stays. Null and empty texts are one group. An empty
    table gives an empty result.
    """
    own, n_own, k_id, k_sha, k_chars, k_times = unused(docs, "own_sha", "own_chars", "kept_id", "kept_sha", "kept_chars", "kept_times")
    with Scratch(docs.sparkSession, "exact") as work:
        judged = _groups(docs, id_col, text_col)
        best = judged.where("kept").groupBy(F.col(id_col).alias(k_id), F.col("text_sha256").alias(k_sha), F.col("n_chars").alias(k_chars))
        keep = materialise(best.agg(F.count("*").alias(k_times)), "kept")
        work.drop(judged)
    rows = docs.withColumn(own, F.sha2(normalised(text_col), 256)).withColumn(n_own, F.length(F.coalesce(text_col, F.lit(""))))
    rows = rows.join(keep, F.col(id_col).eqNullSafe(F.col(k_id)) & (F.col(own) == F.col(k_sha)) & (F.col(n_own) == F.col(k_chars)))
    once = rows.where(F.col(k_times) == 1).select(*docs.columns)
    if keep.where(F.col(k_times) > 1).isEmpty():
        return once
    one = rows.where(F.col(k_times) > 1).groupBy(k_id, k_sha, k_chars).agg(F.max_by(F.struct(*docs.columns), F.struct(F.coalesce(text_col, F.lit("")))).alias("row"))
    return once.unionByName(one.select("row.*"))
