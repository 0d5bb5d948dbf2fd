"""Run statistics kept as tables: bucketed by instance for the pair reports, and exported in one order over numbered files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import splits


def store_runs(runs: DataFrame, table: str, buckets: int) -> None:
    """``runs(instance_no, run_id, ...)`` as a table bucketed by instance, so that pairs are made without an exchange.

    The rows are dealt by instance first, so each bucket is one file. Take about as many buckets as the table has blocks.
    """
    runs.repartition(buckets, "instance_no").write.bucketBy(buckets, "instance_no").sortBy("instance_no").mode("overwrite").saveAsTable(table)


def export_ordered(rows: DataFrame, path: str, keys: list[str], form: str = "json") -> None:
    """Numbered files under ``path`` which, read one after another, hold ``rows`` in the order of ``keys``.

    Rows are dealt by ranges of the keys and sorted in their range, so no task has more than its range and the files keep
    the numbers of their ranges. Keys should tell rows apart: rows that share them share a range.
    """
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").format(form).option("ignoreNullFields", False).save(path)


def read_ordered(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What ``export_ordered`` wrote as JSON, with ``place``: the number of the row over all files, from 0."""
    lines = splits.pieces(spark, path, "\n", "part-*").drop("file_size")
    in_file = splits.sum_before(lines, F.lit(1), "line_no")
    sizes = lines.groupBy("path").agg(F.count("*").alias("n"))
    before = Window.orderBy(F.substring_index("path", "/", -1)).rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    out = in_file.join(F.broadcast(sizes), "path").select((F.col("before") + F.col("line_no")).alias("place"), F.from_json("value", schema).alias("r"))
    return out.select("place", "r.*")


def model_family(name: Column, two: bool = False) -> Column:
    """gpt5 or claude by what a model's name holds, else null; of ``two`` families, all that isn't gpt5 is claude."""
    low = F.lower(name)
    return F.when(F.contains(low, F.lit("gpt")), "gpt5").when(F.lit(two) | F.contains(low, F.lit("claude")), "claude")
