"""Files larger than a task: pieces between separators, in file order, without a whole file in a row.

Spark reads a large file in blocks, several tasks at a time. A piece's place is (block start, order in the scan of the
block), so running sums over a file need two small steps: within a block, and over the totals of its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def pieces(spark: SparkSession, root: str | list[str], separator: str, pattern: str | None = None) -> DataFrame:
    """(path, file_size, block, at, value): the text between separators; ``at`` orders the pieces of a block.

    The last piece of a file is left out if it is empty. A separator must not overlap with itself.
    """
    reader = spark.read.option("lineSep", separator).option("recursiveFileLookup", True)
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    m = "_metadata.file_"
    return reader.text(root).select(F.col(f"{m}path").alias("path"), F.col(f"{m}size").alias("file_size"), F.col(f"{m}block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def block_window() -> Window:
    """The pieces of one block in order."""
    return Window.partitionBy("path", "block").orderBy("at")


def sum_before(rows: DataFrame, amount: Column, out: str) -> DataFrame:
    """``rows(path, block, at, ...)`` with the sum of ``amount`` over all earlier pieces of the file."""
    totals = rows.groupBy("path", "block").agg(F.sum(amount).alias("_total"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_blocks", F.coalesce(F.sum("_total").over(earlier), F.lit(0))).drop("_total")
    inside = F.coalesce(F.sum(amount).over(block_window().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_inside", inside).join(totals, ["path", "block"]).withColumn(out, F.col("_blocks") + F.col("_inside")).drop("_blocks", "_inside")


def last_before(rows: DataFrame, value: Column, out: str) -> DataFrame:
    """``rows(path, block, at, ...)`` with the last value that isn't null at or before each piece of the file."""
    ends = rows.groupBy("path", "block").agg(F.max_by(value, F.when(value.isNotNull(), F.col("at"))).alias("_end"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(earlier)).drop("_end")
    inside = F.last(value, ignorenulls=True).over(block_window().rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_inside", inside).join(ends, ["path", "block"]).withColumn(out, F.coalesce("_inside", "_carried")).drop("_inside", "_carried")
