"""New log files as a stream: each is one whole run or session, so batches need no state of one another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest_stream(spark: SparkSession, root: str, checkpoint: str, sink: Callable[[DataFrame, int], None], pattern: str = "*.jsonl") -> None:
    """Hand every new file to ``sink(batch, id)`` once, whole: one file is one session, so no state crosses batches."""
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    files = files.select(F.col("_metadata.file_path").alias("path"), "value")
    query = files.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def count_into(path: str, keys: list[str], rows: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A sink that adds counts by ``keys`` of each batch's rows to a table; a batch that is run again replaces its part."""

    def sink(batch: DataFrame, number: int) -> None:
        counts = rows(batch).groupBy(*keys).agg(F.count("*").alias("n"))
        counts.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return sink


def totals(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The sums of what ``count_into`` wrote."""
    return spark.read.parquet(path).groupBy(*keys).agg(F.sum("n").alias("n"))
