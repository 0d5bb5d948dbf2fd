"""Marts kept by a stream of transcripts: each batch is labelled once, and every mart adds its part of the batch.

A file holds whole sessions, so sessions and runs never span batches: counts of steps and of distinct runs of a batch add up
to those of all files. A batch writes under its own number and is marked as done last. One that fails is run again with the
same files and replaces what it wrote; until then nothing of it counts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import transcripts as T
from ..operators.labels import with_modes
from ..operators.sequences import sequence_labels
from ..sources import ingest

FILES = "path string, modificationTime timestamp, length long, content binary"


@dataclass(frozen=True)
class Additive:
    """A mart of sums: the rows that count, their keys, and named sums over each key, as SQL."""

    keys: list[str]
    sums: dict[str, str]
    where: str = "true"

    def part(self, steps: DataFrame) -> DataFrame:
        return steps.where(self.where).groupBy(*self.keys).agg(*[F.expr(c).alias(name) for name, c in self.sums.items()])

    def whole(self, parts: DataFrame) -> DataFrame:
        return parts.groupBy(*self.keys).agg(*[F.sum(name).alias(name) for name in self.sums])


N = {"n": "count(*)"}
RUNS = {"n_runs": "count(distinct run_id)"}
OUTCOMES = {f"n_{name}": f"count_if(outcome = '{outcome}')" for name, outcome in (("pass", "pass"), ("fail", "fail"), ("unknown", ""))}

MARTS = {
    "intents": Additive(["model", "intent"], N | RUNS),
    "categories": Additive(["model", "category"], N),
    "phases": Additive(["model", "phase"], N),
    "outcomes": Additive(["model"], OUTCOMES | {"total": "count(*)"}),
    "sequence_labels": Additive(["model", "seq"], N, "seq <> 'seq-none'"),
    "modes": Additive(["model", "mode"], N | RUNS, "mode is not null"),
    "models": Additive(["model"], {"n_steps": "count(*)"} | RUNS),
}


def label_events(events: DataFrame) -> DataFrame:
    """All labels of the calls of ``events``."""
    return with_modes(sequence_labels(T.steps(T.labelled_calls(events), T.main_model(events))))


def transcript_steps(spark: SparkSession, paths: list[str], pattern: str) -> DataFrame:
    """All labels of the calls of some transcripts; sessions are named by their files."""
    return label_events(T.by_session(ingest.transcripts(spark, paths, pattern=pattern)))


def stream_marts(
    spark: SparkSession, root: str, path: str, marts: dict[str, Additive] = MARTS, pattern: str = "*.jsonl", files_per_batch: int = 1000,
    steps: Callable[[SparkSession, list[str], str], DataFrame] = transcript_steps,
) -> None:
    """Read the files under ``root`` that are new since the last call into the marts under ``path``.

    The stream carries paths only; a batch reads its files in blocks, as many tasks as they need. The driver holds the paths
    of one batch, ``files_per_batch`` at most.
    """

    def add(batch: DataFrame, number: int) -> None:
        paths = [r["path"] for r in batch.collect()]
        place = lambda name: f"{path}/{name}/batch={number}"
        steps(batch.sparkSession, paths, pattern).write.mode("overwrite").parquet(place("steps"))
        labelled = batch.sparkSession.read.parquet(place("steps"))
        for name, mart in marts.items():
            mart.part(labelled).write.mode("overwrite").parquet(place(name))
        batch.agg(F.count("*").alias("n_files")).write.mode("overwrite").parquet(place("done"))

    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    new = files.option("maxFilesPerTrigger", files_per_batch).load(root).select("path")
    new.writeStream.foreachBatch(add).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()


def read_streamed(spark: SparkSession, path: str, name: str, marts: dict[str, Additive] = MARTS) -> DataFrame:
    """A mart over all batches that are done."""
    done = spark.read.parquet(f"{path}/done").select("batch").distinct()
    return marts[name].whole(spark.read.parquet(f"{path}/{name}").join(F.broadcast(done), "batch", "left_semi"))  # a row per batch
