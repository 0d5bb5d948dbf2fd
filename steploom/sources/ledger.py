"""A ledger of the files that a mart was built from, so that each run reads new and changed files only.

A run is a commit with a number. Its rows go to ``<mart>/commit=<n>`` first and its entries (a path, its version, whether it
is there) to ``<ledger>/commit=<n>`` last, by a rename. Rows count only where the newest entry of their file is of the same
commit, so a changed or deleted file needs no rewrite of older rows. A run that ends before its rename leaves rows that
nothing counts, and the next run takes its number and replaces them: nothing is repeated or dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRIES = "path string, version string, present boolean, commit int"


class Ledger:
    """``rule_version`` is part of each file's version: with another one, all files are read again."""

    def __init__(self, spark: SparkSession, path: str, mart: str, rule_version: str = "1"):
        self.spark, self.path, self.mart, self.rule_version = spark, path, mart, rule_version

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _exists(self, path: str) -> bool:
        fs, target = self._fs(path)
        return fs.exists(target)

    def entries(self) -> DataFrame:
        """The newest entry of each file."""
        if not self._exists(self.path):
            return self.spark.createDataFrame([], ENTRIES)
        newest = F.max_by(F.struct("version", "present", "commit"), "commit")
        return self.spark.read.schema(ENTRIES).parquet(self.path).groupBy("path").agg(newest.alias("e")).select("path", "e.*")

    def next_commit(self) -> int:
        if not self._exists(self.path):
            return 0
        fs, target = self._fs(self.path)
        done = [s.getPath().getName() for s in fs.listStatus(target)]
        return 1 + max((int(n.removeprefix("commit=")) for n in done if n.startswith("commit=")), default=-1)

    def listing(self, root: str, pattern: str = "*.jsonl") -> DataFrame:
        """(path, version) of the files that are there: size, time of change, and the version of the rules. Contents aren't read."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
        version = F.concat_ws(":", F.lit(self.rule_version), "length", F.unix_micros("modificationTime"))
        return files.select("path", version.alias("version"))

    def changes(self, listing: DataFrame) -> DataFrame:
        """(path, version, present): files that are new or changed, and files of the ledger that are gone."""
        known = self.entries().where("present").select("path", F.col("version").alias("old"))
        both = listing.join(known, "path", "full").where("version is null or old is null or version <> old")
        return both.select("path", F.coalesce("version", "old").alias("version"), F.col("version").isNotNull().alias("present"))

    def run(self, root: str, build: Callable[[list[str]], DataFrame], pattern: str = "*.jsonl") -> int | None:
        """Read what changed under ``root``: ``build(paths)`` gives the mart's rows with their ``path``. The number of the commit,
        or None if nothing changed. The driver lists the paths that are to be read, as every read of files does."""
        number = self.next_commit()
        staged = f"{self.path}-staged"
        self.changes(self.listing(root, pattern)).withColumn("commit", F.lit(number)).write.mode("overwrite").parquet(staged)
        changed = self.spark.read.schema(ENTRIES).parquet(staged)
        if changed.isEmpty():
            return None
        paths = [r["path"] for r in changed.where("present").select("path").toLocalIterator()]
        if paths:
            build(paths).write.mode("overwrite").parquet(f"{self.mart}/commit={number}")
        self._commit(staged, number)
        return number

    def _commit(self, staged: str, number: int) -> None:
        fs, source = self._fs(staged)
        _, folder = self._fs(self.path)
        fs.mkdirs(folder)
        _, target = self._fs(f"{self.path}/commit={number}")
        if fs.exists(target) or not fs.rename(source, target):
            raise RuntimeError(f"commit {number} of {self.path} is there already: another run was faster")

    def rows(self) -> DataFrame:
        """The mart: the rows of each file that its newest entry wrote."""
        current = self.entries().where("present").select("path", "commit")
        return self.spark.read.option("basePath", self.mart).parquet(self.mart).join(current, ["path", "commit"], "left_semi").drop("commit")
