"""Shared-folder tables, shuffle clean-up and connected components for the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The only characters that separate words or are ignored by exact dedup: space, \t \n \v \f \r.
SPACE = r"[\x20\x09-\x0D]"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each made longer until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def small_batches(spark: SparkSession, size: str = "8MB") -> None:
    """Bound the Arrow batches between Spark and its Python workers by bytes, not by rows alone."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def give_back() -> None:
    """Return freed memory to the system. Workers are used again, so what one task held would stay with the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` whose tasks leave no free memory behind in their workers."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(rows)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``; a temporary one only where it is unset
    and driver and executors are one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def conf(spark: SparkSession, names: dict[str, str]):
    """Session settings for the jobs inside the block only."""
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write_table(df: DataFrame, path: str, by: str | None = None, codec: str = "snappy") -> None:
    """Write ``df`` and let Spark drop the shuffle files of that job as soon as it ends."""
    with conf(df.sparkSession, {SHUFFLE_CLEANUP: "true"}):
        writer = df.write.option("compression", codec)
        (writer.partitionBy(by) if by else writer).parquet(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df`` through a table in the shared folder; it outlives lost executors."""
    path = new_path(df.sparkSession, name)
    write_table(df, path)
    return df.sparkSession.read.parquet(path)


class Scratch:
    """Tables of one operator's call in a folder of their own, which goes when the call has written its result."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.count = spark, new_path(spark, name), 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        drop_path(self.spark, self.path)

    def table(self, df: DataFrame, name: str, by: str | None = None, codec: str = "snappy") -> DataFrame:
        """``df`` written and read again; with ``by``, as one table for each value of that column, all read together."""
        self.count += 1
        path = f"{self.path}/{self.count}-{name}"
        write_table(df, path, by, codec)
        schema = df.schema if by else None
        return (self.spark.read.schema(schema) if schema else self.spark.read).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Delete a table that nothing reads any more, ahead of the others."""
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            drop_path(self.spark, folder)


#: Keys that hold more than one row in this many are joined by broadcast; there are fewer of them than this.
COMMON = 10_000


def common_rows(rows: DataFrame, groups: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` left joined with ``groups(key, n, ...)``, one row for each key that n of the ``total`` rows have; the key is
    text or bytes.

    A key with more than one row in ``COMMON`` would fill a task of the shuffle; fewer than ``COMMON`` keys can have as many,
    so those meet their rows by broadcast. In the second join such rows have a key of their own each, that nothing matches.
    """
    names = [c for c in groups.columns if c != key]
    hot = F.col("n") > total // COMMON
    few = F.broadcast(groups.where(hot).select(key, F.struct(*names).alias("_few")))
    many = groups.where(~hot).select(F.col(key).alias("_key"), F.struct(*names).alias("_many"))
    met = rows.join(few, key, "left").withColumn("_at", F.md5(F.monotonically_increasing_id().cast("string")))
    own = F.when(F.col("_few").isNull(), F.col(key)).otherwise(F.concat(F.col(key), F.lit("/").cast(rows.schema[key].dataType), F.col("_at").cast(rows.schema[key].dataType)))
    met = met.withColumn("_own", own).join(many, F.col("_own") == F.col("_key"), "left").withColumn("_group", F.coalesce("_few", "_many"))
    return met.select(*rows.columns, *[F.col("_group")[c].alias(c) for c in names])


def components(nodes: DataFrame, links: DataFrame, work: Scratch) -> DataFrame:
    """(node, comp) for ``nodes(node)`` under undirected ``links(a, b)``; comp is one node of the component.

    Every round contracts the links: each component takes the smallest neighbour as its parent, parents are
    followed twice, and only links between different components go on. The links shrink by at least half a
    round, so rounds grow with the logarithm of the longest chain. Only the number of links left reaches the
    driver.
    """
    found, edges = None, links.select("a", "b").where("a <> b").distinct()
    while True:
        edges = work.table(edges, "edges")
        if edges.isEmpty():
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = work.table(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p")), "parents")
        for _ in range(2):
            up = step.select(F.col("a").alias("p"), F.col("p").alias("q"))
            step = work.table(step.join(up, "p").select("a", F.col("q").alias("p")), "parents")
        if found is None:
            found = step.select(F.col("a").alias("node"), F.col("p").alias("comp"))
        else:
            old = found
            found = work.table(
                old.join(step.withColumnRenamed("a", "comp"), "comp", "left").select("node", F.coalesce("p", "comp").alias("comp")), "comps"
            )
        left, right = step.select("a", F.col("p").alias("pa")), step.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        edges = edges.join(left, "a").join(right, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
    if found is None:
        return nodes.select("node", F.col("node").alias("comp"))
    return nodes.join(found, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))
