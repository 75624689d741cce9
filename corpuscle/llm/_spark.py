"""Spark helpers of this subpackage: tables in the shared folder, components of a graph."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.plans.ship import ship


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="corpuscle-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


class Tables:
    """Parquet tables of one run in the shared folder: they cut lineage and outlive executors."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = ship(spark), f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._cleaned = time.monotonic()

    def write(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """Writes df once and returns the written table."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").options(**options).parquet(path)
        if time.monotonic() - self._cleaned > 3:  # lets Spark remove the shuffle files of finished jobs
            self.spark.sparkContext._jvm.System.gc()
            self._cleaned = time.monotonic()
        return self.spark.read.schema(df.schema).parquet(path)

    def is_empty(self, name: str) -> bool:
        """If a written table has no row."""
        return not self.spark.read.parquet(f"{self.root}/{name}").limit(1).count()

    def drop(self, name: str) -> None:
        """Removes a table on which nothing depends any more."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


KEY = "_corpuscle_key"


def keyed(tables: Tables, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(docs with a column KEY, one row (doc_id, text) for each key), for operators that cut texts by place.

    KEY is doc_id, so rows that repeat a doc_id and its text are one document. Of
    an id with several texts only that with the least hash has the key; rows with
    the others, and rows without a doc_id, have none: they are not documents to be
    matched and stay as they are.
    """
    own, h = F.col("doc_id").cast("long"), F.xxhash64("text")
    many = docs.select(own.alias("_id"), h.alias("_h")).groupBy("_id").agg(F.count("*").alias("n"), F.min("_h").alias("_h"))
    many = tables.write(many.where("n > 1 and _id is not null").drop("n"), "repeated-ids")
    if not many.limit(1).count():
        docs = docs.withColumn(KEY, own)
        return docs, docs.where(F.col(KEY).isNotNull()).select(F.col(KEY).alias("doc_id"), "text")
    columns = docs.columns
    docs = docs.join(many, own == F.col("_id"), "left").select(*columns, F.when(F.col("_h").isNull() | (F.col("_h") == h), own).alias(KEY))
    return docs, docs.where(F.col(KEY).isNotNull()).select(F.col(KEY).alias("doc_id"), "text").dropDuplicates(["doc_id"])


def components(tables: Tables, edges: DataFrame, name: str = "cc", max_rounds: int = 40) -> DataFrame:
    """(id, component) of every node of edges (a, b); component is the smallest id reachable.

    Alternating large-star and small-star rounds. Every round is a pair of
    shuffled minimum aggregations with map-side combination, and the minima are
    written before they are joined, so that the join of a node with many links can
    be split. The number of rounds grows with the logarithm of the node count. A
    round's first minima tell if all is settled: then every node is the least of
    its neighbours or has one neighbour alone, and the minima are the result, so
    that no round is spent on finding that nothing changes. Each round's edges are
    written to the shared folder.
    """
    hi, lo = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    now = tables.write(edges.where("a <> b").select(hi, lo), f"{name}0")
    for k in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ends = both.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("most"))
        low = tables.write(ends.select("a", F.least("a", "m").alias("m"), F.expr("m < a and m < most").alias("open")), f"{name}low{k}")
        if not low.agg(F.count_if("open")).first()[0]:
            tables.drop(f"{name}{k}")
            return low.select(F.col("a").alias("id"), F.col("m").alias("component"))
        # at most one row for each edge, so repeats may stay until the round's end
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: a node's smaller neighbours and itself are tied to the smallest of them
        large = tables.write(large, f"{name}large{k}")
        least = tables.write(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}least{k}")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        small = small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        now = tables.write(small, f"{name}{k + 1}")
        for part in (f"{k}", f"low{k}", f"large{k}", f"least{k}"):
            tables.drop(f"{name}{part}")
    raise RuntimeError("components did not settle")
