"""Connected components over string-keyed links, with every round in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, as in tests on one machine, one is made and set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="weft-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: What is read and shuffled by one task, at most about; rows repeat so much that a megabyte on disk may be fifty in memory.
SMALL = {"spark.sql.files.maxPartitionBytes": "4m", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m", "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1000"}
#: Rows of a file: a file's rows are one row group, which no number of tasks divides.
FILE_ROWS = 250_000


@contextmanager
def small_tasks(spark: SparkSession) -> Iterator[None]:
    """What is run inside is cut into as many tasks as its bytes ask for, so that none grows with the tables."""
    had = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in had.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def shared_table(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back, so lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"
    with small_tasks(spark):
        df.write.option("maxRecordsPerFile", FILE_ROWS).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that a task sorts or gathers at once.
TASK_ROWS = 250_000


def spread(df: DataFrame, rows: int, *keys: str | Column) -> DataFrame:
    """``df`` of about so many rows by hash of the keys, in partitions of ``TASK_ROWS``, which aren't merged whatever their bytes are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(-(-rows // TASK_ROWS), min(cores, 1 + rows // 10_000)), *keys)


def components(links: DataFrame) -> DataFrame:
    """node, root (the least node of its component) of every node in links (a, b).

    Alternating large-star and small-star steps, each a minimum by node and a join: no neighbourhood is
    held in one row.
    """
    now = shared_table(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    seen = None
    while True:
        both = now.select("a", "b").union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a AND m <> b").select(F.col("b").alias("u"), F.col("m").alias("v")).distinct()
        large = shared_table(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select("m", F.col("v").alias("b")).union(least.select("m", "u"))
        now = shared_table(small.select(F.col("m").alias("a"), "b").where("a <> b").distinct())
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select("a", "a")).distinct()


def grouped(rows: DataFrame, left: str, right: str, to: str) -> DataFrame:
    """``rows`` with the component that their ``left`` and ``right`` values belong to, in ``to``."""
    a, b = F.concat(F.lit("l:"), F.col(left)), F.concat(F.lit("r:"), F.col(right))
    roots = components(rows.select(a.alias("a"), b.alias("b")))
    return rows.withColumn("__node", a).join(roots.select(F.col("node").alias("__node"), F.col("root").alias(to)), "__node").drop("__node")
