"""The tables of a corpus folder, and helpers for data that must survive the loss of an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_base(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Only a session on one machine may do without: it gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="statutor-")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a table that all executors can read."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the session's shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_base(df.sparkSession))
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """The frame in as many partitions as there are cores, if it has fewer.

    Work that costs much for each byte is held up where a small table comes in one or two splits. A table with more splits
    than cores is left as it is, so that at most a few splits' worth of data is ever moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def ranked(df: DataFrame, by: list[str], order: list[str], name: str = "place") -> DataFrame:
    """Adds ``name``: each row's place (from 0) among those of equal ``by``, in the order of ``order``, nulls first.

    A group of any size is ranked in slices: rows are sorted into ranges of (``by``, ``order``), ranked within their range,
    and what earlier ranges hold of the group is added, so that no group comes together in one task.
    """
    d = cut(df.repartitionByRange(*by, *order).withColumn("_slice", F.spark_partition_id()))
    sizes = d.groupBy(*by, "_slice").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_slice")) - F.col("_n")
    heads = sizes.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_slice").alias("_at"), before.alias("_before"))
    match = F.col("_slice") == F.col("_at")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_{c}"))
    inside = F.row_number().over(Window.partitionBy(*by, "_slice").orderBy(*order)) - 1
    return d.withColumn("_inside", inside).join(heads, match).select(*df.columns, (F.col("_before") + F.col("_inside")).alias(name))
