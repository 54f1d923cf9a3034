"""Folders that all executors share, and lineage cuts into them."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in local mode a new one where it is unset.

    What is put there stays until its owner clears it; spark.cleaner.referenceTracking.cleanCheckpoints lets
    Spark remove checkpoints that nothing refers to any more.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let Spark remove shuffle files, and checkpoints where it may, that nothing refers to any more.

    It learns of them only as the driver collects garbage, which without a call may be after the last of many
    passes (spark.cleaner.periodicGC.interval is half an hour), so all would stand on disk at once.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def running_total(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """df with the sum of value up to each row in order (whose values are distinct).

    Rows are dealt over ranges of order and summed in them; of the ranges only their sums come together.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sums = ranged.groupBy("_part").agg(F.sum(value).alias("_sum")).select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = W.partitionBy("_part").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return ranged.join(F.broadcast(sums), "_part").withColumn(name, F.col("_before") + F.sum(value).over(within)).drop("_part", "_before")
