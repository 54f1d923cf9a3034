"""Shared helpers: lineage cuts, shared folders, global ranks and word counts."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..storage import cut, new_folder, release, shared_dir  # noqa: F401

#: Words are runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lean(function):
    """A function of Arrow batches that gives its memory back at the end of a task: its worker lives on."""

    def run(batches):
        yield from function(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim:
            trim(0)

    return run


_ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of `name type, ...`, for plain types and arrays of them; needs no session, so tasks can use it."""
    fields = [field.split() for field in ddl.split(",")]
    return pa.schema([(name, pa.list_(_ARROW[kind[6:-1]]) if kind.startswith("array<") else _ARROW[kind]) for name, kind in fields])


def dealt_table(df: DataFrame, key: str, kind: str) -> tuple[DataFrame, Callable[[], None]]:
    """df as a bucketed table in the shared folder, and what removes it: joins on key do not shuffle it again."""
    spark = df.sparkSession
    path, name = new_folder(spark, kind), f"{kind}_{uuid.uuid4().hex}"
    df.write.bucketBy(shuffle_partitions(spark), key).sortBy(key).option("path", path).saveAsTable(name)

    def drop() -> None:
        spark.sql(f"drop table if exists {name}")
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

    return spark.table(name), drop


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def n_words(text: Column) -> Column:
    """Number of words; null counts as empty.  Builds no array of words."""
    marks = F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "w"), " \t\n\x0b\f\r", "")
    return F.length(marks).cast("long")


def global_rank(df: DataFrame, *order: str, name: str = "rank") -> DataFrame:
    """Number rows from 0 in the given order without a single-partition sort.

    Rows are range-partitioned and sorted; a row's rank is its place in its partition plus the rows
    of the partitions before.  Only one count per partition is brought together.
    """
    n = shuffle_partitions(df.sparkSession)
    keys = [F.col(c).asc_nulls_last() for c in order]
    placed = cut(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned(F.col("_at"), 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    here = placed.withColumn("_part", part).join(F.broadcast(bases), "_part")
    return here.withColumn(name, F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_base")
