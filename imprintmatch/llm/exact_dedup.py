"""Exact deduplication by content sort.

Rows are range-partitioned on the text itself by sampled splitters and sorted, so that equal texts
stand side by side; a window compares neighbours in full and keeps one row of each group.  A text
with more copies than a task should hold is first dealt over several salted ranges; the winners of
its ranges (a bounded number) meet in a second sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, shuffle_partitions

#: Characters of a text that take part in the choice of splitters.
HEAD = 64


def content_sort(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", parts_per_task: int = 4) -> DataFrame:
    """Decide for every row whether it stays.

    Returns one row per input row: doc_id, keep_id, group_size, kept, text_sha256.  Other input columns
    are not read, so their names cannot clash.  keep is "largest" or "smallest".

    Cases: a null text equals the empty text.  A null doc_id ranks behind all others and stays only
    where its group has no other.  Of rows equal in id and text exactly one stays.  The same id with
    different texts gives separate groups.  Texts are compared whole at any length.  An empty table gives an
    empty result.
    """
    n, rows = shuffle_partitions(docs.sparkSession), docs.count()
    most = max(16, rows // (parts_per_task * n))
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    # Splitters are sampled from the head of a text and its hash, which bounds what the driver gets of a long
    # text; both follow from the text, so equal texts still stand side by side.
    slim = slim.select("*", F.xxhash64("_text").alias("_h"), F.substring("_text", 1, HEAD).alias("_head"))
    # At most rows / most <= parts_per_task * n hashes have more than `most` rows: small enough to broadcast.
    hot = slim.groupBy("_h").agg(F.count(F.lit(1)).alias("_copies")).filter(F.col("_copies") > most)
    dealt = slim.join(F.broadcast(hot), "_h", "left")
    ranges = F.ceil(F.col("_copies") / F.lit(most))
    # The input's partition takes part, so that copies under one id, or none, are dealt out too.
    dealt = dealt.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), ranges), F.lit(0)))
    ordered = dealt.repartitionByRange(n, "_head", "_h", "_salt")
    group = ["_head", "_h", "_salt", "_text"]
    best = F.col("doc_id").desc_nulls_last() if keep == "largest" else F.col("doc_id").asc_nulls_last()
    near, all_near = W.partitionBy(*group).orderBy(best), W.partitionBy(*group)
    local = ordered.select(
        "doc_id",
        F.sha2(F.col("_text").cast("binary"), 256).alias("text_sha256"),
        F.row_number().over(near).alias("_place"),
        F.first("doc_id").over(near).alias("_keep"),
        F.count(F.lit(1)).over(all_near).alias("_size"),
        F.when(F.col("_copies").isNotNull(), F.col("_text")).alias("_hot"),
        "_salt",
    )
    local = cut(local.withColumn("_hot", F.when(F.col("_place") == 1, F.col("_hot"))))
    known = F.col("_keep").isNotNull()
    own = F.struct((known if keep == "largest" else ~known).alias("known"), F.col("_keep").alias("keep"), F.col("_salt").alias("salt"))
    pick = F.max(own) if keep == "largest" else F.min(own)
    # One row per salted range of a hot text, compared in full again.
    wide = local.filter(F.col("_hot").isNotNull()).groupBy("_hot").agg(F.first("text_sha256").alias("text_sha256"), pick.alias("_best"), F.sum("_size").alias("_size_all"))
    wide = wide.select("text_sha256", "_size_all", F.col("_best.keep").alias("_keep_all"), F.col("_best.salt").alias("_salt_all"))
    out = local.drop("_hot").join(F.broadcast(wide), "text_sha256", "left")
    keep_id = F.when(F.col("_size_all").isNotNull(), F.col("_keep_all")).otherwise(F.col("_keep"))
    here = F.coalesce(F.col("_salt") == F.col("_salt_all"), F.lit(True))
    return out.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce(F.col("_size_all"), F.col("_size")).cast("long").alias("group_size"),
        ((F.col("_place") == 1) & F.col("_keep").eqNullSafe(keep_id) & here).alias("kept"),
        "text_sha256",
    )
