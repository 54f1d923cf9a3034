"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, global_rank, n_words

CAP = 3
#: Sources that are sent to all tasks, at most.
MOST_BROADCAST = 100_000


def hash_uniform(*cols: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an md5: the same on every run and partitioning."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """(source, source_size, weight, target) from rows (source, size).

    Sources by code point, null last, weigh weights[0], weights[1], ... in turn and share the whole size.
    A target stops at cap times its source's size; what it gives up goes to the others by weight, until
    none is above.  The loop carries three sums, not rows, to the driver.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.array(*[F.lit(w) for w in weights])
    per = global_rank(per, "source").withColumn("weight", F.get(turn, F.pmod(F.col("rank"), F.lit(len(weights))).cast("int")).cast("long"))
    per = cut(per.select("source", "source_size", "weight"))
    limit = F.col("source_size") * cap
    total = per.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    top, bottom, capped = total, None, -1
    while True:
        if bottom is None:
            bottom = per.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
        share = F.lit(float(top)) / F.lit(float(bottom or 1))
        above = limit < share * F.col("weight")
        k, given, weighed = per.agg(F.count_if(above), F.coalesce(F.sum(F.when(above, limit)), F.lit(0)), F.coalesce(F.sum(F.when(above, F.col("weight"))), F.lit(0))).first()
        if k == capped or not k:
            break
        whole = per.agg(F.sum("weight")).first()[0]
        top, bottom, capped = total - given, whole - weighed, k
    return per.withColumn("target", F.when(above, limit.cast("double")).otherwise(share * F.col("weight")))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP, seed: int = 0) -> DataFrame:
    """Add size, source_size, target, _rate and _copies to every row of docs, in place of columns of these names.

    A source's rate is target / size.  A document is taken floor(rate) times, and once more when a
    number seeded by its doc_id is under the rest: a Bernoulli draw that reruns repeat.

    Cases: a null or empty text has size 0, a very long one its whole size; a null source is a source of its
    own; a source of size 0 has target and copies 0; repeated rows, and different rows of one doc_id, draw
    alike; an empty table gives an empty result.  A doc_id of null is drawn as the empty string.
    """
    return _mix_sized(docs.withColumn("size", n_words(F.col("text"))), weights, cap, seed)


def _mix_sized(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP, seed: int = 0) -> DataFrame:
    targets = source_targets(sized.select("source", "size"), weights, cap)
    right = targets.select(F.col("source").alias("_source"), "source_size", "target")
    if targets.count() <= MOST_BROADCAST:  # else a sorted join, in which Spark splits a large source
        right = F.broadcast(right)
    out = sized.drop("source_size", "target").join(right, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(F.lit(0.0))
    out = out.withColumn("_rate", rate)
    extra = hash_uniform(F.lit(seed), F.col("doc_id")) < F.col("_rate") - F.floor("_rate")
    return out.withColumn("_copies", (F.floor("_rate") + extra.cast("long")).cast("long"))


def mix_digest(docs: DataFrame, **options) -> DataFrame:
    """Per document what the mix takes: doc_id, size, source_size, target, taken.  Other columns are not read.

    Texts are read once: what follows works on their sizes.
    """
    sized = cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")))
    return _mix_sized(sized, **options).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("_copies")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row as often as it is taken, with the columns of docs, whatever their names."""
    names = docs.columns
    taken = mix(docs.select(F.struct(*names).alias("_row"), "doc_id", "source", "text"), **options).filter(F.col("_copies") > 0)
    copies = taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy"))
    return copies.select(*[F.col("_row").getField(c).alias(c) for c in names])
