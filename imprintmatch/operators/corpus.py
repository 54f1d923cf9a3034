"""Jobs for a corpus of detector training labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.labels import ALPHABET

#: Lengths of made-up imprints, one drawn for each.
LENGTHS = (2, 3, 3, 4, 4, 5, 6)
HYPHEN_SHARE = 0.18
TRAIN_SHARE = 0.9
PARTS = 1_000_000


def _draw(key: Column, seed: int, what: Column | int, n: Column | int) -> Column:
    """A whole number under n from the first 52 bits of an md5: the same whenever and wherever it is drawn."""
    as_col = lambda x: F.lit(x) if isinstance(x, int) else x
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), as_col(what).cast("string"), key.cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 13), 16, 10).cast("long"), as_col(n))


def synth_tokens(ids: DataFrame, seed: int = 0) -> DataFrame:
    """(id, token): a made-up imprint for every row of ids (id)."""
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    length = pick(LENGTHS, _draw(F.col("id"), seed, -1, len(LENGTHS)))
    rows = ids.select("id", length.alias("n"))
    chars = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: pick(ALPHABET[:36], _draw(F.col("id"), seed, i, 36)))
    rows = rows.select("id", "n", F.array_join(chars, "").alias("plain"))
    hyphen = (F.col("n") >= 3) & (_draw(F.col("id"), seed, -2, PARTS) < int(HYPHEN_SHARE * PARTS))
    at = 1 + F.when(F.col("n") >= 3, _draw(F.col("id"), seed, -3, F.col("n") - 2)).otherwise(0)
    with_hyphen = F.concat(F.substr("plain", F.lit(1), at.cast("int")), F.lit("-"), F.substr("plain", (at + 1).cast("int")))
    return rows.select("id", F.when(hyphen, with_hyphen).otherwise(F.col("plain")).alias("token"))


def synth_range(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    return synth_tokens(spark.range(n), seed)


def assign_split(key: Column, seed: int = 0) -> Column:
    return F.when(_draw(key, seed, -4, PARTS) < int(TRAIN_SHARE * PARTS), "train").otherwise("val")


def normalize_boxes(boxes: DataFrame, classes: DataFrame) -> DataFrame:
    """Pixel corners and ch to class_id and centre and size as shares of img_w and img_h; other characters go."""
    known = boxes.join(F.broadcast(classes), "ch")
    out = {}
    for axis, size, centre, extent in (("x", "img_w", "cx", "w"), ("y", "img_h", "cy", "h")):
        a, b = F.col(f"{axis}0"), F.col(f"{axis}1")
        out[centre] = (a + b) / 2 / F.col(size)
        out[extent] = (b - a + 1) / F.col(size)
    return known.withColumns(out).drop("x0", "y0", "x1", "y1", "img_w", "img_h")
