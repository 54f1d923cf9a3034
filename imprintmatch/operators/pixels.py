"""Aggregates over a pixel table (roi_id, x, y, b, g, r, in_mask); regions.py has the same from image bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L

LEAST_PIXELS = 200


def with_hsv(pixels: DataFrame) -> DataFrame:
    h, s, v = L.bgr_to_hsv(F.col("b"), F.col("g"), F.col("r"))
    return pixels.withColumns({"h": h, "s": s, "v": v})


def mask_mean_color(pixels: DataFrame, single: bool = False) -> DataFrame:
    """(roi_id, n, h, s, v, label) of the mean inside the mask; single: no label for few pixels or other colours."""
    inside = with_hsv(pixels).filter("in_mask")
    means = inside.groupBy("roi_id").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in "hsv"])
    label = L.color_label_hsv(F.col("h"), F.col("s"), F.col("v"))
    if single:
        label = F.when((F.col("n") >= LEAST_PIXELS) & (label != L.OTHER), label)
    return means.withColumn("label", label)


def capsule_half_colors(pixels: DataFrame, widths: DataFrame) -> DataFrame:
    """(roi_id, color): labels of the left and right half inside the mask, joined by +.  widths: (roi_id, w)."""
    inside = with_hsv(pixels).filter("in_mask").join(widths, "roi_id")
    half = (F.col("x") >= F.floor(F.col("w") / 2)).cast("int")
    means = inside.groupBy("roi_id", half.alias("half")).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in "hsv"])
    label = L.color_label_hsv(F.col("h"), F.col("s"), F.col("v"))
    used = F.when((F.col("n") >= LEAST_PIXELS) & (label != L.OTHER), F.struct("half", label.alias("label")))
    names = F.array_distinct(F.transform(F.array_sort(F.collect_list(used)), lambda x: x["label"]))
    out = means.groupBy("roi_id").agg(names.alias("names"))
    return out.select("roi_id", F.when(F.size("names") == 0, L.OTHER).otherwise(F.array_join("names", "+")).alias("color"))


def center_mean_hsv(pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """(roi_id, h, s, v, label) of the middle half of a region.  sizes: (roi_id, w, h)."""
    rows = with_hsv(pixels).join(sizes.select("roi_id", F.col("w").alias("_w"), F.col("h").alias("_h")), "roi_id")
    low, high = lambda c: F.floor(F.col(c) * 0.25), lambda c: F.floor(F.col(c) * 0.75)
    middle = (F.col("x") >= low("_w")) & (F.col("x") < high("_w")) & (F.col("y") >= low("_h")) & (F.col("y") < high("_h"))
    means = rows.filter(middle).groupBy("roi_id").agg(*[F.avg(c).alias(c) for c in "hsv"])
    return means.withColumn("label", L.color_label_en(F.col("h"), F.col("s"), F.col("v")))


def mask_tight_box(pixels: DataFrame, sizes: DataFrame, least: int = 50) -> DataFrame:
    """(roi_id, x0, y0, x1, y1): the padded box of the mask, or the whole region for a small mask."""
    own = F.col("in_mask")
    box = pixels.groupBy("roi_id").agg(F.count_if(own).alias("n"), *[f(F.when(own, F.col(c))).alias(a) for a, f, c in (("xs", F.min, "x"), ("ys", F.min, "y"), ("xe", F.max, "x"), ("ye", F.max, "y"))])
    rows = box.join(sizes, "roi_id")
    pad = F.floor(F.lit(0.10) * F.greatest(F.col("xe") - F.col("xs") + 1, F.col("ye") - F.col("ys") + 1)).cast("int")
    small = F.col("n") < least
    return rows.select(
        "roi_id",
        F.when(small, 0).otherwise(F.greatest(F.lit(0), F.col("xs") - pad)).alias("x0"),
        F.when(small, 0).otherwise(F.greatest(F.lit(0), F.col("ys") - pad)).alias("y0"),
        F.when(small, F.col("w")).otherwise(F.least(F.col("w"), F.col("xe") + 1 + pad)).alias("x1"),
        F.when(small, F.col("h")).otherwise(F.least(F.col("h"), F.col("ye") + 1 + pad)).alias("y1"),
    )


def ink_score(pixels: DataFrame) -> DataFrame:
    """(roi_id, ink): mean difference of red and green inside the mask (anywhere without a mask), of 255."""
    gap = F.abs(F.col("r") - F.col("g"))
    return pixels.groupBy("roi_id").agg((F.coalesce(F.avg(F.when(F.col("in_mask"), gap)), F.avg(gap)) / 255).alias("ink"))
