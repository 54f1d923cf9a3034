"""Reductions of OCR lines, passes and attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

LOWER_PASSES = (5, 6)


def _solid(c: Column) -> Column:
    """Number of characters other than white space."""
    return F.length(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s", ""))


def ocr_pass_text(lines: DataFrame, basic: bool = False) -> DataFrame:
    """(roi_id, pass_no, text) from lines that are sure enough, in line order; passes without such a line give ''."""
    least = F.lit(0.35) if basic else F.when(F.col("pass_no").isin(*LOWER_PASSES), 0.20).otherwise(0.35)
    used = (F.coalesce("text", F.lit("")) != "") & (F.col("conf") >= least)
    kept = F.collect_list(F.when(used, F.struct("line_no", "text")))
    joined = F.array_join(F.transform(F.array_sort(kept), lambda x: x["text"]), " ")
    return lines.groupBy("roi_id", "pass_no").agg(joined.alias("_joined")).select("roi_id", "pass_no", T.normalize_ocr(F.col("_joined"), basic).alias("text"))


def ocr_cascade(passes: DataFrame) -> DataFrame:
    """(roi_id, text): the first pass with a text, else ''."""
    first = F.min_by(F.when(F.col("text") != "", F.col("text")), F.when(F.col("text") != "", F.col("pass_no")))
    return passes.groupBy("roi_id").agg(F.coalesce(first, F.lit("")).alias("text"))


def ocr_sweep_best(attempts: DataFrame, least: int = 3) -> DataFrame:
    """(roi_id, text): the attempt with most tokens, then most characters, then the earliest; '' if all are short.

    The maximum is combined before the shuffle, so the many attempts of a region do not travel.
    """
    normal = T.normalize_ocr(F.col("text"))
    rows = attempts.select("roi_id", "attempt_no", normal.alias("text"))
    n_tokens = F.size(F.regexp_extract_all("text", F.lit(r"[A-Z0-9\-.]{2,}"), F.lit(0)))
    worth = F.when(_solid(F.col("text")) >= least, F.struct(n_tokens, _solid(F.col("text")), -F.col("attempt_no")))
    return rows.groupBy("roi_id").agg(F.coalesce(F.max_by("text", worth), F.lit("")).alias("text"))


def merge_roi_text(regions: DataFrame) -> DataFrame:
    """(image_id, text): texts of an image's regions in order, joined and normalised (basic policy)."""
    kept = F.collect_list(F.when(F.coalesce("text", F.lit("")) != "", F.struct("roi_id", "text")))
    joined = F.array_join(F.transform(F.array_sort(kept), lambda x: x["text"]), " ")
    return regions.groupBy("image_id").agg(joined.alias("_joined")).select("image_id", T.normalize_ocr(F.col("_joined"), basic=True).alias("text"))


def route_imprint(regions: DataFrame, cascade: DataFrame, radial: DataFrame, sweep: DataFrame) -> DataFrame:
    """(roi_id, text): the source that fits a region.

    regions: (roi_id, has_detector, is_capsule, imprint_type); the other tables: (roi_id, text).
    """
    joined = regions
    for name, table in (("_cascade", cascade), ("_radial", radial), ("_sweep", sweep)):
        joined = joined.join(table.select("roi_id", F.coalesce("text", F.lit("")).alias(name)), "roi_id", "left").fillna("", [name])
    decoded = F.when(_solid(F.col("_radial")) < 3, F.col("_sweep")).otherwise(F.col("_radial"))
    by_mark = F.col("has_detector") & ~F.col("is_capsule") & (F.col("imprint_type") == "debossed")
    chosen = F.when(F.coalesce(by_mark, F.lit(False)), decoded).otherwise(F.col("_cascade"))
    return joined.select("roi_id", F.coalesce(F.nullif(chosen, F.lit("")), "_cascade").alias("text"))
