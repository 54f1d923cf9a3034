"""One pill in each region: from image features, character detections and OCR tables to catalogue items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import detect as D
from ..operators import ocr as O
from ..storage import cut
from . import identify as I


#: Ids of regions up to so many are sent to all tasks; beyond it rows are joined with them.
MOST_SENT = 1_000_000


def of_regions(rows: DataFrame, regions: DataFrame, key: str = "image_id") -> DataFrame:
    """rows whose key is one of regions' (roi_id): what belongs to no region is left before it is sorted, decoded or suppressed."""
    ids = cut(regions.select(F.col("roi_id").alias(key)).distinct())
    return rows.join(F.broadcast(ids) if ids.count() <= MOST_SENT else ids, key, "left_semi")


def char_detections(raw: DataFrame, sizes: DataFrame, classes: DataFrame) -> DataFrame:
    """Characters on their images from a detector's raw scores: argmax, suppression, corners on the image, characters.

    raw: image_id, anchor_id, cx, cy, w, h, scores on the square canvas; sizes: image_id, img_w, img_h.
    """
    boxes = D.nms_boxes(D.boxes_xyxy(D.detection_argmax(raw)))
    placed = D.unletterbox(boxes.join(sizes, "image_id"))
    return D.to_char_detections(placed, classes).withColumnRenamed("anchor_id", "det_id")


def pill_regions(features: DataFrame, contours: DataFrame, chars: DataFrame) -> DataFrame:
    """(roi_id, shape_guess, color_guess, is_capsule, imprint_type, has_detector) of every region.

    features: roi_id, color and kind (region_features); contours: image_id, box_id, w, h, area, perimeter, of which the
    largest shapes a region; chars: regions without any detection count as having no detector.
    """
    largest = contours.groupBy(F.col("image_id").alias("roi_id")).agg(F.max_by(F.struct("w", "h", "area", "perimeter"), F.struct("area", -F.col("box_id"))).alias("c"))
    shape = L.shape_label(*[F.col(f"c.{k}") for k in ("w", "h", "area", "perimeter")], single=True)
    shaped = largest.select("roi_id", shape.alias("shape_guess"), L.is_capsule(shape, F.col("c.w"), F.col("c.h")).alias("is_capsule"))
    seen = chars.select(F.col("image_id").alias("roi_id")).distinct().withColumn("has_detector", F.lit(True))
    rows = features.join(shaped, "roi_id", "left").join(seen, "roi_id", "left")
    return rows.select("roi_id", "shape_guess", F.col("color").alias("color_guess"), F.coalesce("is_capsule", F.lit(False)).alias("is_capsule"), F.col("kind").alias("imprint_type"), F.coalesce("has_detector", F.lit(False)).alias("has_detector"))


def identify_single(regions: DataFrame, lines: DataFrame, attempts: DataFrame, chars: DataFrame, items: DataFrame) -> DataFrame:
    """identify_one_batch's columns and is_capsule for every region, whose text comes from the source that fits it.

    regions: pill_regions; lines and attempts: OCR lines by pass and sweep attempts; chars: char_detections.
    """
    radial = D.decode_radial(chars).withColumnRenamed("image_id", "roi_id")
    texts = O.route_imprint(regions, O.ocr_cascade(O.ocr_pass_text(lines)), radial, O.ocr_sweep_best(attempts))
    readings = regions.join(texts, "roi_id").select(F.col("roi_id").alias("reading_id"), F.col("text").alias("imprint_raw"), "shape_guess", "color_guess")
    return I.identify_one_batch(readings, items).join(regions.select(F.col("roi_id").alias("reading_id"), "is_capsule"), "reading_id")
