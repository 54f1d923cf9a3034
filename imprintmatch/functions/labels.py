"""Labels for colours, shapes and marks as column expressions.

The names and thresholds in the rules below are fixed values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import OBLONG, OVAL, ROUND

OTHER = "기타"


def color_label_hsv(h: Column, s: Column, v: Column) -> Column:
    """Colour name of a mean on the 8-bit HSV scale (h to 180); the first rule that holds wins."""
    return (
        F.when((s < 45) & (v > 170), "하양")
        .when(v < 60, OTHER)
        .when((h < 10) | (h > 160), F.when(s >= 120, "빨강").otherwise("주황"))
        .when(h < 30, "주황")
        .when(h < 45, "노랑")
        .when(h < 85, "연두")
        .when(h < 140, "파랑")
        .otherwise(OTHER)
    )


def shape_label(w: Column, h: Column, area: Column, perimeter: Column, single: bool = False) -> Column:
    """Shape of a contour; w is null without one.  single: no label for small contours."""
    ratio = w / (h + F.lit(1e-6))
    roundness = F.lit(4 * math.pi) * area / (perimeter * perimeter + F.lit(1e-6))
    label = F.when(ratio >= 2.2, OBLONG).when((ratio < 1.25) & (roundness >= 0.72), ROUND).otherwise(OVAL)
    if single:
        return F.when(w.isNotNull() & (area >= 400), label)
    return F.when(w.isNull(), OVAL).otherwise(label)


def is_capsule(shape: Column, w: Column, h: Column) -> Column:
    long = F.when(h > 0, w / h > 1.3)
    return F.coalesce(shape.isin(OVAL, OBLONG) & long, F.lit(False))


def imprint_type(ink: Column, deboss: Column) -> Column:
    return F.when(ink > 0.08, "printed").when(deboss > 0.20, "debossed").otherwise("unknown")


def color_label_en(h: Column, s: Column, v: Column) -> Column:
    return (
        F.when((s < 35) & (v > 170), "WHITE")
        .when(v < 60, "DARK")
        .when((h >= 15) & (h < 35), "YELLOW")
        .when((h >= 35) & (h < 85), "GREEN")
        .when((h >= 85) & (h < 130), "BLUE")
        .when((h >= 130) & (h < 170), "PURPLE")
        .otherwise("RED")
    )


def shape_label_en(w: Column, h: Column, area: Column, perimeter: Column) -> Column:
    roundness = F.lit(4 * math.pi) * area / F.greatest(perimeter * perimeter, F.lit(1.0))
    aspect = w / F.greatest(h, F.lit(1))
    return F.when(area < 200, F.lit(None)).when(roundness > 0.75, "ROUND").when((aspect > 1.6) | (aspect < 0.62), "OBLONG").otherwise("OVAL")


def foreground_pixel(h: Column, s: Column, v: Column) -> Column:
    """Not blue backdrop and not dark."""
    return ~((h >= 85) & (h <= 140) & (s >= 35)) & (v > 40)


def bgr_to_hsv(b: Column, g: Column, r: Column) -> tuple[Column, Column, Column]:
    """8-bit hue (0 to 180), saturation and value of a pixel."""
    v, low = F.greatest(b, g, r), F.least(b, g, r)
    span = v - low
    s = F.when(v == 0, F.lit(0.0)).otherwise(F.lit(255.0) * span / v)
    sixth = (
        F.when(span == 0, F.lit(0.0))
        .when(v == r, F.lit(60.0) * (g - b) / span)
        .when(v == g, F.lit(120.0) + F.lit(60.0) * (b - r) / span)
        .otherwise(F.lit(240.0) + F.lit(60.0) * (r - g) / span)
    )
    h = F.when(sixth < 0, sixth + 360).otherwise(sixth) / 2
    turned = F.floor(h + 0.5)
    return F.when(turned >= 180, turned - 180).otherwise(turned).cast("int"), F.floor(s + 0.5).cast("int"), v.cast("int")
