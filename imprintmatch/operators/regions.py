"""Features of image regions straight from their bytes.

An image comes as one row (roi_id, w, h, channels, data, mask): data holds h lines of w pixels of blue, green and red (or
one grey value), mask one byte for each pixel, null where there is none.  It is cut into tiles of whole lines with a line
of either neighbour, each tile is reduced to sums in one task, and sums are added up by region.  So one row of
numbers per tile is shuffled, never a pixel, and an image of any height costs tasks of a tile's size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from .pixels import LEAST_PIXELS

#: Lines of a tile.
TILE = 256
#: Tiles that are drawn together.
DRAWN = 64
#: Parts of a region whose colours are summed: its mask, the halves of that, and the middle of the region.
PARTS = ("mask", "left", "right", "mid")
_COLOURS = [f"{part}_{c}" for part in PARTS for c in "nhsv"]
_EXTREMES = ("xs", "ys", "xe", "ye")
_TOTALS = ("ink", "ink_all", "edge", "edge_all")
SUMS = ["w", "h", *_COLOURS, *_EXTREMES, *_TOTALS]
_SCHEMA = pa.schema([("roi_id", pa.int64()), ("w", pa.int64()), ("h", pa.int64()), *((c, pa.int64()) for c in (*_COLOURS, *_EXTREMES, "ink", "ink_all")), ("edge", pa.float64()), ("edge_all", pa.float64())])
_DDL = ", ".join(f"{f.name} {'double' if pa.types.is_floating(f.type) else 'long'}" for f in _SCHEMA)


def hsv_plane(bgr: np.ndarray) -> np.ndarray:
    """8-bit hue (0 to 180), saturation and value of an array of bytes whose last axis is blue, green, red."""
    b, g, r = (bgr[..., k].astype(np.int32) for k in range(3))
    v = np.maximum(np.maximum(b, g), r)
    span = v - np.minimum(np.minimum(b, g), r)
    whole = np.maximum(span, 1)
    s = np.floor(255.0 * span / np.maximum(v, 1) + 0.5)
    of = np.where(v == r, 60.0 * (g - b) / whole, np.where(v == g, 120.0 + 60.0 * (b - r) / whole, 240.0 + 60.0 * (r - g) / whole))
    hue = np.floor(np.where(of < 0, of + 360, of) / 2 + 0.5)
    hue = np.where(span == 0, 0, np.where(hue >= 180, hue - 180, hue))
    return np.stack([hue, s, v], -1).astype(np.uint8)


def tiles(images: DataFrame, lines: int = TILE) -> DataFrame:
    """Images cut into tiles: y0 and n_lines are a tile's own lines, data and mask hold a line more on either side where there is one."""
    first, last = F.greatest(F.col("y0") - 1, F.lit(0)), F.least(F.col("y0") + lines + 1, F.col("h"))
    part = lambda c, width: F.substring(c, first * width + 1, (last - first) * width)
    rows = images.filter("w > 0 and h > 0").withColumn("y0", F.explode(F.sequence(F.lit(0), F.col("h") - 1, F.lit(lines))))
    return rows.select(
        "roi_id", "w", "h", "channels", "y0", F.least(F.lit(lines), F.col("h") - F.col("y0")).alias("n_lines"),
        part("data", F.col("w") * F.col("channels")).alias("data"), part("mask", F.col("w")).alias("mask"),
    )


def _gray(bgr: np.ndarray) -> np.ndarray:
    b, g, r = (bgr[..., k].astype(float) for k in range(3))
    return np.rint(r * 0.299 + g * 0.587 + b * 0.114)


def _edges(gray: np.ndarray, above: bool, below: bool, mirrored: bool) -> np.ndarray:
    """Sobel magnitude of the tile's own lines; above and below: gray begins and ends with a neighbour's line.

    At the image's border the line (or column) next to the outermost is mirrored, or the outermost repeated where a side of
    the image is a single line.
    """
    p = np.pad(gray, ((0, 0), (1, 1)), mode="reflect" if mirrored else "edge")
    step = 1 if mirrored else 0
    p = np.concatenate(([] if above else [p[step : step + 1]]) + [p] + ([] if below else [p[len(p) - 1 - step : len(p) - step]]))
    across = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    down = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    return np.hypot(across, down)


def _tile_sums(row: dict) -> dict:
    w, h, y0, n = row["w"], row["h"], row["y0"], row["n_lines"]
    above, below = y0 > 0, y0 + n < h
    data = np.frombuffer(row["data"], np.uint8).reshape(n + above + below, w, row["channels"])
    bgr = data[..., :3] if row["channels"] >= 3 else np.repeat(data[..., :1], 3, -1)
    own = slice(int(above), int(above) + n)
    inside = np.zeros((n, w), bool) if row["mask"] is None else np.frombuffer(row["mask"], np.uint8).reshape(-1, w)[own] > 0
    edge = _edges(_gray(bgr), above, below, min(w, h) > 1)
    bgr = bgr[own]
    hsv = hsv_plane(bgr).astype(np.int64)
    x, y = np.arange(w), np.arange(y0, y0 + n)
    middle = ((y >= int(h * 0.25)) & (y < int(h * 0.75)))[:, None] & ((x >= int(w * 0.25)) & (x < int(w * 0.75)))[None, :]
    right = (x >= w // 2)[None, :]
    out = {"roi_id": row["roi_id"], "w": w, "h": h}
    for part, at in zip(PARTS, (inside, inside & ~right, inside & right, middle)):
        out |= dict(zip((f"{part}_{c}" for c in "nhsv"), (int(at.sum()), *hsv[at].sum(0).tolist())))
    ys, xs = np.nonzero(inside)
    found = bool(len(xs))
    out |= dict(zip(_EXTREMES, (int(xs.min()), int(ys.min()) + y0, int(xs.max()), int(ys.max()) + y0) if found else (None,) * 4))
    ink = np.abs(bgr[..., 2].astype(np.int64) - bgr[..., 1])
    return out | {"ink": int(ink[inside].sum()), "ink_all": int(ink.sum()), "edge": float(edge[inside].sum()), "edge_all": float(edge.sum())}


def region_sums(cut: DataFrame) -> DataFrame:
    """One row for every region of tiles(): all its sums, see SUMS; the features below are read off them.

    Cases: a null mask has no pixels inside, as one without marks; a null roi_id is a region; repeated tiles count twice; no
    tiles give no rows; other columns are not read.
    """

    def sums(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pylist([_tile_sums(row.to_pylist()[0]) for row in (batch.slice(k, 1) for k in range(batch.num_rows))], _SCHEMA)

    each = cut.select("roi_id", "w", "h", "channels", "y0", "n_lines", "data", "mask").mapInArrow(sums, _DDL)
    added = [F.sum(c).alias(c) for c in (*_COLOURS, *_TOTALS)]
    return each.groupBy("roi_id").agg(F.max("w").alias("w"), F.max("h").alias("h"), *added, F.min("xs").alias("xs"), F.min("ys").alias("ys"), F.max("xe").alias("xe"), F.max("ye").alias("ye"))


def _mean(part: str, c: str) -> Column:
    return F.try_divide(F.col(f"{part}_{c}"), F.col(f"{part}_n"))


def _label(part: str, rule=L.color_label_hsv) -> Column:
    return F.when(F.col(f"{part}_n") > 0, rule(*(_mean(part, c) for c in "hsv")))


def _sure(part: str) -> Column:
    """The label of enough pixels, if it names a colour."""
    label = _label(part)
    return F.when((F.col(f"{part}_n") >= LEAST_PIXELS) & (label != L.OTHER), label)


def mask_mean_color(sums: DataFrame, single: bool = False) -> DataFrame:
    """(roi_id, n, h, s, v, label) inside the mask; single: no label for few pixels or other colours."""
    return sums.filter("mask_n > 0").select("roi_id", F.col("mask_n").alias("n"), *[_mean("mask", c).alias(c) for c in "hsv"], (_sure("mask") if single else _label("mask")).alias("label"))


def capsule_colors() -> Column:
    names = F.array_distinct(F.array_compact(F.array(_sure("left"), _sure("right"))))
    return F.when(F.size(names) == 0, L.OTHER).otherwise(F.array_join(names, "+"))


def capsule_half_colors(sums: DataFrame) -> DataFrame:
    return sums.filter("mask_n > 0").select("roi_id", capsule_colors().alias("color"))


def center_mean_hsv(sums: DataFrame) -> DataFrame:
    return sums.select("roi_id", *[_mean("mid", c).alias(c) for c in "hsv"], _label("mid", L.color_label_en).alias("label"))


def tight_box(least: int = 50) -> dict[str, Column]:
    """The padded box of the mask, or the whole region for a small mask."""
    pad = F.floor(F.lit(0.10) * F.greatest(F.col("xe") - F.col("xs") + 1, F.col("ye") - F.col("ys") + 1))
    box = {"x0": F.greatest(F.lit(0), F.col("xs") - pad), "y0": F.greatest(F.lit(0), F.col("ys") - pad), "x1": F.least(F.col("w"), F.col("xe") + 1 + pad), "y1": F.least(F.col("h"), F.col("ye") + 1 + pad)}
    whole = {"x0": F.lit(0), "y0": F.lit(0), "x1": F.col("w"), "y1": F.col("h")}
    return {c: F.when(F.col("mask_n") < least, whole[c]).otherwise(box[c]).cast("long") for c in box}


def mask_tight_box(sums: DataFrame, least: int = 50) -> DataFrame:
    return sums.select("roi_id", *[v.alias(k) for k, v in tight_box(least).items()])


def _share(inside: str, anywhere: str) -> Column:
    return F.when(F.col("mask_n") > 0, F.try_divide(inside, "mask_n")).otherwise(F.col(anywhere) / (F.col("w") * F.col("h"))) / 255


def ink_score(sums: DataFrame) -> DataFrame:
    """(roi_id, ink): mean difference of red and green inside the mask (anywhere without a mask), of 255."""
    return sums.select("roi_id", _share("ink", "ink_all").alias("ink"))


def deboss_score(sums: DataFrame) -> DataFrame:
    """(roi_id, deboss): mean Sobel magnitude inside the mask (anywhere without a mask), of 255."""
    return sums.select("roi_id", _share("edge", "edge_all").alias("deboss"))


def region_features(sums: DataFrame) -> DataFrame:
    """What identification reads off a region: colour, halves, middle, box, scores and the kind of its imprint."""
    ink, deboss = _share("ink", "ink_all"), _share("edge", "edge_all")
    return sums.select(
        "roi_id", F.col("mask_n").alias("n"), _sure("mask").alias("color"), capsule_colors().alias("halves"), _label("mid", L.color_label_en).alias("middle"),
        *[v.alias(k) for k, v in tight_box().items()], ink.alias("ink"), deboss.alias("deboss"), L.imprint_type(ink, deboss).alias("kind"),
    )


def pixel_tiles(pixels: DataFrame, w: int, h: int, lines: int = TILE) -> DataFrame:
    """Tiles of a pixel table (roi_id, x, y, b, g, r, in_mask) of regions of w times h pixels.

    Missing pixels are 0, of doubled ones the greatest grey counts.  A pixel goes to its own tile and, next to
    a border, to its neighbour's, so what meets in a task is one tile.
    """
    y = F.col("y")
    near = F.filter(F.array_distinct(F.array(*(F.floor((y + d) / lines) for d in (-1, 0, 1)))), lambda t: (t >= 0) & (t * lines < h))
    gray = F.rint(F.col("r") * 0.299 + F.col("g") * 0.587 + F.col("b") * 0.114).cast("int")
    cells = pixels.groupBy("roi_id", "y", (y * w + F.col("x")).alias("at")).agg(F.max(gray).alias("v"), F.max(F.col("in_mask").cast("int")).alias("m"))
    one = (F.col("at").cast("long") * 512 + F.coalesce("v", F.lit(0)) * 2 + F.coalesce("m", F.lit(0))).alias("c")
    own = cells.select("roi_id", F.explode(near).alias("t"), one).groupBy("roi_id", "t").agg(F.collect_list("c").alias("c"))

    def draw(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, DRAWN):
                some = batch.slice(begin, DRAWN)
                rows, lists = {k: [] for k in ("y0", "n_lines", "data", "mask")}, some.column("c")
                for k, t in enumerate(some.column("t").to_pylist()):
                    c = lists[k].values.to_numpy(zero_copy_only=False)
                    y0 = t * lines
                    n, first = min(lines, h - y0), max(y0 - 1, 0)
                    planes = np.zeros((2, (min(y0 + n + 1, h) - first) * w), np.uint8)
                    planes[:, c // 512 - first * w] = c // 2 % 256, c % 2
                    for name, value in zip(rows, (y0, n, planes[0].tobytes(), planes[1].tobytes())):
                        rows[name].append(value)
                size = lambda value: pa.array([value] * some.num_rows, pa.int32())
                yield pa.RecordBatch.from_pydict({"roi_id": some.column("roi_id"), "w": size(w), "h": size(h), "channels": size(1), "y0": pa.array(rows["y0"], pa.int32()), "n_lines": pa.array(rows["n_lines"], pa.int32()), "data": rows["data"], "mask": rows["mask"]})

    return own.mapInArrow(draw, "roi_id long, w int, h int, channels int, y0 int, n_lines int, data binary, mask binary")
