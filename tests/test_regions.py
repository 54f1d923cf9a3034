"""Region features from image bytes: against the pixel table's, for tiles of any height, and for all colours."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from imprintmatch.functions import labels as L
from imprintmatch.operators import pixels as P
from imprintmatch.operators import regions as R
from imprintmatch.sources import images as G

IMAGES = "roi_id long, w int, h int, channels int, data binary, mask binary"


def drawn(seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for roi_id, (w, h, share) in enumerate(((40, 30, 0.9), (31, 57, 0.5), (1, 9, 1), (9, 1, 1), (1, 1, 1), (50, 40, 0), (60, 20, 0.01), (2, 2, 1))):
        image = rng.integers(0, 256, (h, w, 3), np.uint8) if roi_id % 2 else np.full((h, w, 3), rng.integers(0, 256, 3), np.uint8)
        image[h // 2 :] //= 2
        rows.append((roi_id, w, h, 3, image, (rng.random((h, w)) < share).astype(np.uint8)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r[:4], bytearray(r[4].tobytes()), None if r[5] is None else bytearray(r[5].tobytes())) for r in rows], IMAGES)


def table(spark, rows):
    """The same as a pixel table."""
    cells = [(r[0], x, y, *map(int, r[4][y, x]), bool(r[5][y, x])) for r in rows for y in range(r[2]) for x in range(r[1])]
    return spark.createDataFrame(cells, "roi_id long, x int, y int, b int, g int, r int, in_mask boolean")


def rounded(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


def sobel(gray, mask):
    """A plain version: the border is mirrored without its edge, or repeated for an image of a single line."""
    h, w = gray.shape
    at = lambda y, x: gray[(-y if y < 0 else 2 * h - 2 - y if y >= h else y) if min(w, h) > 1 else min(max(y, 0), h - 1), (-x if x < 0 else 2 * w - 2 - x if x >= w else x) if min(w, h) > 1 else min(max(x, 0), w - 1)]
    every, inside = [], []
    for y in range(h):
        for x in range(w):
            across = sum(k * (at(y + d, x + 1) - at(y + d, x - 1)) for d, k in ((-1, 1), (0, 2), (1, 1)))
            down = sum(k * (at(y + 1, x + d) - at(y - 1, x + d)) for d, k in ((-1, 1), (0, 2), (1, 1)))
            every.append(float(np.hypot(across, down)))
            if mask is not None and mask[y, x]:
                inside.append(every[-1])
    return float(np.mean(inside or every)) / 255


@pytest.mark.parametrize("lines", [1, 7, 256])
def test_features_equal_those_of_the_pixel_table(spark, lines):
    rows = drawn()
    images, pixels = frame(spark, rows), table(spark, rows)
    sums = R.region_sums(R.tiles(images, lines))
    sizes = images.select("roi_id", "w", "h")
    assert rounded(R.mask_mean_color(sums)) == rounded(P.mask_mean_color(pixels))
    assert rounded(R.mask_mean_color(sums, single=True)) == rounded(P.mask_mean_color(pixels, single=True))
    assert rounded(R.capsule_half_colors(sums)) == rounded(P.capsule_half_colors(pixels, sizes.select("roi_id", "w")))
    seen = [r for r in rounded(R.center_mean_hsv(sums)) if r[1] is not None]
    assert seen == rounded(P.center_mean_hsv(pixels, sizes)) and len(seen) < len(rows)
    assert rounded(R.mask_tight_box(sums)) == rounded(P.mask_tight_box(pixels, sizes))
    assert rounded(R.ink_score(sums)) == rounded(P.ink_score(pixels))
    gray = [np.rint(r[4] @ [0.114, 0.587, 0.299]) for r in rows]
    assert rounded(R.deboss_score(sums)) == [(r[0], pytest.approx(sobel(g, r[5]))) for r, g in zip(rows, gray)]
    everything = {r.roi_id: r for r in R.region_features(sums).collect()}
    assert {k: r.ink for k, r in everything.items()} == pytest.approx({r.roi_id: r.ink for r in P.ink_score(pixels).collect()})
    assert {r.kind for r in everything.values()} <= {"printed", "debossed", "unknown"}


def test_pixel_tiles_give_one_score_at_any_height(spark):
    rnd = random.Random(4)
    cells = [(k, rnd.randrange(20), rnd.randrange(33), *(rnd.randrange(256) for _ in "bgr"), rnd.random() < 0.5) for k in range(3) for _ in range(300)]
    pixels = spark.createDataFrame(cells, "roi_id long, x int, y int, b int, g int, r int, in_mask boolean")
    want = rounded(R.deboss_score(R.region_sums(R.pixel_tiles(pixels, 20, 33))))
    for lines in (1, 2, 5, 32, 33):
        assert rounded(R.deboss_score(R.region_sums(R.pixel_tiles(pixels, 20, 33, lines)))) == want
    gray = np.zeros((33, 20))
    mask = np.zeros((33, 20), bool)
    for k, x, y, b, g, r, own in cells:
        if k == 1:
            gray[y, x] = max(gray[y, x], np.rint(0.299 * r + 0.587 * g + 0.114 * b))
            mask[y, x] |= own
    assert want[1][1] == pytest.approx(sobel(gray, mask))


def test_grey_images_missing_masks_and_other_columns(spark):
    grey = np.arange(12, dtype=np.uint8).reshape(3, 4)
    four = np.dstack([np.full((3, 4), 10, np.uint8)] * 2 + [np.full((3, 4), 200, np.uint8)] * 2)
    rows = [(1, 4, 3, 1, grey, None), (2, 4, 3, 4, four, np.ones((3, 4), np.uint8)), (None, 4, 3, 1, grey, None)]
    images = frame(spark, rows).selectExpr("*", "'x' as n", "1 as ink")
    got = {r.roi_id: r for r in R.region_features(R.region_sums(R.tiles(images))).collect()}
    assert (got[1].n, got[1].ink, got[1].halves, got[1].x1, got[1].y1) == (0, 0, L.OTHER, 4, 3) and got[None].deboss == got[1].deboss == pytest.approx(sobel(grey.astype(float), None))
    assert got[2].ink == pytest.approx(190 / 255)
    assert R.region_features(R.region_sums(R.tiles(images.limit(0)))).count() == 0


def test_no_pixel_is_a_row(spark):
    plan = R.region_features(R.region_sums(R.tiles(frame(spark, drawn()))))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and "explode(sequence(0, (h" in plan


def test_planes_of_all_colours_equal_the_column_form(spark):
    rows = spark.range(1 << 24).select(*[(F.shiftright("id", 8 * k).bitwiseAND(255)).cast("int").alias(c) for k, c in enumerate("bgr")])
    h, s, v = L.bgr_to_hsv(F.col("b"), F.col("g"), F.col("r"))

    def off(batches):
        import pyarrow as pa

        for batch in batches:
            b, g, r, *want = (batch.column(c).to_numpy() for c in ("b", "g", "r", "h", "s", "v"))
            got = R.hsv_plane(np.stack([b, g, r], -1).astype(np.uint8)).astype(int)
            yield pa.RecordBatch.from_pydict({"most": [int(max(np.abs(got[:, k] - want[k]).max() for k in range(3)))], "n": [len(b)]})

    found = rows.select("*", h.alias("h"), s.alias("s"), v.alias("v")).mapInArrow(off, "most long, n long").agg(F.max("most"), F.sum("n")).first()
    assert tuple(found) == (0, 1 << 24)


def test_features_from_png_files(spark, tmp_path):
    red, mask = np.full((15, 20, 3), (250, 10, 10), np.uint8), np.full((15, 20), 255, np.uint8)
    mixed = np.array([[(0, 0, 0), (255, 255, 255), (10, 20, 30)]], np.uint8)
    for name, image in (("1.png", red), ("1.mask.png", mask), ("2.png", mixed), ("2.mask.png", mask)):
        (tmp_path / name).write_bytes(G.png_bytes(image))
    images = G.masked_images(G.bgr_images(spark, str(tmp_path)))
    assert {r.roi_id: bytes(r.data) for r in images.collect()}[2] == bytes([0, 0, 0, 255, 255, 255, 30, 20, 10])
    got = {r.roi_id: r for r in R.region_features(R.region_sums(R.tiles(images))).collect()}
    assert (got[1].n, got[1].color, got[1].kind) == (300, "빨강", "printed") and got[1].ink == pytest.approx(240 / 255)
    assert got[2].n == 0  # its mask is of another size
