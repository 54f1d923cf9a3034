"""Detections, contours and pixels that belong to no region are left before they are worked on; files are read once."""

import numpy as np
from pyspark.sql import functions as F

from imprintmatch.operators import regions as R
from imprintmatch.plans import single as N
from imprintmatch.sources import images as G


def test_rows_of_regions(spark, monkeypatch):
    rows = spark.range(100).select(F.col("id").alias("image_id"), (F.col("id") % 7).alias("v"))
    regions = spark.createDataFrame([(3,), (5,), (5,), (200,), (None,)], "roi_id long")
    for most in (N.MOST_SENT, 0):
        monkeypatch.setattr(N, "MOST_SENT", most)
        assert sorted(N.of_regions(rows, regions).select("image_id", "v").collect()) == [(3, 3), (5, 5)]


def test_semi_join_goes_below_the_window(spark):
    from pyspark.sql import Window as W

    rows = spark.range(100).select((F.col("id") % 9).alias("image_id"), "id").withColumn("n", F.row_number().over(W.partitionBy("image_id").orderBy("id")))
    plan = N.of_regions(rows, spark.range(2).select(F.col("id").alias("roi_id")))._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("Window") < plan.index("LeftSemi")


def test_masks_by_one_pass(spark):
    data = lambda k: bytes([k] * 6)
    rows = [("/x/1.png", 2, 1, 3, data(1)), ("/x/1.mask.png", 2, 1, 1, b"ab"), ("/x/2.png", 2, 1, 3, data(2)), ("/x/2.mask.png", 2, 1, 3, data(9)), ("/x/3.png", 2, 1, 3, data(3)), ("/x/3.mask.png", 1, 1, 1, b"a"),
            ("/x/4.mask.png", 2, 1, 1, b"ab")]
    got = G.masked_images(spark.createDataFrame(rows, "path string, w int, h int, channels int, data binary"))
    key = lambda r: (-1 if r[0] is None else r[0], bytes(r[1]), r[2] and bytes(r[2]))
    assert sorted((key(r) for r in got.select("roi_id", "data", "mask").collect()), key=str) == sorted([(1, data(1), b"ab"), (2, data(2), None), (3, data(3), None)], key=str)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_tiles_of_doubled_pixels_in_few_batches(spark):
    cells = [(k, x % 20, x % 32, x % 256, 0, 7, x % 3 == 0) for k in range(200) for x in range(60)]
    pixels = spark.createDataFrame(cells, "roi_id long, x int, y int, b int, g int, r int, in_mask boolean").coalesce(1)
    tiles = R.pixel_tiles(pixels.union(pixels), 20, 33, lines=16)
    assert tiles.count() == 600
    for row in tiles.filter("roi_id = 7 and y0 = 16").collect():
        want = np.zeros((18, 20), np.uint8)
        for _, x, y, b, _, r, _ in cells[:60]:
            if y >= 15:
                want[y - 15, x] = max(want[y - 15, x], np.rint(0.299 * r + 0.114 * b))
        assert bytes(row.data) == want.tobytes()
