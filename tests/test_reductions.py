"""OCR, detection and pixel reductions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from imprintmatch.functions import labels as L
from imprintmatch.operators import detect as D
from imprintmatch.operators import ocr as O
from imprintmatch.operators import pixels as P


def test_cascade_and_sweep(spark):
    lines = spark.createDataFrame([(1, 1, 0, "ab", 0.34), (1, 5, 1, "y z", 0.21), (1, 5, 0, "x?", 0.2), (2, 1, 0, "", 0.9), (3, 2, 0, "é", 0.9)], "roi_id long, pass_no int, line_no int, text string, conf double")
    assert {r.roi_id: r.text for r in O.ocr_cascade(O.ocr_pass_text(lines)).collect()} == {1: "X Y Z", 2: "", 3: ""}
    tries = spark.createDataFrame([(1, 0, "ab"), (1, 1, "abc"), (1, 2, "ab cd"), (1, 3, "cd ab"), (2, 0, "a b")], "roi_id long, attempt_no long, text string")
    assert {r.roi_id: r.text for r in O.ocr_sweep_best(tries).collect()} == {1: "AB CD", 2: ""}


def test_route(spark):
    regions = spark.createDataFrame([(1, True, False, "debossed"), (2, True, True, "debossed"), (3, False, False, "debossed"), (4, True, False, "printed"), (5, True, False, "debossed"), (6, True, False, "debossed")], "roi_id long, has_detector boolean, is_capsule boolean, imprint_type string")
    text = lambda rows: spark.createDataFrame(rows, "roi_id long, text string")
    got = O.route_imprint(regions, text([(i, "C") for i in range(1, 7)]), text([(1, "RRR"), (2, "RRR"), (5, "RR")]), text([(5, "SSS")])).collect()
    assert {r.roi_id: r.text for r in got} == {1: "RRR", 2: "C", 3: "C", 4: "C", 5: "SSS", 6: "C"}


def model_nms(boxes, conf, most):
    order, kept = sorted(range(len(conf)), key=lambda i: -conf[i]), []
    for i in order:
        def iou(j):
            a, b = boxes[i], boxes[j]
            w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
            both = max(0, w) * max(0, h)
            return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)

        if all(iou(j) <= most for j in kept):
            kept.append(i)
    return kept


def test_nms(spark):
    rnd = random.Random(3)
    rows = []
    for image in range(20):
        for a in range(rnd.randint(1, 12)):
            x, y = rnd.uniform(0, 40), rnd.uniform(0, 40)
            rows.append((image, a, rnd.random(), 1, x, y, x + rnd.uniform(5, 30), y + rnd.uniform(5, 30)))
    got = D.nms_boxes(spark.createDataFrame(rows, "image_id long, anchor_id long, conf double, class_id int, x0 double, y0 double, x1 double, y1 double"))
    kept = {(r.image_id, r.anchor_id) for r in got.collect()}
    for image in range(20):
        own = [r for r in rows if r[0] == image]
        assert {a for i, a in kept if i == image} == set(model_nms([r[4:] for r in own], [r[2] for r in own], 0.45))


def dets(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "image_id long, det_id long, ch string, conf double, x0 int, y0 int, x1 int, y1 int")


def linear(spark, rows):
    return D.decode_linear(dets(spark, rows)).first().text


def test_linear(spark):
    row = [("V", 0.9, 100, 100, 120, 140), ("V", 0.9, 130, 100, 150, 140), ("D", 0.9, 70, 100, 90, 140), ("0", 0.8, 100, 200, 120, 240), ("1", 0.8, 130, 200, 150, 240), ("-", 0.13, 116, 210, 124, 214)]
    assert linear(spark, row) == "D-W OI".replace("-W", "V-V")
    assert linear(spark, row[::-1]) == linear(spark, row)


LINES = {
    "one line from left to right": ([("B", 0.9, 40, 10, 60, 30), ("A", 0.9, 10, 10, 30, 30), ("C", 0.3, 70, 10, 90, 30)], "ABC"),
    "nothing sure": ([("A", 0.24, 10, 10, 30, 30), ("-", 0.11, 10, 10, 30, 30)], ""),
    "of two boxes at one place the surer": ([("A", 0.5, 10, 10, 30, 30), ("4", 0.6, 14, 10, 34, 30), ("B", 0.9, 28, 10, 48, 30)], "4B"),
    "equally sure boxes at one place": ([("A", 0.5, 10, 10, 30, 30), ("4", 0.5, 14, 10, 34, 30), ("B", 0.9, 28, 10, 48, 30)], "AB"),
    "a stray far from the others": ([(c, 0.9, 10 + 20 * i, 10, 30 + 20 * i, 30) for i, c in enumerate("ABCDE")] + [("X", 0.9, 900, 10, 920, 30)], "ABCDE"),
    "two lines": ([("X", 0.9, 10, 10, 30, 30), ("Y", 0.9, 40, 10, 60, 30), ("1", 0.9, 10, 110, 30, 130), ("0", 0.9, 40, 110, 60, 130)], "XY IO"),
    "three characters are one line": ([("X", 0.9, 10, 10, 30, 30), ("Y", 0.9, 40, 10, 60, 30), ("1", 0.9, 70, 110, 90, 130)], "XY1"),
    "doubled letters": ([("D", 0.9, 10, 10, 30, 30), ("D", 0.9, 40, 10, 60, 30), ("V", 0.9, 70, 10, 90, 30)], "DV"),
}


@pytest.mark.parametrize("name", LINES)
def test_linear_cases(spark, name):
    rows, want = LINES[name]
    assert linear(spark, rows) == want


def test_linear_keeps_images_apart(spark):
    every = [(i, k, *r) for i, (rows, _) in enumerate(LINES.values()) for k, r in enumerate(rows)]
    frame = spark.createDataFrame(every, "image_id long, det_id long, ch string, conf double, x0 int, y0 int, x1 int, y1 int")
    got = D.decode_linear(frame.repartition(5))
    assert {r.image_id: r.text for r in got.collect()} == {i: want for i, (_, want) in enumerate(LINES.values())}
    assert "Python" not in got._jdf.queryExecution().toString()


def test_radial(spark):
    rows = [("A", 0.5, 310, 0, 330, 10), ("P", 0.4, 600, 230, 620, 250), ("C", 0.5, 310, 460, 330, 480), ("C", 0.1, 0, 230, 10, 250)]
    with_size = dets(spark, rows).withColumns({"img_w": F.lit(640), "img_h": F.lit(480)})
    assert D.decode_radial(with_size).first().text == "PCA"
    assert D.decode_radial(with_size.filter("ch <> 'P'")).first().text == "AC"


def test_unletterbox(spark):
    box = spark.createDataFrame([(1, 1280, 960, 0.0, 80.0, 640.0, 700.0)], "image_id long, img_w int, img_h int, x0 double, y0 double, x1 double, y1 double")
    r = D.unletterbox(box).first()
    assert (r.x0, r.y0, r.x1, r.y1) == (0.0, 0.0, 1279.0, 959.0)


def test_boxes(spark):
    c = spark.createDataFrame([(1, 100, 100, 0, 10, 10, 30, 20, 500.0), (2, 100, 100, 0, 0, 0, 100, 100, 9000.0), (3, 60, 60, 0, 1, 1, 20, 20, 400.0)], "image_id long, img_w int, img_h int, box_id long, x int, y int, w int, h int, area double")
    crops = {r.image_id: (r.x0, r.y0, r.x1, r.y1) for r in D.auto_crop_box(c).collect()}
    assert crops == {1: (8, 8, 42, 32), 2: (0, 0, 100, 100), 3: (0, 0, 60, 60)}
    text = {r.image_id: (r.x0, r.y0, r.x1, r.y1) for r in D.text_union_box(c.withColumn("area", F.when(F.col("image_id") == 3, 10.0).otherwise(F.col("area")))).collect()}
    assert text == {1: (7, 7, 43, 33), 2: (0, 0, 100, 100), 3: (3, 12, 57, 51)}


def test_hsv(spark):
    rows = spark.createDataFrame([(0, 0, 255), (255, 0, 0), (0, 255, 0), (0, 0, 0), (10, 20, 200)], "b int, g int, r int")
    h, s, v = L.bgr_to_hsv(F.col("b"), F.col("g"), F.col("r"))
    assert [tuple(r) for r in rows.select(h, s, v).collect()] == [(0, 255, 255), (120, 255, 255), (60, 255, 255), (0, 0, 0), (2, 242, 200)]


BOXES = "image_id long, anchor_id long, conf double, class_id int, x0 double, y0 double, x1 double, y1 double"


def test_nms_of_crowded_images_and_images_over_batches(spark, monkeypatch):
    rnd = random.Random(8)
    rows = []
    for image, many in ((1, 700), (2, 3), (3, 300), (None, 80), (5, 1)):
        for a in range(many):
            x, y, conf = rnd.uniform(0, 300), rnd.uniform(0, 300), rnd.choice([0.2, 0.5, rnd.random()])
            wide = 290 if a % 50 == 0 else 30
            rows.append((image, a, conf, 1, x, y, x + rnd.uniform(0, wide), y + rnd.uniform(5, wide)))
    frame = spark.createDataFrame(rows, BOXES)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        kept = {(r.image_id, r.anchor_id) for r in D.nms_boxes(frame).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for image in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == image]
        assert {a for i, a in kept if i == image} == {own[k][1] for k in model_nms([r[4:] for r in own], [r[2] for r in own], 0.45)}
    assert D.nms_boxes(frame.limit(0)).count() == 0


def test_nms_of_an_image_with_a_hundred_thousand_boxes(spark):
    rows = spark.range(100_000).select(F.lit(1).cast("long").alias("image_id"), F.col("id").alias("anchor_id"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("conf"), F.lit(1).alias("class_id"), ((F.col("id") % 500) * 8.0).alias("x0"), (F.floor(F.col("id") / 500) * 8.0).alias("y0"))
    boxes = rows.withColumns({"x1": F.col("x0") + 10, "y1": F.col("y0") + 10})
    apart = D.nms_boxes(boxes)
    assert apart.count() == 100_000  # neighbours share a fifth at most
    twice = D.nms_boxes(boxes.unionByName(boxes.withColumns({"anchor_id": F.col("anchor_id") + 100_000, "x0": F.col("x0") + 1, "conf": F.col("conf") / 2})))
    assert twice.agg(F.count("*"), F.max("anchor_id")).first()[:] == (100_000, 99_999)
    assert "collect_list" not in twice._jdf.queryExecution().toString()
