import pytest
from pyspark.sql import functions as F

from imprintmatch.operators import corpus as C
from imprintmatch.sources import catalog as S
from imprintmatch.sources import images as G
from imprintmatch.sources import labels as Y

#: payload, number of items, error
ENVELOPES = [
    ('{"header":{"resultCode":"00"},"body":{"items":[{"ITEM_NAME":"a"},3,null]}}', 1, False),
    ('{"response":{"header":{"resultCode":"00"},"body":{"items":{"item":[{"ITEM_NAME":"a"},{"ITEM_NAME":"b"}]}}}}', 2, False),
    ('{"body":{"item":{"ITEM_NAME":"a"}}}', 1, False),
    ('{"body":{"items":{"item":{"ITEM_NAME":"a"}}}}', 1, False),
    ('{"header":{"resultCode":"00","resultMsg":"OK"},"body":{"items":""}}', 0, False),
    ('{"header":{"resultCode":"30","resultMsg":"KEY"},"body":{}}', 0, True),
    ('{"header":{"resultMsg":"X"}}', 0, True),
    ('{"header":{"resultCode":0,"resultMsg":"OK"},"body":{}}', 0, True),
    ('{"header":{"result_code":"0","result_msg":"OK"},"body":{}}', 0, False),
    ("{}", 0, False),
    ("[1]", 0, False),
    ('{"body":{"items":{"item":null}}}', 0, False),
    ('{"body":{"items":null,"item":[{"ITEM_NAME":7}]}}', 1, False),
    ("<xml/>", 0, True),
]


def test_envelopes(spark):
    pages = spark.createDataFrame([(i + 1, p) for i, (p, _, _) in enumerate(ENVELOPES)], "page_no long, payload string")
    status = {r.page_no: (r.n_items, r.is_error) for r in S.page_status(pages).collect()}
    assert status == {i + 1: (n, e) for i, (_, n, e) in enumerate(ENVELOPES)}
    items = S.flatten_envelope(pages).collect()
    assert len(items) == sum(n for _, n, _ in ENVELOPES)
    assert {r.item_idx for r in items if r.page_no == 2} == {100, 101}
    assert [r.item_name for r in items if r.page_no == 13] == ["7"]
    good, bad = S.split_pages(pages)
    assert bad.count() == 4 and good.count() == len(ENVELOPES) - 4


def test_snapshots(spark, tmp_path):
    path = f"{tmp_path}/catalog"
    assert S.load_snapshot(spark, path) is None
    pages = spark.createDataFrame([(1, ENVELOPES[1][0]), (2, ENVELOPES[-1][0])], "page_no long, payload string")
    with pytest.raises(S.CatalogError, match=r"2 \(bad\)"):
        S.refresh_catalog(pages, path, 1, 50.0)
    assert S.load_snapshot(spark, path) is None
    S.refresh_catalog(pages, path, 1, 50.0, quarantine=True)
    S.refresh_catalog(pages, path, 2, 60.0, quarantine=True)
    rows = S.load_snapshot(spark, path).collect()
    assert len(rows) == 2 and {r.loaded_at for r in rows} == {60.0}
    ages = spark.createDataFrame([(0.0,), (1.0,), (None,)], "t double").select(S.is_stale(F.col("t"), S.WEEK + 0.5).alias("s"), S.snapshot_action(F.col("t"), F.lit(1), S.WEEK + 0.5).alias("a"))
    assert [(r.s, r.a) for r in ages.collect()] == [(True, "refresh"), (False, "use"), (True, "refresh")]


def test_pages_from_files(spark, tmp_path):
    for i, (payload, _, _) in enumerate(ENVELOPES):
        (tmp_path / f"page_{i + 1}.json").write_text(payload)
    rows = S.read_catalog_pages(spark, str(tmp_path), pages=(2, 14)).collect()
    assert sorted(r.page_no for r in rows) == list(range(2, 15))
    assert [r.page_no for r in rows if not r.parse_ok] == [14]
    pages = S.read_catalog_pages(spark, str(tmp_path))
    progress = [tuple(r) for r in S.load_progress(pages).orderBy("page_no").collect()]
    assert progress == [(1, 1, 1), (2, 2, 3), (3, 1, 4), (4, 1, 5), (13, 1, 6)]
    assert [tuple(r) for r in S.load_progress(S.flatten_envelope(pages)).orderBy("page_no").collect()] == progress


def test_images(spark, tmp_path):
    for name, data in (("a.png", b"\x89PNG\r\n\x1a\nxxxx"), ("b.jpg", b"\xff\xd8\xff\xe0xxxxxxxx"), ("c.webp", b"RIFF1234WEBPxx"), ("d.gif", b"GIF89a"), ("e.png", b"no")):
        (tmp_path / name).write_bytes(data)
    good, bad = G.read_images(spark, str(tmp_path))
    assert sorted(r.kind for r in good.collect()) == ["jpeg", "png", "webp"]
    assert sorted(r.reason for r in bad.collect()) == ["content", "suffix"]


def test_label_files(spark, tmp_path):
    (tmp_path / "train").mkdir()
    (tmp_path / "train" / "synth_0000012.txt").write_text("20 0.470703 0.487305 0.083984 0.089844\n3 0.5 0.5 0.1 0.1\n")
    rows = Y.read_yolo_labels(spark, str(tmp_path), Y.read_class_map(spark)).orderBy("line_no").collect()
    assert [(r.split, r.stem, r.line_no, r.ch) for r in rows] == [("train", "synth_0000012", 0, "K"), ("train", "synth_0000012", 1, "3")]
    out = f"{tmp_path}/out"
    Y.write_yolo_labels(spark.createDataFrame([("val", "s1", i, i, 0.1 * i, 0.2, 0.3, 0.4) for i in range(3)], "split string, stem string, line_no int, class_id int, cx double, cy double, w double, h double"), out)
    back = Y.read_yolo_labels(spark, out).orderBy("line_no").collect()
    assert [(r.split, r.stem, r.class_id, r.cx) for r in back] == [("val", "s1", 0, 0.0), ("val", "s1", 1, 0.1), ("val", "s1", 2, 0.2)]


def test_class_map(spark):
    assert Y.read_class_map(spark).count() == 38
    assert [r.ch for r in Y.read_class_map(spark, {1: "y", 0: "x"}).orderBy("class_id").collect()] == ["x", "y"]
    assert Y.read_class_map(spark, ["x"]).count() == 38


def test_made_up_imprints(spark):
    a = {r.id: r.token for r in C.synth_range(spark, 5000).collect()}
    b = {r.id: r.token for r in C.synth_tokens(spark.range(5000).repartition(7)).collect()}
    assert a == b
    assert {len(t.replace("-", "")) for t in a.values()} == {2, 3, 4, 5, 6}
    long = [t for t in a.values() if len(t.replace("-", "")) >= 3]
    assert 0.15 < sum("-" in t for t in long) / len(long) < 0.21
    assert all(0 < t.index("-") < len(t) - 2 for t in long if "-" in t)
    share = spark.range(20000).select(C.assign_split(F.col("id")).alias("s")).filter("s = 'train'").count() / 20000
    assert share == pytest.approx(0.9, abs=0.01)
