"""Label files are written at their place by tasks: nothing is renamed or gathered on commit."""

import pytest
from test_contract import test_rows as same_rows

from imprintmatch.sources import labels as Y

BOXES = "split string, stem string, line_no int, class_id int, cx double, cy double, w double, h double"


def test_one_plain_file_for_each_image(spark, tmp_path):
    rows = [(("train", "val")[k % 2], f"s{k % 40}", n, n % 38, 0.25, 0.5, k / 1000, 0.1) for n in range(50) for k in range(40)]
    out = tmp_path / "out"
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # files go over batches
    try:
        Y.write_yolo_labels(spark.createDataFrame(rows, BOXES).repartition(5), str(out))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    files = sorted(str(f.relative_to(out)) for f in out.rglob("*") if f.is_file())
    assert files == sorted(["_SUCCESS"] + [f"split={('train', 'val')[k % 2]}/stem=s{k}/labels.txt" for k in range(40)])
    assert (out / "split=val/stem=s3/labels.txt").read_text() == "".join(f"{n % 38} 0.250000 0.500000 0.003000 0.100000\n" for n in range(50))
    assert Y.read_yolo_labels(spark, str(out)).count() == len(rows)
    with pytest.raises(FileExistsError):
        Y.write_yolo_labels(spark.createDataFrame(rows, BOXES), str(out))


def test_odd_names_and_no_rows(spark, tmp_path):
    names = ["a/b", "x=1%", "", None, "c d", "_e"]
    Y.write_yolo_labels(spark.createDataFrame([("t:1", n, 0, 1, 0.5, 0.5, 0.1, 0.1) for n in names], BOXES), str(tmp_path / "odd"))
    back = spark.read.text(str(tmp_path / "odd"))
    assert sorted((r.split, r.stem or "") for r in back.collect()) == sorted(("t:1", n or "") for n in names)
    Y.write_yolo_labels(spark.createDataFrame([], BOXES), str(tmp_path / "none"))
    assert (tmp_path / "none" / "_SUCCESS").exists()


@pytest.mark.parametrize("name", ["write_yolo_labels", "read_yolo_labels"])
def test_rows(spark, name):
    same_rows(spark, name)
