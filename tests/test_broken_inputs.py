"""Files that cannot be read, images that cannot be decoded, and pages with too many items."""

import json
import os
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from imprintmatch import storage
from imprintmatch.sources import catalog as S
from imprintmatch.sources import images as G

PAGE = '{"header":{"resultCode":"00"},"body":{"items":[{"ITEM_NAME":"a"},{"ITEM_NAME":"b"}]}}'


def png(rows):
    """A PNG file of rows of (r, g, b)."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + bytes(v for pixel in row for v in pixel) for row in rows)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_a_broken_part_makes_a_snapshot_unreadable(spark, tmp_path):
    path = f"{tmp_path}/catalog"
    S.refresh_catalog(spark.createDataFrame([(1, PAGE)], "page_no long, payload string"), path, 1, 50.0)
    assert S.load_snapshot(spark, path).count() == 2
    with open(os.path.join(path, "version=1", "part-99999-broken.parquet"), "wb") as f:
        f.write(b"PAR1 this is no footer PAR1")
    assert S.load_snapshot(spark, path) is None


def test_a_page_with_too_many_items_fails(spark):
    full = json.dumps({"body": {"items": [{"ITEM_NAME": str(i)} for i in range(101)]}})
    pages = spark.createDataFrame([(1, full)], "page_no long, payload string")
    with pytest.raises(Exception, match="more than 100 items on page 1"):
        S.flatten_envelope(pages).collect()
    assert S.flatten_envelope(pages, rows_per_page=200).count() == 101


def test_images_that_do_not_decode_are_quarantined(spark, tmp_path):
    for name, data in (("a.png", png([[(1, 2, 3)]])), ("b.png", b"\x89PNG\r\n\x1a\nxxxx"), ("c.webp", b"RIFF1234WEBPxx"), ("d.gif", b"GIF89a"), ("e.png", b"no")):
        (tmp_path / name).write_bytes(data)
    good, bad = G.read_images(spark, str(tmp_path), decode=True)
    assert {r.path[-5:] for r in good.collect()} == {"a.png", ".webp"}
    assert {r.path[-5:]: r.reason for r in bad.collect()} == {"b.png": "decode", "d.gif": "suffix", "e.png": "content"}


def test_a_cluster_must_name_its_shared_folder():
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context

        class conf:
            get = staticmethod(lambda name, default: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session)
