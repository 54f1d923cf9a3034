"""Refreshing the catalogue: all or nothing, and the last whole version as the way back."""

import json
import os

import pytest

from imprintmatch.sources import catalog as S

SCHEMA = "page_no long, payload string"


def page(*names):
    return json.dumps({"header": {"resultCode": "00"}, "body": {"items": [{"ITEM_NAME": n} for n in names]}})


ERROR = '{"header":{"resultCode":"30","resultMsg":"KEY"},"body":{}}'


@pytest.fixture
def catalog(spark, tmp_path):
    path = f"{tmp_path}/catalog"
    S.refresh_catalog(spark.createDataFrame([(1, page("a", "b")), (2, page("c"))], SCHEMA), path, 1, 50.0)
    return path


def names(spark, path):
    found = S.load_snapshot(spark, path)
    return found and (found.first().version, sorted(r.item_name for r in found.collect()))


OLD = (1, ["a", "b", "c"])


def test_manifest_tells_what_was_written(spark, tmp_path):
    manifest = S.refresh_catalog(spark.createDataFrame([(1, page("a", "b")), (2, page("c"))], SCHEMA), f"{tmp_path}/c", 4, 50.0)
    assert (manifest["version"], manifest["n_items"], manifest["last_page"], manifest["loaded_at"]) == (4, 3, 2, 50.0)
    assert sum(f["rows"] for f in manifest["files"].values()) == 3
    with open(f"{tmp_path}/c/version=4/{S.MANIFEST}") as f:
        assert json.load(f) == manifest


@pytest.mark.parametrize("rows, expected, fault", [
    ([(1, page("x")), (2, ERROR)], None, r"2 \(bad\)"), ([(1, page("x")), (2, "<xml/>")], None, r"2 \(bad\)"), ([(1, page("x")), (3, page("y"))], None, r"2 \(missing\)"),
    ([(1, page("x"))], (1, 2), r"2 \(missing\)"), ([(1, page("x")), (1, page("y"))], None, r"1 \(repeated\)"), ([], (1, 1), r"1 \(missing\)"),
])
def test_a_faulty_page_stops_the_refresh(spark, catalog, rows, expected, fault):
    with pytest.raises(S.CatalogError, match=fault):
        S.refresh_catalog(spark.createDataFrame(rows, SCHEMA), catalog, 2, 60.0, expected=expected)
    assert names(spark, catalog) == OLD and S.published_versions(spark, catalog) == [1]


def test_faulty_pages_may_be_put_aside(spark, catalog):
    S.refresh_catalog(spark.createDataFrame([(1, page("x")), (2, ERROR), (4, page("y"))], SCHEMA), catalog, 2, 60.0, quarantine=True)
    assert names(spark, catalog) == (2, ["x", "y"])
    aside = spark.read.parquet(f"{catalog}/version=2/_quarantine")
    assert [(r.page_no, r.payload, r.fault) for r in aside.collect()] == [(2, ERROR, "bad")]


def test_a_refresh_that_stops_half_way_changes_nothing(spark, catalog, monkeypatch):
    pages = spark.createDataFrame([(1, page("x"))], SCHEMA)
    whole = S._publish

    def stop(*args):
        raise RuntimeError("power cut")

    monkeypatch.setattr(S, "_publish", stop)
    with pytest.raises(RuntimeError):
        S.refresh_catalog(pages, catalog, 2, 60.0)
    assert names(spark, catalog) == OLD
    monkeypatch.setattr(S, "_publish", whole)
    # moved to its place, but stopped before the manifest, or within it
    os.makedirs(f"{catalog}/version=3")
    spark.createDataFrame([(0, "half")], "item_idx long, item_name string").write.parquet(f"{catalog}/version=4")
    with open(f"{catalog}/version=3/{S.MANIFEST}", "w") as f:
        f.write('{"version": 3, "n_it')
    assert names(spark, catalog) == OLD
    S.refresh_catalog(pages, catalog, 4, 70.0)
    assert names(spark, catalog) == (4, ["x"])
    with pytest.raises(S.CatalogError, match="published already"):
        S.refresh_catalog(pages, catalog, 4, 80.0)


@pytest.mark.parametrize("harm", ["lost", "cut", "changed", "more"])
def test_a_broken_version_gives_way_to_the_last_whole_one(spark, catalog, harm):
    S.refresh_catalog(spark.createDataFrame([(k, page(*"xyz")) for k in range(1, 9)], SCHEMA), catalog, 2, 60.0)
    assert names(spark, catalog)[0] == 2
    folder = f"{catalog}/version=2"
    part = sorted(f for f in os.listdir(folder) if f.endswith(".parquet"))[0]
    if harm == "lost":
        os.remove(f"{folder}/{part}")
    else:
        with open(f"{folder}/{part}", "rb") as f:
            data = f.read()
        name = "part-more.parquet" if harm == "more" else part
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data if harm == "more" else data[:-9] if harm == "cut" else data[:-20] + bytes(20))
    assert names(spark, catalog) == OLD


def test_an_empty_catalogue_is_no_snapshot(spark, tmp_path):
    S.refresh_catalog(spark.createDataFrame([(1, page())], SCHEMA), f"{tmp_path}/c", 1, 5.0)
    assert S.load_snapshot(spark, f"{tmp_path}/c") is None
    assert S.load_progress(spark.createDataFrame([], SCHEMA)).count() == 0
