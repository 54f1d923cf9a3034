"""Catalogue pages, their envelopes, and versioned snapshots."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..storage import cut, running_total

#: The file that makes a version a published one.
MANIFEST = "_MANIFEST.json"
ROWS_PER_PAGE = 100
WEEK, MONTH = 7 * 24 * 3600, 30 * 24 * 3600

#: Fields of an item, and the codes of a page without an error.
FIELDS = ("ITEM_NAME", "ENTP_NAME", "PRINT_FRONT", "PRINT_BACK", "COLOR_CLASS1", "COLOR_CLASS2", "DRUG_SHAPE")
FINE = ("", "00", "0", "SUCCESS")


def read_catalog_pages(spark: SparkSession, path: str, pages: tuple[int, int] | None = None, number: str = r"(\d+)[^/\d]*$") -> DataFrame:
    """(page_no, payload, parse_ok) of landed pages, one file each; the page number comes from the path.

    number: a pattern whose first group is the page number.  pages: first and last page to read.
    """
    rows = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), number, 1).cast("bigint").alias("page_no"), F.col("value").alias("payload"))
    if pages:
        rows = rows.filter(F.col("page_no").between(*pages))
    return rows.withColumn("parse_ok", F.try_parse_json("payload").isNotNull())


def _at(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant")


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit(kind)), F.lit(False))


def _part(root: Column, key: str) -> Column:
    """root.key where it is an object, else response.key where response is one."""
    inner = F.when(_is(_at(root, "response"), "OBJECT"), _at(_at(root, "response"), key))
    return F.when(_is(_at(root, key), "OBJECT"), _at(root, key)).otherwise(F.when(_is(inner, "OBJECT"), inner))


def _items(root: Column) -> Column:
    """The item objects of a page, as an array of variants."""
    body = _part(root, "body")
    items = _at(body, "items")
    items = F.when(items.isNull() | F.is_variant_null(items), _at(body, "item")).otherwise(items)
    inner = _at(items, "item")
    items = F.when(_is(items, "OBJECT") & inner.isNotNull(), inner).otherwise(items)
    listed = F.filter(F.try_variant_get(items, "$", "array<variant>"), lambda v: _is(v, "OBJECT"))
    none = F.array().cast("array<variant>")
    return F.when(_is(items, "OBJECT"), F.array(items)).when(_is(items, "ARRAY"), listed).otherwise(none)


def flatten_envelope(pages: DataFrame, rows_per_page: int = ROWS_PER_PAGE) -> DataFrame:
    """One row per item: page_no, pos, item_idx and the item's fields.  item_idx needs no global sort.

    Fails on a page of more than rows_per_page items, whose item_idx would meet those of the next page.
    """
    root = F.try_parse_json("payload")
    rows = pages.select("page_no", F.posexplode(_items(root)).alias("pos", "item"))
    fields = [F.try_variant_get("item", f"$.{f}", "string").alias(f.lower()) for f in FIELDS]
    full = F.raise_error(F.concat(F.lit(f"more than {rows_per_page} items on page "), F.col("page_no").cast("string"))).cast("bigint")
    index = F.when(F.col("pos") < rows_per_page, (F.col("page_no") - 1) * rows_per_page + F.col("pos")).otherwise(full)
    return rows.select("page_no", "pos", index.cast("bigint").alias("item_idx"), *fields)


def _text(v: Column) -> Column:
    """A value as text, or null where it counts as empty: null, "", 0 and false."""
    kind, text = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
    number = F.try_variant_get(v, "$", "double")
    empty = (kind == "VOID") | ((kind == "STRING") & (text == "")) | ((kind == "BOOLEAN") & (text == "false")) | (~kind.isin("STRING", "BOOLEAN") & (number == 0))
    return F.when(v.isNotNull() & ~F.coalesce(empty, F.lit(False)), text)


def page_status(pages: DataFrame) -> DataFrame:
    """(page_no, result_code, result_msg, n_items, is_error); a page that is not JSON is an error."""
    root = F.try_parse_json("payload")
    header = _part(root, "header")
    code = F.coalesce(_text(_at(header, "resultCode")), _text(_at(header, "result_code")))
    msg = F.coalesce(_text(_at(header, "resultMsg")), _text(_at(header, "result_msg")))
    rows = pages.select("page_no", code.alias("result_code"), msg.alias("result_msg"), F.size(_items(root)).alias("n_items"), root.isNull().alias("_bad"))
    told = F.col("result_code").isNotNull() | F.col("result_msg").isNotNull()
    wrong = (F.col("n_items") == 0) & told & ~F.trim(F.coalesce("result_code", F.lit("None"))).isin(*FINE)
    return rows.select("page_no", "result_code", "result_msg", F.when(F.col("_bad"), 0).otherwise(F.col("n_items")).alias("n_items"), (F.col("_bad") | wrong).alias("is_error"))


def split_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined) pages."""
    bad = page_status(pages).filter("is_error").select("page_no")
    return pages.join(bad, "page_no", "left_anti"), pages.join(bad, "page_no", "left_semi")


def select_catalog_items(items: DataFrame, item_name: str | None = None, entp_name: str | None = None) -> DataFrame:
    """Items whose names contain the given texts."""
    for column, wanted in (("item_name", item_name), ("entp_name", entp_name)):
        if wanted:
            items = items.filter(F.contains(F.col(column), F.lit(wanted)))
    return items


class CatalogError(ValueError):
    """A refresh that may not be published."""


def page_faults(pages: DataFrame, expected: tuple[int, int] | None = None) -> DataFrame:
    """(page_no, fault) of pages that are `bad` (see page_status), `repeated` or `missing`.

    expected: first and last page of the run; without it pages are expected from 1 to the last that has landed.
    """
    seen = page_status(pages).groupBy("page_no").agg(F.count(F.lit(1)).alias("n"), F.bool_or("is_error").alias("is_error"))
    first, last = (F.lit(n).cast("bigint") for n in expected) if expected else (F.lit(1).cast("bigint"), F.greatest(F.coalesce(F.max("page_no"), F.lit(0)), F.lit(0)))
    run = seen.agg(first.alias("first"), last.alias("last")).filter("last >= first").select(F.explode(F.sequence("first", "last")).alias("page_no"))
    fault = F.when(F.col("n").isNull(), "missing").when(F.col("is_error"), "bad").when(F.col("n") > 1, "repeated")
    return run.join(seen, "page_no", "full").select("page_no", fault.alias("fault")).filter("fault is not null")


def refresh_catalog(pages: DataFrame, path: str, version: int, loaded_at: float, rows_per_page: int = ROWS_PER_PAGE, expected: tuple[int, int] | None = None, quarantine: bool = False) -> dict:
    """Publish a version of the snapshot with the items of all pages; returns its manifest.

    All or nothing: items are written aside, their rows and pages are counted by the write itself and compared with
    what the files hold, the folder is moved to its place, and a manifest of its files is written last.  Readers
    take versions with a manifest only, so whatever stops a refresh leaves the last whole version in place.

    A bad, repeated or missing page stops the refresh before anything is written.  With quarantine such pages are left out
    and stored beside the items, in `_quarantine` of the version.
    """
    spark = pages.sparkSession
    faults = cut(page_faults(pages, expected))
    shown = [f"{r.page_no} ({r.fault})" for r in faults.orderBy("page_no").limit(10).collect()]
    if shown and not quarantine:
        raise CatalogError(f"pages that cannot be published: {', '.join(shown)}")
    good = pages.join(faults, "page_no", "left_anti") if shown else pages
    attempt = f"{path.rstrip('/')}/_attempts/{version}-{uuid.uuid4().hex}"
    counted = Observation()
    items = flatten_envelope(good, rows_per_page).observe(counted, F.count(F.lit(1)).alias("n_items"), F.max("page_no").alias("last_page")).drop("page_no", "pos")
    items.withColumn("loaded_at", F.lit(float(loaded_at))).write.parquet(attempt)
    if shown:
        pages.join(faults, "page_no").write.parquet(f"{attempt}/_quarantine")
    files = _rows_by_file(spark, attempt)
    manifest = {"version": int(version), "loaded_at": float(loaded_at), "n_items": counted.get["n_items"], "last_page": counted.get["last_page"], "files": files}
    if sum(f["rows"] for f in files.values()) != manifest["n_items"]:
        raise CatalogError(f"{attempt} does not hold the {manifest['n_items']} items that were written")
    _publish(spark, attempt, f"{path.rstrip('/')}/version={version}", manifest)
    return manifest


def _publish(spark: SparkSession, attempt: str, place: str, manifest: dict) -> None:
    """Move a finished attempt to its place and write its manifest.  A version without a manifest is an unfinished one and makes way."""
    fs, there = _file_system(spark, place)
    if fs.exists(there):
        if _manifest(spark, place):
            raise CatalogError(f"{place} is published already")
        fs.delete(there, True)
    if not fs.rename(_file_system(spark, attempt)[1], there):
        raise CatalogError(f"{attempt} cannot be moved to {place}")
    out = fs.create(_file_system(spark, f"{place}/{MANIFEST}")[1], False)
    try:
        out.write(bytearray(json.dumps(manifest).encode()))
    finally:
        out.close()


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _sizes(spark: SparkSession, folder: str) -> dict[str, int]:
    """Sizes of the data files of a folder."""
    fs, where = _file_system(spark, folder)
    found = [s for s in fs.listStatus(where) if s.isFile()]
    return {s.getPath().getName(): s.getLen() for s in found if not s.getPath().getName().startswith(("_", "."))}


def _rows_by_file(spark: SparkSession, folder: str) -> dict[str, dict]:
    """Size and rows of every data file; reads footers."""
    rows = {r.name: r.n for r in spark.read.parquet(folder).groupBy(F.col("_metadata.file_name").alias("name")).agg(F.count(F.lit(1)).alias("n")).collect()}
    return {name: {"size": size, "rows": rows.get(name, 0)} for name, size in _sizes(spark, folder).items()}


def _manifest(spark: SparkSession, folder: str) -> dict | None:
    fs, where = _file_system(spark, f"{folder}/{MANIFEST}")
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        return json.loads(text)
    except ValueError:  # the write of the manifest itself was cut off
        return None
    finally:
        stream.close()


def published_versions(spark: SparkSession, path: str) -> list[int]:
    """Versions with a manifest, the latest first."""
    fs, where = _file_system(spark, path)
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    numbers = [int(n[8:]) for n in names if n.startswith("version=") and n[8:].isdigit()]
    return [n for n in sorted(numbers, reverse=True) if _manifest(spark, f"{path.rstrip('/')}/version={n}")]


def _is_whole(spark: SparkSession, folder: str, manifest: dict) -> bool:
    """Whether a folder holds the manifest's files and no others, readable and with the rows they were published with."""
    try:
        return {n: f["size"] for n, f in manifest["files"].items()} == _sizes(spark, folder) and _rows_by_file(spark, folder) == manifest["files"]
    except (PySparkException, Py4JJavaError):
        return False


def load_progress(pages: DataFrame) -> DataFrame:
    """(page_no, n_items, total): items of each page and up to it; pages without an item have no row.

    One pass over the pages: a page's items are counted where it is read (a table of items is counted by page).  Totals are sums within ranges of pages
    and of the ranges before, so no task sees all pages.
    """
    items = F.size(_items(F.try_parse_json("payload"))).cast("long") if "payload" in pages.columns else F.lit(1)
    per_page = pages.groupBy("page_no").agg(F.sum(items).alias("n_items")).filter("n_items > 0")
    return running_total(per_page, "page_no", "n_items", "total")


def load_snapshot(spark: SparkSession, path: str, now: float | None = None) -> DataFrame | None:
    """The items of the latest whole version, or None where no version with an item is whole.

    A version is whole if its files are those of its manifest, size by size and row by row; the last one that is
    takes the place of a broken or unfinished one.
    """
    for version in published_versions(spark, path):
        folder = f"{path.rstrip('/')}/version={version}"
        manifest = _manifest(spark, folder)
        if manifest and manifest["n_items"] and _is_whole(spark, folder, manifest):
            current = F.lit(float(now)) if now is not None else F.unix_micros(F.current_timestamp()) / 1e6
            items = spark.read.parquet(folder).withColumn("version", F.lit(version))
            return items.withColumn("loaded_at", F.coalesce("loaded_at", current))
    return None


def is_stale(loaded_at: Column, now: float, ttl: float = WEEK) -> Column:
    return F.coalesce(F.lit(float(now)) - loaded_at > F.lit(float(ttl)), F.lit(True))


def snapshot_action(loaded_at: Column, n_items: Column, now: float, ttl: float = WEEK) -> Column:
    return F.when((F.coalesce(n_items, F.lit(0)) > 0) & ~is_stale(loaded_at, now, ttl), "use").otherwise("refresh")


def make_pages(items: DataFrame, rows_per_page: int = ROWS_PER_PAGE) -> DataFrame:
    """(page_no, payload): items as JSON pages by item_idx, for tests and round trips."""
    item = F.struct("item_idx", F.struct(*[F.col(f.lower()).alias(f) for f in FIELDS]).alias("item"))
    pages = items.groupBy((F.floor(F.col("item_idx") / rows_per_page) + 1).cast("bigint").alias("page_no")).agg(F.array_sort(F.collect_list(item)).alias("rows"))
    body = F.struct(F.struct(F.lit("00").alias("resultCode"), F.lit("OK").alias("resultMsg")).alias("header"), F.struct(F.col("rows.item").alias("items")).alias("body"))
    return pages.select("page_no", F.to_json(body).alias("payload"))


def land_pages(pages: DataFrame, path: str) -> None:
    """One folder and file for each page, named by its number."""
    pages.select("payload", F.col("page_no").alias("page")).repartition("page").write.option("lineSep", "\n").partitionBy("page").text(path)
