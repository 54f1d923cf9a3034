"""A content-addressed WARC archive.

Every payload is stored once under its SHA-256; record headers are kept apart, byte for byte, with the
digest of their payload.  Records come back by joining the two and are checked against both digests.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

END = "\r\n"
#: Payloads shorter than this are written again as responses rather than as revisits.
REVISIT_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def write_archive(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write one record per row of pages to the folders kind=headers and kind=payloads under path.

    Of records with equal payloads of REVISIT_BYTES or more the one with the largest page_id is the
    response and the others revisit it; shorter ones are all responses.  Payloads are dealt out once;
    headers are made from digests alone.

    Cases: a null html is an empty payload; a null url gives a record without a target, an empty one an empty
    target, one with line ends a target in base64, so that every url comes back as it was; a null page_id
    ranks lowest; of repeated rows and ties one is the response.  A payload of any length is one value.
    Columns other than these three are not read, so their names cannot clash.  An empty table gives an
    archive without records.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    payloads = rows.select(F.sha2("payload", 256).alias("key"), "payload").dropDuplicates(["key"])
    payloads.select("key", F.lit(None).cast("binary").alias("header"), "payload").write.parquet(f"{path}/kind=payloads")
    # Row numbers are stored before they are compared: they may differ if they are made again.
    slim = rows.select("page_id", "url", F.sha2("payload", 256).alias("key"), F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("size"), F.monotonically_increasing_id().alias("row"))
    slim = cut(slim)
    who = F.struct("page_id", "row")
    long = slim.filter(F.col("size") >= REVISIT_BYTES)
    first = long.groupBy("key").agg(F.max(who).alias("first"))
    long = long.join(first, "key").withColumn("refers_to", F.when(who != F.col("first"), F.col("first.page_id")))
    long = long.withColumn("revisit", who != F.col("first")).drop("first")
    short = slim.filter(F.col("size") < REVISIT_BYTES).withColumns({"refers_to": F.lit(None).cast("long"), "revisit": F.lit(False)})
    broken = F.col("url").rlike(r"[\r\n]")
    header = F.concat(
        F.lit("WARC/1.1" + END),
        _line("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", _record_id(F.col("page_id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.when(~broken, F.col("url"))),
        _line("X-Target-URI-Base64", F.when(broken, F.translate(F.base64(F.encode("url", "utf-8")), END, ""))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("WARC-Profile", F.when(F.col("revisit"), F.lit(PROFILE))),
        _line("WARC-Refers-To", F.when(F.col("revisit"), _record_id(F.col("refers_to")))),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("size")).cast("string")),
    )
    headers = long.unionByName(short).select("key", F.encode(header, "utf-8").alias("header"), F.lit(None).cast("binary").alias("payload"))
    headers.write.parquet(f"{path}/kind=headers")


SCHEMA = "key string, header binary, payload binary"


def _field(name: str) -> Column:
    """A header's value, null where it has none.  Only CR LF ends a line, whatever else a value holds."""
    pattern = rf"(?:\A|\r\n){name}: ([^\r\n]*)"
    return F.when(F.col("_head").rlike(pattern), F.regexp_extract("_head", pattern, 1))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records: page_id, url, record_type, refers_to, header, payload (in full, for revisits too), payload_bytes
    and payload_digest (bare SHA-1), both of the stored payload.

    Fails if a payload is missing or does not have the digests under which it was stored.  Every stored
    payload is checked once; it goes through the join only where it is asked for.
    """
    of_kind = lambda kind: spark.read.schema(SCHEMA).parquet(f"{path}/kind={kind}")
    fail = lambda message: F.raise_error(F.concat(F.lit(message), F.col("key"))).cast("string")
    whole = F.when(F.sha2("payload", 256) == F.col("key"), F.col("key")).otherwise(fail("payload is not what was stored: "))
    stored = of_kind("payloads").select(whole.alias("key"), "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("_sha1"))
    rows = of_kind("headers").select("key", "header").join(stored, "key", "left").withColumn("_head", F.decode("header", "utf-8"))
    digest = F.when(F.col("_sha1").isNull(), fail("payload is missing: ")).when(F.concat(F.lit("sha1:"), F.col("_sha1")) == _field("WARC-Payload-Digest"), F.col("_sha1")).otherwise(fail("payload is not what was stored: "))
    payload = F.when(digest.isNotNull(), F.col("payload"))
    page = lambda c: F.nullif(F.regexp_extract(c, r"\A<urn:page:(-?\d*)>", 1), F.lit("")).cast("long")
    return rows.select(
        page(_field("WARC-Record-ID")).alias("page_id"),
        F.coalesce(_field("WARC-Target-URI"), F.decode(F.unbase64(_field("X-Target-URI-Base64")), "utf-8")).alias("url"),
        _field("WARC-Type").alias("record_type"),
        page(_field("WARC-Refers-To")).alias("refers_to"),
        "header",
        payload.alias("payload"),
        "payload_bytes",
        digest.alias("payload_digest"),
    )


def archive_digest(records: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def export_warc(records: DataFrame, path: str) -> None:
    """Plain WARC files, one for each partition: header, empty line, block, empty line."""
    block = F.when(F.col("record_type") == "revisit", F.lit("")).otherwise(F.decode("payload", "utf-8"))
    text = F.concat(F.decode("header", "utf-8"), F.lit(END), block)
    records.select(text.alias("value")).write.option("lineSep", END + END).text(path)


def parse_warc(data: bytes):
    """(header, block) of each record of a WARC file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        size = int(re.search(rb"(?im)^content-length: *(\d+)", data[at:end])[1])
        yield data[at : end + 2], data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def import_warc(spark: SparkSession, path: str) -> DataFrame:
    """(header, block) of every record of the WARC files under path; a task reads a file at a time."""

    def parsed(batches):
        for batch in batches:
            for data in batch["content"]:
                found = list(parse_warc(bytes(data)))
                yield pd.DataFrame({"header": [h for h, _ in found], "block": [b for _, b in found]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parsed, "header binary, block binary")
