"""Archives whose headers hold awkward urls, and archives that lost a payload."""

import shutil

import pytest
from pyspark.sql import functions as F

from imprintmatch.llm import warc as A

BIG = "x" * 1500
URLS = [
    "http://a/ WARC-Refers-To: <urn:page:99>",
    "http://a/\x85WARC-Payload-Digest: sha1:00",
    "http://a/\r\nWARC-Type: revisit\r\n\r\nx",
    "http://a/\nx",
    "http://a/%0Ax",
    "",
    None,
    "WARC-Target-URI: y",
]


def test_urls_come_back_as_they_were(spark, tmp_path):
    pages = spark.createDataFrame([(i, u, BIG if i % 2 else "s") for i, u in enumerate(URLS)], "page_id long, url string, html string")
    clash = pages.withColumns({"kind": F.lit("k"), "row": F.lit(1), "payload": F.lit("p"), "refers_to": F.lit(5), "_head": F.lit("h")})
    A.write_archive(clash, f"{tmp_path}/a")
    records = A.read_archive(spark, f"{tmp_path}/a").orderBy("page_id").collect()
    assert [r.url for r in records] == URLS
    assert [(r.record_type, r.refers_to) for r in records] == [("response", None) if i % 2 == 0 or i == 7 else ("revisit", 7) for i in range(8)]
    assert [bytes(r.payload).decode() for r in records] == [BIG if i % 2 else "s" for i in range(8)]


def test_ties_and_rows_without_an_id(spark, tmp_path):
    rows = [(3, "u", BIG), (3, "u", BIG), (3, "v", BIG), (None, "w", BIG), (None, "w", "t" * 1000), (None, "w", "t" * 1000), (4, "u", ""), (4, "u", None)]
    A.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), f"{tmp_path}/a")
    got = A.archive_digest(A.read_archive(spark, f"{tmp_path}/a")).collect()
    assert len(got) == len(rows)
    big = [r for r in got if r.payload_bytes == 1500]
    assert sum(r.record_type == "response" for r in big) == 1 and all(r.page_id == 3 for r in big if r.record_type == "response")
    assert sorted(r.refers_to for r in big if r.record_type == "revisit") == [3, 3, 3]
    alone = [r for r in got if r.payload_bytes == 1000]
    assert sorted((r.record_type, r.refers_to) for r in alone) == [("response", None), ("revisit", None)]
    assert [r.record_type for r in got if not r.payload_bytes] == ["response"] * 2


def test_a_missing_payload_is_noticed(spark, tmp_path):
    A.write_archive(spark.createDataFrame([(1, "u", BIG)], "page_id long, url string, html string"), f"{tmp_path}/a")
    A.write_archive(spark.createDataFrame([(1, "u", "other")], "page_id long, url string, html string"), f"{tmp_path}/b")
    shutil.copytree(f"{tmp_path}/a/kind=headers", f"{tmp_path}/c/kind=headers")
    shutil.copytree(f"{tmp_path}/b/kind=payloads", f"{tmp_path}/c/kind=payloads")
    with pytest.raises(Exception, match="payload is missing"):
        A.archive_digest(A.read_archive(spark, f"{tmp_path}/c")).collect()


def test_digests_do_not_move_payloads(spark, tmp_path):
    A.write_archive(spark.createDataFrame([(1, "u", BIG)], "page_id long, url string, html string"), f"{tmp_path}/a")
    plan = A.archive_digest(A.read_archive(spark, f"{tmp_path}/a"))._jdf.queryExecution().optimizedPlan().toString()
    assert "payload" not in next(line for line in plan.splitlines() if "Join" in line or line.startswith("Project")).replace("payload_bytes", "").replace("payload_digest", "").replace("payload is", "")
