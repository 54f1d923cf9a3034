"""Repeated rows, nulls, names that clash and empty tables, for the URL filter, both classifiers and the stages."""

import pytest
from pyspark.sql import functions as F

from imprintmatch.llm import quality as Q
from imprintmatch.llm import toxicity as X
from imprintmatch.llm import url_filter as U

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"some quiet words of number {i} " + ("grobkurz schandel!! " * 3 if i % 5 == 0 else "and more"), "en", f"s{i % 3}", i) for i in range(200)]
    rows += rows[:30] + [(None, None, None, None, None), (None, "grobkurz schandel", "en", "s", 3), (7, "another text of an id", None, "s1", None), (300, "", "en", None, 0), (301, "long " * 50000, "en", "s0", 9)]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 5 > 0), int(i % 5 == 0)) for i in range(160)] + [(3, 1, 0), (None, 0, 1), (170, None, None)], "doc_id long, quality int, toxic int")


def clashing(df):
    return df.withColumns({c: F.lit(k) for k, c in enumerate(("label", "place", "score", "a", "b", "toxic", "fold", "key", "row", "_row"))})


@pytest.mark.parametrize("scores", [Q.score_quality, X.score_toxicity])
def test_scores_of_odd_rows(spark, docs, labels, scores):
    rows = scores(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    once = {}
    for r in rows:
        if r.doc_id is not None and r.doc_id < 30 and r.doc_id != 7:
            assert once.setdefault(r.doc_id, r.score) == r.score
    named = scores(clashing(docs), labels).collect()
    assert sorted(map(repr, named)) == sorted(map(repr, rows))
    assert scores(docs.limit(0), labels).collect() == []


def test_order_and_partitions_do_not_matter(spark, docs, labels):
    for scores in (Q.score_quality, X.score_toxicity):
        one = sorted((repr(r.doc_id), round(r.score, 9)) for r in scores(docs, labels).collect())
        other = sorted((repr(r.doc_id), round(r.score, 9)) for r in scores(docs.repartition(7, "text"), labels).collect())
        assert one == other


def test_urls_of_odd_rows(spark):
    urls = [None, "", "no scheme", "http://a.net/x", "http://a.net/x", "://", "http://B.Example.NET/en/q?x", "x://org/fr/" + "y" * 100000]
    pages = spark.createDataFrame([(1 if i == 4 else None if i == 5 else i, u) for i, u in enumerate(urls)], "page_id long, url string")
    pages = pages.withColumns({"host": F.lit("h"), "path": F.lit("p"), "rule": F.lit(1), "key": F.lit("k"), "_keys": F.lit(0)})
    rows = U.judge_urls(pages).collect()
    assert len(rows) == len(urls)
    assert {(r.page_id, r.host, r.rule, r.verdict) for r in rows} == {(0, "", None, "allow"), (1, "", None, "allow"), (1, "a.net", "net/", "block"), (2, "", None, "allow"), (3, "a.net", "net/", "block"), (None, "", None, "allow"), (6, "b.example.net", "example.net/en/", "allow"), (7, "org", "org/fr/", "allow")}
    assert [r.path for r in rows if r.page_id == 7] == ["/fr/" + "y" * 100000]
    assert U.judge_urls(pages.limit(0)).collect() == []


def test_stages_of_an_empty_table(spark, docs, labels, tmp_path):
    import corpus_pipeline

    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "is it so?\nit is")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), str(tmp_path))
        assert out.collect() == []
        assert name == "tokens" or out.columns == docs.columns


def test_stages_keep_further_columns(spark, docs, labels, tmp_path):
    import corpus_pipeline

    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "is it so?\nit is")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clashing(docs).write.parquet(f"{tmp_path}/documents.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, str(tmp_path))
        assert out.columns == table.columns, name
        assert 0 < out.count()
    assert corpus_pipeline.STAGES[-1][1](spark, table, str(tmp_path)).count() == docs.count()
