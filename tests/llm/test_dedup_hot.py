"""A text with very many copies under one doc_id, or none, is dealt over ranges, and one of them stays."""

import pytest
from pyspark.sql import functions as F

from imprintmatch.llm.exact_dedup import content_sort


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("ids", ["id % 1 + 5", "cast(null as long)", "if(id % 2 = 0, null, 9)", "id % 3"])
def test_copies_of_few_ids(spark, keep, ids):
    docs = spark.range(3000).repartition(9).select(F.expr(ids).cast("long").alias("doc_id"), F.lit("same text").alias("text"))
    docs = docs.union(spark.createDataFrame([(5, "other"), (None, "other")], "doc_id long, text string"))
    rows = content_sort(docs, keep=keep).collect()
    known = {r.doc_id for r in docs.filter("text = 'same text' and doc_id is not null").distinct().collect()}
    want = (max if keep == "largest" else min)(known) if known else None
    same = [r for r in rows if r.group_size == 3000]
    assert len(same) == 3000 and {r.keep_id for r in same} == {want}
    assert [r.doc_id for r in same if r.kept] == [want]
    assert [(r.doc_id, r.keep_id) for r in rows if r.group_size == 2 and r.kept] == [(5, 5)]
