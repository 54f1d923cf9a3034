"""Queries give the rows of their SQL at the smallest scale."""

import os
import subprocess
import sys

import pytest

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["flatten_envelope", "page_status", "post_fix_imprint", "ocr_variants", "rank_variants", "seed_candidates", "fallback_topk", "identify_batch", "ocr_sweep_best", "decode_radial", "select_rois", "capsule_half_colors"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", SOME)
def test_rows(spark, name):
    import duckdb

    from imprintmatch import queries

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    result = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in result.description]
    want = sorted(repr([row[names.index(c)] for c in sorted(names)]) for row in result.fetchall())
    frame = queries.queries()[name](spark, DATA)
    got = sorted(repr([row[c] for c in sorted(frame.columns)]) for row in frame.collect())
    assert sorted(frame.columns) == sorted(names)
    assert got == want


def test_entry_without_the_training_data_package(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("imprintmatch.llm") or name == "corpus_pipeline":
            raise ImportError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert not [q for q in e.queries() if q.startswith("op") or q == "pipeline"], sorted(e.queries())
assert "identify_batch" in e.queries() and set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)
