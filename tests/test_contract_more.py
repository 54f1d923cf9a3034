"""Queries whose SQL needs recursion, draws or stencils, and whole jobs, give the rows of their SQL."""

import os

import pytest
from test_contract import DATA
from test_contract import test_rows as same_rows

NAMES = ["decode_linear", "nms_boxes", "deboss_score", "imprint_type", "synth_tokens", "assign_split", "route_imprint", "read_catalog_pages", "match_level", "item_has_shape", "item_has_color", "score_candidates", "score_candidates_basic", "prefilter_ladder", "topk_candidates"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", NAMES)
def test_rows(spark, name):
    same_rows(spark, name)


def test_every_query_has_its_sql():
    from imprintmatch import queries

    assert set(queries.queries()) == set(queries.oracle_sql())
