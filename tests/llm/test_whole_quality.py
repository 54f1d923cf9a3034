"""The quality classifier is fitted on the rows it should be."""

import numpy as np
import pytest

from imprintmatch.llm import quality as Q

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def seen(monkeypatch):
    """What co_train is given: labels and folds."""
    calls = []
    real = Q.co_train

    def spy(content, metadata, y, fold, *rest):
        calls.append((content, y, fold))
        return real(content, metadata, y, fold, *rest)

    monkeypatch.setattr(Q, "co_train", spy)
    return calls


def table(spark, n, repeats=()):
    rows = [(i, "GOOD WORDS!! " * 5 if i % 4 == 0 else f"some plain words of number {i}", "en", "s", i) for i in range(n)]
    return spark.createDataFrame(rows + [(i, f"copy {k} of {i}", "en", "s", k) for i, times in repeats for k in range(times)], DOC)


def test_repeated_ids_count_once(spark, seen):
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(80)], "doc_id long, quality int")
    Q.fit_quality(table(spark, 120, [(100, 500), (3, 50)]), labels)
    first, y, _ = seen[0]
    assert len(y) == 120 and (y >= 0).sum() == 80
    Q.fit_quality(table(spark, 120, [(100, 500), (3, 50)]).repartition(7), labels)
    assert sorted(map(tuple, np.round(first, 9))) == sorted(map(tuple, np.round(seen[1][0], 9)))


@pytest.mark.parametrize("bad", [1, 2, 5])
def test_few_bad_labels_do_not_turn_the_filter_off(spark, bad):
    docs = table(spark, 300)
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(300) if i % 4 > 0 or i < 4 * bad], "doc_id long, quality int")
    model = Q.fit_quality(docs, labels)
    assert model is not None
    rows = Q.score_quality(docs, labels).collect()
    good = [r.score for r in rows if r.doc_id % 4]
    assert max(r.score for r in rows if r.doc_id % 4 == 0) < min(good) and len(rows) == 300


def test_a_rare_kind_is_not_missed_by_the_bound(spark):
    labels = spark.createDataFrame([(i, int(i != 8)) for i in range(300)], "doc_id long, quality int")
    assert Q.fit_quality(table(spark, 300), labels, labelled=40) is not None


def test_folds_hold_both_kinds():
    y = np.array([0.0] * 4 + [1.0] * 90 + [-1.0] * 50)
    fold = Q.stratified(y, np.arange(len(y))[::-1])
    assert all({0, 1} <= set(y[f]) for f in (fold == 0, fold != 0))
