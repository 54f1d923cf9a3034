"""What the views of the quality classifier give each other."""

import numpy as np
import pytest

from imprintmatch.llm import quality as Q
from imprintmatch.llm.models import sigmoid

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def two_views(rng, n, signal=(1.2, 1.2), width=12):
    """Labels and two views that are independent given the label; each has noise columns besides its own."""
    y = (rng.random(n) < 0.7).astype(float)
    views = [np.column_stack([np.ones(n), rng.normal(size=(n, width)) + np.r_[s, np.zeros(width - 1)] * (2 * y[:, None] - 1)]) for s in signal]
    return y, *views


def accuracy(model, a, b, y):
    return ((model.score(a, b)[2] >= 0.5) == y).mean()


def test_both_views_pass_rows_on_and_the_exchange_helps():
    gains, alone = [], []
    for seed in range(12):
        rng = np.random.default_rng(seed)
        y, a, b = two_views(rng, 3000)
        known = np.full(3000, -1.0)
        known[:40] = y[:40]
        fold = Q.stratified(known, np.arange(3000))
        test_y, test_a, test_b = two_views(rng, 4000)
        before = accuracy(Q.co_train(a, b, known, fold, rounds=0), test_a, test_b, test_y)
        model = Q.co_train(a, b, known, fold, rounds=5, most=200)
        assert {k for _, k, n, _ in model.passed if n} == {0, 1}
        gains.append(accuracy(model, test_a, test_b, test_y) - before)
        alone.append(before)
    assert np.mean(gains) > 0.01 and np.mean(alone) > 0.7, (gains, alone)


def test_a_view_without_signal_does_no_harm():
    losses = []
    for seed in range(8):
        rng = np.random.default_rng(100 + seed)
        y, a, b = two_views(rng, 3000, signal=(1.2, 0.0))
        known = np.full(3000, -1.0)
        known[:400] = y[:400]
        fold = Q.stratified(known, np.arange(3000))
        test_y, test_a, test_b = two_views(rng, 4000, signal=(1.2, 0.0))
        losses.append(accuracy(Q.co_train(a, b, known, fold, rounds=0), test_a, test_b, test_y) - accuracy(Q.co_train(a, b, known, fold, rounds=3), test_a, test_b, test_y))
    assert np.mean(losses) < 0.01, losses


@pytest.fixture(scope="module")
def feats(spark):
    rows = [(i, f"word{i} " * (1 + i % 50) + "!" * (i % 7), "en", f"s{i % 5}", i) for i in range(900)]
    rows += [(7, "again", "en", "s", k) for k in range(200)] + [(None, "no id", "en", "s", 1)] * 50
    return Q.features(spark.createDataFrame(rows, DOC)).filter("doc_id is not null")


def test_the_corpus_gives_what_a_pool_in_arrays_gives(feats):
    rows = feats.groupBy("doc_id").agg({"a": "min"}).withColumnRenamed("min(a)", "a").join(feats, ["doc_id", "a"]).dropDuplicates(["doc_id"])
    got = rows.toArrow()
    a, b = Q._unpacked(got["a"], got["b"])
    rng = np.random.default_rng(0)
    model = Q.CoModel(rng.normal(size=a.shape[1]), rng.normal(size=b.shape[1]), np.zeros(3), a.mean(axis=0), a.std(axis=0) + 1)
    corpus, held = Q.Corpus(rows), Q.Held(a, b)
    for turn in range(3):
        got, want = corpus.take(model, 20, 50), held.take(model, 20, 50)
        assert all(high.sum() == 50 and len(x) == 70 for x, _, high in got)
        if turn == 0:  # later rows depend on how ties were broken
            assert np.allclose(*(np.sort(model.odds(x[0][0], x[0][1])[0]) for x in (got, want)))
    assert len(np.unique(corpus.given)) == len(corpus.given) == 3 * 2 * 70


def test_a_small_pool_is_taken_whole(feats):
    rows = feats.filter("doc_id < 30")
    corpus = Q.Corpus(rows)
    a, b = Q._unpacked(*(rows.toArrow()[c] for c in "ab"))
    model = Q.CoModel(np.ones(a.shape[1]), np.ones(b.shape[1]), np.zeros(3), a.mean(axis=0), a.std(axis=0) + 1)
    first = corpus.take(model, 10, 40)
    assert sum(len(x[0]) for x in first) == 30
    assert [len(x[0]) for x in corpus.take(model, 10, 40)] == [0, 0]


def test_calibrated_scores_are_probabilities():
    rng = np.random.default_rng(5)
    y, a, b = two_views(rng, 5000)
    known = np.where(np.arange(5000) < 2000, y, -1.0)
    model = Q.co_train(a, b, known, Q.stratified(known, np.arange(5000)))
    ty, ta, tb = two_views(rng, 20000)
    p = model.score(ta, tb)[2]
    for low in np.arange(0.1, 0.9, 0.2):
        some = (p >= low) & (p < low + 0.2)
        assert some.sum() < 100 or abs(ty[some].mean() - p[some].mean()) < 0.08
    assert sigmoid(np.zeros(1))[0] == 0.5
