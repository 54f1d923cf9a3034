"""Shuffle files of finished rounds do not stand on disk until the end of the job."""

import os
import re
import time

import numpy as np

import imprintmatch.llm.components as C
import imprintmatch.llm.ngram_join as N
from imprintmatch.storage import release


def shuffle_bytes(spark):
    """Bytes on disk of each shuffle that has files there."""
    tops = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    out = {}
    for folder, name in ((folder, name) for top in tops for folder, _, files in os.walk(top.getPath()) for name in files):
        if m := re.match(r"shuffle_(\d+)_", name):
            try:
                out[int(m[1])] = out.get(int(m[1]), 0) + os.path.getsize(f"{folder}/{name}")
            except FileNotFoundError:  # removed meanwhile
                pass
    return out


def standing(spark):
    """Shuffles that have files on disk."""
    return set(shuffle_bytes(spark))


def test_release_removes_shuffles_of_what_is_gone(spark):
    before = standing(spark)
    for i in range(10):
        spark.range(100).repartition(3, "id").groupBy("id").count().selectExpr(f"id + {i}").collect()
    end = time.time() + 20
    while len(left := standing(spark) - before) > 2 and time.time() < end:  # removal goes on beside the job; the last may stay
        release(spark)
        time.sleep(0.5)
    assert len(left) <= 2


def test_components_release_each_round(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(C, "release", lambda session: calls.append(release(session)))
    edges = spark.createDataFrame([(i, (i * 7 + 7) % 30) for i in range(30)], "a long, b long")
    labels = C.components(edges)
    assert len(calls) >= 2 and labels.count() == 30


def feats_of(docs):
    schema = "doc_id long, row long, n long, node long, tile long, point binary, rare array<long>, often array<long>"
    rows = docs.selectExpr("doc_id", "text", "monotonically_increasing_id() as row")
    return rows.mapInArrow(N._prefixes(5, np.zeros(0, np.uint64)), schema).cache()


def test_shingles_of_all_texts_do_not_stand_in_shuffles_at_once(spark, make_docs):
    """Nearly every rare shingle is of one text alone, and 16 bytes with its class: they are dealt out in passes."""
    feats = feats_of(make_docs([" ".join(f"w{i}x{j}" for j in range(400)) for i in range(600)]))
    listed = feats.selectExpr("sum(size(rare))").first()[0]
    before = set(standing(spark))
    assert N._clusters(feats).count() == 0
    most = max(size for number, size in shuffle_bytes(spark).items() if number not in before)
    assert most < 16 * listed / 2
    feats.unpersist()


def test_a_block_holds_sizes_that_allow_links_only(spark, make_docs):
    words = [f"a{i}" for i in range(2000)]
    texts = [" ".join(words[:n]) for n in (30, 35, 1000, 1100, 2000)]
    feats = feats_of(make_docs([*texts, texts[-1]]))  # the last twice: one class, so no block
    nodes = {r.doc_id: r.node for r in feats.collect()}
    clusters = {}
    for r in N._clusters(feats).collect():
        clusters.setdefault(r.p, set()).add(r.node)
    feats.unpersist()
    assert any({nodes[0], nodes[1]} <= c for c in clusters.values()) and any({nodes[2], nodes[3]} <= c for c in clusters.values())
    assert not any({nodes[0], nodes[2]} <= c or nodes[4] in c for c in clusters.values())


def test_similar_sizes_are_few_steps_apart():
    sizes = np.r_[np.arange(1, 200_000), N.LEAST_SIZES[1:], N.LEAST_SIZES[1:] - 1]
    step = lambda n: np.searchsorted(N.LEAST_SIZES, n, side="right") - 1
    assert (np.diff(N.LEAST_SIZES) >= 0).all()
    assert (step(N.DEN * sizes // N.NUM) - step(sizes) <= N.STEPS).all()
    assert (N.listed(np.array([2**64 - 1, 0], np.uint64), 10**12) >> N.STEP_BITS).tolist() == [2**N.KEY_BITS - 1, 0]
