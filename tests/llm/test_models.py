"""Classifiers on labelled texts they have not seen, and the pipeline."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from imprintmatch.llm import quality as Q
from imprintmatch.llm import toxicity as X

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(13)
    vocab = ["".join(rnd.choice("aeiou") + rnd.choice("lmnrst") for _ in range(rnd.randint(1, 4))) for _ in range(600)]
    rude = ["grobkurz", "schandel", "fluchter", "moronita"]
    rows, labels = [], []
    for i in range(1500):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(5, 120))]
        toxic, junk = rnd.random() < 0.2, rnd.random() < 0.15
        if toxic:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(rude))
        text = " ".join(w + "!!" for w in words).upper() if junk else " ".join(words) + "."
        rows.append((i, text, rnd.choice(["en", "de", None]), f"src{i % 7}", len(text)))
        labels.append((i, 0 if junk else 1, int(toxic)))
    rows += [(2000, None, None, None, None), (2001, "", "en", "s", 0), (2002, "word " * 60000, "en", "s", 300000)]
    docs = spark.createDataFrame(rows, DOC).cache()
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache(), rude


def test_toxicity_held_out(spark, corpus):
    docs, labels, _ = corpus
    rows = X.score_toxicity(docs, labels).join(labels, "doc_id", "left").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.toxic is not None]
    assert sum(r.predicted == r.toxic for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_labels_of_held_out_rows_are_not_used(spark, corpus):
    docs, labels, _ = corpus
    swapped = labels.withColumn("toxic", F.when(X.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = {r.doc_id: r.score for r in X.score_toxicity(docs, labels).collect()}
    b = {r.doc_id: r.score for r in X.score_toxicity(docs, swapped).collect()}
    assert a == b


def test_disguised_words_are_restored(spark, corpus):
    docs, labels, rude = corpus
    decoder = X.Decoder(X.character_model(docs))
    assert decoder.restore("a gr0bkurz b") == ["grobkurz"]
    assert decoder.restore("s.c.h.a.n.d.e.l and m 0 r o n") == ["schandel", "moron"]
    assert decoder.restore("fluuuuchter") in (["fluchter"], ["fluuchter"])
    assert decoder.restore("plain text, with 12 numbers and!! marks") == []
    marks = X.fit(docs, labels, decoder)
    import pyarrow as pa

    scores = marks.score(marks.evidence(pa.array(["alone gr0bkurz m0r0n1ta here", "alone only here", "", None]), decoder))
    assert scores[0] > 0.5 > scores[1] and scores[2] < 0.5 and scores[3] == scores[2]


def test_toxicity_without_labels(spark, corpus):
    docs, labels, _ = corpus
    rows = X.score_toxicity(docs.limit(20), labels.limit(0)).collect()
    assert len(rows) == 20 and not any(r.predicted for r in rows)
    assert X.score_toxicity(docs.limit(0), labels).collect() == []


def test_quality(spark, corpus):
    docs, labels, _ = corpus
    rows = Q.score_quality(docs, labels, labelled=700, unlabelled=300).join(labels, "doc_id", "left").collect()
    assert len(rows) == docs.count()
    seen = [r for r in rows if r.quality is not None]
    assert sum(r.accepted == bool(r.quality) for r in seen) / len(seen) > 0.97
    kept = Q.accepted_documents(docs, labels, labelled=700, unlabelled=300)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.accepted}


def test_quality_without_labels(spark, corpus):
    docs, labels, _ = corpus
    assert Q.accepted_documents(docs, labels.filter("quality = 1")).count() == docs.count()
    assert Q.score_quality(docs.limit(0), labels).collect() == []


def test_pipeline(spark, corpus, tmp_path):
    import corpus_pipeline

    docs, labels, _ = corpus
    item = "which river runs under the very old stone bridge of lanroma\nthe river that runs there is the slow green tessin"
    near = " ".join(f"n{i}" for i in range(200))
    extra = [(3000, "intro words " + item + " closing words", "en", "src1", 1), (3001, near, "en", "src2", 1), (3002, near + " tail", "en", "src2", 1), (3001, near, "en", "src2", 1)]
    docs.union(spark.createDataFrame(extra, DOC)).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontaminate", "mix", "tokens"]
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        table = stage(spark, table, str(tmp_path))
        if name != "tokens":
            assert table.columns == [c.split()[0] for c in DOC.split(", ")]
            table.write.parquet(f"{tmp_path}/{number}")
            table = spark.read.parquet(f"{tmp_path}/{number}")
        seen[name] = sorted(r.doc_id for r in table.select("doc_id").collect() if r.doc_id is not None)
    assert 3000 in seen["near_duplicates"] and 3000 not in seen["decontaminate"]
    assert [i for i in seen["near_duplicates"] if i in (3001, 3002)] == [3001]
    assert len(seen["tokens"]) == len(seen["mix"])
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in whole) == seen["tokens"]
