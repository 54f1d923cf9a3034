"""Token files: words are encoded as in their whole texts, and rows without an id are kept."""

import numpy as np
import pyarrow as pa
import pytest

from imprintmatch.llm import tokens as K
from imprintmatch.llm.common import new_folder

SIMPLE = ["", "a", "it's we'll 's 'twas don't\n'm x", "straße naïve 中文 字 b's\nline2 c\nd", "x1 22,33 (a) --b__c! 3.14\ne", "a" * 5000 + " b", "Ünï ĉodé 日本 語 한국어"]
OTHER = [" a", "a\n", "a  b", "a\tb", "a\n\nb c", "a b", "a b c", "\x00a b", "a<|endoftext|>b c", "ⵣ ࿇ \U0001f600 c", "́a b"]


@pytest.fixture(scope="module")
def encoder():
    return K.Encoder(K.default_tokenizer())


def split(ids, counts):
    ends = np.cumsum(counts)
    return [ids[e - n : e].tolist() for n, e in zip(counts, ends)]


@pytest.mark.parametrize("texts", [SIMPLE, OTHER, SIMPLE + OTHER + SIMPLE, ["", ""]])
def test_encoder_equals_whole_texts(encoder, texts):
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert split(*encoder.encode(pa.array(texts, pa.string()))) == want


def test_memory_is_given_up_in_halves(monkeypatch):
    monkeypatch.setattr(K, "REMEMBERED", 5000)
    enc = K.Encoder(K.default_tokenizer())
    texts = [" ".join(f"w{i}x{j}" for j in range(9))[:-1] + "\ncommon" for i in range(60)]
    for _ in range(2):
        for t in texts:
            assert split(*enc.encode(pa.array([t])))[0] == enc.tokenizer.encode(t, add_special_tokens=False).ids
    assert len(enc.known) + len(enc.older) < 2 * 5000 / K.PER_WORD
    assert " common" not in enc.known and ("common" in enc.known or "common" in enc.older)


def test_rows_without_an_id_come_first(spark, tmp_path):
    docs = spark.createDataFrame([(5, "b"), (None, "a"), (None, None), (-7, "c d"), (5, "b")], "doc_id long, text string")
    docs = docs.selectExpr("*", "1 as start", "2 as part", "'x' as name")
    rows = sorted(K.token_files(docs, f"file://{tmp_path}/n", null_ids=True).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, r.n_tokens) for r in rows] == [(None, 0, 1), (None, 1, 2), (-7, 3, 3), (5, 6, 2), (5, 8, 2)]


def test_parts_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "TOKENS_PER_PART", 40)
    monkeypatch.setattr(K, "SLICE_BYTES", 50)
    docs = spark.createDataFrame([(i, "one two three four " * 3 + "x") for i in range(40)], "doc_id long, text string").coalesce(1)
    parts = K.write_tokens(docs, f"file://{tmp_path}/p")
    rows = parts.orderBy("base").collect()
    assert sum(r.n_docs for r in rows) == 40
    assert [r.base for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()


def test_columns_named_as_the_results(make_docs):
    docs = make_docs(["one two", "", None, "three"], [4, 2, 9, 1])
    clash = docs.selectExpr("*", "1 as start", "2 as n_tokens", "'x' as ids_crc32", "3 as ids", "4 as part", "5 as base")
    rows = [tuple(r) for r in K.token_files(clash, new_folder(docs.sparkSession, "tokens")).orderBy("doc_id").collect()]
    assert rows == [tuple(r) for r in K.token_files(docs, new_folder(docs.sparkSession, "tokens")).orderBy("doc_id").collect()]
    assert [r[0] for r in rows] == [1, 2, 4, 9] and [r[2] for r in rows if r[0] in (2, 9)] == [1, 1]
