import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, ids=None, source="s", schema=DOC):
        ids = range(len(texts)) if ids is None else ids
        return spark.createDataFrame([(i, t, "en", source, len(t or "")) for i, t in zip(ids, texts)], schema)

    return make
