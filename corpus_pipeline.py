"""The corpus pipeline: documents through five stages to token files.

Every stage takes (spark, docs, sf_dir) and works on all rows of docs, whatever further columns they have; all
but the last return the columns of docs.  For every stage: an empty table gives an empty result; repeated rows are
rows; null texts are empty ones; texts are taken whole at any length.  What a stage adds to that stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from imprintmatch.llm.common import new_folder
from imprintmatch.llm.decontam import clean_documents
from imprintmatch.llm.mixing import mixed_documents
from imprintmatch.llm.ngram_join import one_of_each
from imprintmatch.llm.quality import accepted_documents
from imprintmatch.llm.tokens import token_files


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Repeated rows and ties are decided alike; rows without a doc_id, language, source or length are scored like
    any.  Without labels of both kinds nothing is rejected.
    """
    return accepted_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the least doc_id, of equal ones the first row.

    Documents without a word all stay; one without a doc_id stays only where its group has no other.
    """
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Items without an id or a word are none; a table without items drops nothing.
    """
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, three times at most.

    A null source is a source of its own; rows of one doc_id draw alike; a null doc_id draws as the empty string.
    """
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix; returns doc_id, start, n_tokens, ids_crc32 of each document in them.

    Rows without a doc_id come first; of equal ids the order is that of their texts.
    """
    return token_files(docs, new_folder(spark, "tokens"), null_ids=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("tokens", tokens)]

#: SQL cannot express the classifier, the join's index or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through all stages, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{number}-{name}")
            docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return docs
