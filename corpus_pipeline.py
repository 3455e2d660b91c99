"""The corpus pipeline: quality, near-duplicates, benchmark leaks, mixing, token records.

Each stage works on all that its predecessor kept and is written as Parquet in the shared folder before
the next begins.  All stages but the last return the columns of `documents`; the last returns a row per
record read back from the files that it wrote.

Defined results: a null text counts as empty, so it is judged by the metadata alone, is no near copy, holds
no benchmark item, and, having no words, is never taken by the mix.  Documents with a null id are judged like
others; nothing can name them, so near-duplicate removal and decontamination keep them.  Of equal rows one
stays; rows that share an id but not a text are judged one by one, except that decontamination drops all rows
of an id.  Ties in the mix fall by a hash of the id.  Empty tables give empty results: no labels keep all
documents, no benchmark items drop none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plyspark.llm.common import table, written
from plyspark.llm.decontaminate import clean_documents
from plyspark.llm.jaccard import one_of_each
from plyspark.llm.mixing import taken_documents
from plyspark.llm.quality import fit, good_documents
from plyspark.llm.queries import tokenizer
from plyspark.llm.token_records import token_records


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier, fitted on the labels of these documents, rejects."""
    return good_documents(docs, fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents as the sources' targets ask."""
    return taken_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token records and reads them back."""
    return token_records(docs, tokenizer("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]

#: The classifier is trained, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
