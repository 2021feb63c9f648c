"""The corpus pipeline: toxicity, language, near-duplicates, packing.

Every stage takes (spark, docs, sf_dir), works on all rows it is given and returns a DataFrame, which is
written as Parquet and reread as the next stage's documents. All but the last return the documents' columns.
Null texts and extra columns pass through. Rows of one doc_id with different texts are judged each by its own;
of equal rows one stays. A null doc_id's row is judged by the filters and packed, and is no copy of another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rollcall.llm import langid, minhash, packing, toxicity
from rollcall.llm.common import materialise
from rollcall.llm.tokens import vocabulary_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from all labels of these documents, does not call toxic."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_strange_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from these documents: not ``und``, not far from every model."""
    return langid.without_rejected(docs, langid.fit(docs))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of texts that share 80 % of their five-word shingles: its smallest doc_id."""
    return minhash.without_copies(docs, width=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of the documents' tokens in windows of 4096."""
    return packing.pack(docs, vocabulary_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_strange_languages),
    ("near_duplicates", keep_one_of_near_copies),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each but the last written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL cannot express the classifiers, the language models or the packing.
ORACLE_SQL = None
