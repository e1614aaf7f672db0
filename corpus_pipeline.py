"""The corpus pipeline: five operators, each on what the one before it kept.

Toxic documents go; of documents whose five-word shingles overlap by 0.8 or more one stays; documents that leak a
benchmark item go; personal data is replaced; what is left is packed into sequences. Stages before the last return the
columns of documents, whatever those are, and may be named as the operators name theirs.

A null or empty text is kept by every stage and packed as the end token alone; null ids are kept; a very long text is
scored, compared, searched and packed whole; of rows that repeat an id and a text one stays, of other copies the least
doc_id; an empty table gives an empty result. SQL cannot express the first stage (a trained network), so there is no
ORACLE_SQL; a test holds the rows of run() against plain Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessel.llm.common import drop_staged, staged
from tessel.llm.decontamination import without_leaks
from tessel.llm.ngram_join import one_of_each
from tessel.llm.packing import pack
from tessel.llm.pii import redact
from tessel.llm.toxicity import not_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return not_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, 5, 80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("pii", personal_data),
    ("packing", packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, staged(stage(spark, docs, sf_dir), name)
        drop_staged(before)
    return STAGES[-1][1](spark, docs, sf_dir)
