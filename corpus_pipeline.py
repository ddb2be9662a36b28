"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame that is written as Parquet and read again as the next
one's ``docs``.  All but the last return the columns of documents, extra ones too.

Null texts count as empty and stay null; near_duplicates links null and empty texts
as copies.  Rows without doc_id stay as they are: nothing links them.  Rows that
repeat a doc_id are one document to near_duplicates and a row each to the
others.  Texts of any length are read whole.  An empty table gives no rows.
"""

from __future__ import annotations

import functools

from auctionflow.llm import common, decontamination, packing, private_data, similar_texts, toxicity
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go."""
    return toxicity.reject(docs, common.table(spark, sf_dir, "labels"))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest doc_id; groups link 5-word shingle sets of Jaccard similarity 0.8 or more."""
    return similar_texts.keep_first(docs, k=5, least=0.8)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontamination.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is masked; n_chars is counted again where there is such a column."""
    out = private_data.mask(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicate),
    ("decontamination", benchmark),
    ("private_data", private),
    ("packing", packed),
]

#: Learned stages can't be expressed in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written to the shared folder and read again."""
    folder = common.own_folder(spark, "corpus-pipeline")

    def step(docs: DataFrame, stage: tuple) -> DataFrame:
        name, work = stage
        work(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    return functools.reduce(step, STAGES, common.table(spark, sf_dir, "documents"))
