"""The training-data pipeline: documents in, packed bins out.

Each stage takes (spark, docs, sf_dir) and works on all rows of its ``docs``. All but the last return the columns of
the documents table; ``run`` writes each result as Parquet in the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.decontaminate import remove_contaminated
from docloom.llm.minhash import deduplicate
from docloom.llm.packing import pack
from docloom.llm.rules import filter_documents
from docloom.llm.store import Workspace, clean, mark, sweep
from docloom.llm.suffix_family import WORDS, remove_repeats

#: Similarity of near duplicates in percent, on shingles of five words.
PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy over the rule ledger keeps."""
    return filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates."""
    return deduplicate(docs, percent=PERCENT)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that stand elsewhere too."""
    return remove_repeats(docs, unit=WORDS).withColumn("n_chars", F.length("text").cast("long"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document."""
    return pack(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: Suffix arrays, components and best fit have no plain SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        since = mark()
        docs = work.save(stage(spark, docs, sf_dir), name)
        clean(spark, since)  # the stage's own tables
        sweep(spark)
        if i:
            work.drop(STAGES[i - 1][0])
    return docs
