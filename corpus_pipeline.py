"""The corpus pipeline: stages of the corpus operators, each on what the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
stage's rows to the shared folder and gives them to the next; what a stage wrote on its way, and the rows of the stage before, go
then, so that only the result's files are left.  All stages but the last return the columns of documents.

Defined results are those of the operators' modules: null texts are empty; a null doc_id is
a document of its own in the near-duplicate stage; an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glosswork.llm._common import drop_saved, save, scratch
from glosswork.llm.bpe_chunks import encode_documents
from glosswork.llm.exact_dedup import deduplicate
from glosswork.llm.minhash import keep_one_each
from glosswork.llm.mixing import keep_sampled
from glosswork.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the longest original stays."""
    return deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return keep_one_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn by their calibrated probabilities."""
    return keep_sampled(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, as digests."""
    return encode_documents(docs)


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch(spark):
            kept = save(stage(spark, docs, sf_dir), f"stage-{name}", stay=True)
        drop_saved(docs)
        docs = kept
    return docs


#: SQL can't express the fitted classifier, the signatures and the vocabulary's merges.
ORACLE_SQL = None
