"""The training-data pipeline: language, near duplicates, benchmark passages, source mixture, shards.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet to the shared folder and read again as the
next stage's documents. All stages but the last return the columns of ``documents``, and each works on all that the stage
before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut_lineage
from tidemark.llm.decontam import without_contaminated
from tidemark.llm.langid import in_known_language, train_language_model
from tidemark.llm.minhash import without_near_duplicates
from tidemark.llm.mixing import mixed_documents
from tidemark.llm.sharding import shard_documents

#: A text stays if its best language's mean probability over all its bytes is this much of the way from chance to certainty.
LANGUAGE_MARGIN = 1 / 15


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts of a known language: without letters, or with no language ahead of the others, they go."""
    learnt = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    model = train_language_model(learnt.select("doc_id", "text", "lang"))
    return in_known_language(docs, model, LANGUAGE_MARGIN)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group that shares 80 % of five-word shingles."""
    return without_near_duplicates(docs, size=5, percent=80)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth lie in 13-word windows of benchmark items."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=13)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as a mix of 150 % of the words takes them."""
    return mixed_documents(docs, weights=(3, 1, 2), share=1.5, max_copies=2)


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, equal texts together."""
    return shard_documents(docs, 8)


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("benchmark", benchmark_stage),
    ("mixture", mixture_stage),
    ("shards", shard_stage),
]

#: The network of the first stage and the signatures of the second have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
