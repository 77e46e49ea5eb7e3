"""From raw documents to shuffled training shards: five stages, each one operator over all that is left.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again for the next. All but the last return the columns of documents.

The results depend on trained models, hashes and random draws, so SQL cannot express them
(``ORACLE_SQL`` is None). tests/llm holds near duplicates and decontamination against brute force, the
mix given against the mix decided, and the shards' sizes and slots; of the language stage it only checks
that rows come out as they went in.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from shelfwatch.llm import langid, mixing, ngram_join, sharding, winnowing
from shelfwatch.plans.shared import shared_dir


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without letters or far from every language go."""
    return langid.with_known_language(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: similarity 0.8 or more over five-word shingles."""
    return ngram_join.one_per_group(docs, width=5, percent=80)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten consecutive words of a benchmark item."""
    return winnowing.without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def shuffle_into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All of them in a uniform order, with shard and slot."""
    return sharding.shard(docs, 8)


STAGES = [
    ("language_id", identify_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", remove_contaminated),
    ("mixing", mix_sources),
    ("sharding", shuffle_into_shards),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
