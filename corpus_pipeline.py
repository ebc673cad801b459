"""A training corpus in five stages: quality, near duplicates, decontamination, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as
Parquet in the shared folder and reads it back as the next stage's documents. All stages
but the last return the columns of ``documents``. Nulls in any column, empty and very
long texts, repeated rows and empty tables pass through as the operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pitspark.llm import decontaminate, mixing, ngram_join, quality, token_files
from pitspark.llm.queries import END_ID, MIX_WEIGHTS, tokenizer_path
from pitspark.session import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (score of at least 0.5)."""
    model = quality.fit_quality(docs, _table(spark, sf_dir, "labels"))
    return quality.keep_quality(docs, model)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the least doc_id."""
    return ngram_join.distinct_documents(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time it takes a document, the last one cut at the exact word."""
    return mixing.mixed_documents(docs, MIX_WEIGHTS, share=1.5, max_epochs=2.0)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of the mix; per row of it what the shards hold."""
    return token_files.token_round_trip(docs, tokenizer_path(), END_ID)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_distinct),
    ("benchmark decontamination", keep_uncontaminated),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", write_tokens),
]

# trained trees, MinHash and a tokenizer have no SQL; tests/llm holds the run against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-").replace("/", ""))
    return STAGES[-1][1](spark, docs, sf_dir)
