"""A corpus pipeline of five operators: documents in, token files out.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. run() writes every stage's result to
the shared folder as Parquet and reads it again as the next one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagloom.llm import decontaminate, mixing, ngram_join, quality, token_files
from tagloom.llm.common import materialize, prepare, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier rates good."""
    return quality.select_quality(docs, table(spark, sf_dir, "labels"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by doc_id, of every group linked at Jaccard 0.8 on word 5-shingles."""
    return ngram_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in benchmark windows."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture by target weights, from one epoch of every document at most."""
    return mixing.select_mixture(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the shared folder; one row a document, read back from them."""
    return token_files.token_output(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_copies", keep_one_of_near_copies),
    ("decontaminate", drop_contaminated),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]

#: The classifier is not SQL; tests/llm/test_pipeline.py checks the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
