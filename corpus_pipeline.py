"""From raw documents to the pieces of a training mix.

Each stage takes what the stage before it kept, and returns the columns of ``documents``; the last
one returns (doc_id, pieces, n_pieces, lossless). Between stages the rows are written as Parquet and
read again, so a lost executor never costs more than a stage.

Rows without an id stay until the end; null texts count as empty. A document that the mix takes
several times is there several times.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import ngram_join, pieces, quality, secrets
from riskloom.llm.mixing import mixed, word_count
from riskloom.llm.q_mixing import with_weight
from riskloom.llm.scratch import saved


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.learn(docs, labels))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.keep_one(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, a mark in place of every secret."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for."""
    columns = docs.columns
    rows, weight = with_weight(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixed(rows, word_count(F.col("text")), weight).select(*columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every document."""
    return pieces.tokenize(docs)


STAGES = [("quality", good), ("near_duplicates", distinct), ("secrets", without_secrets), ("mixing", mix),
          ("pieces", encode)]

#: The classifier and the pieces are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
