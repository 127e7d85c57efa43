"""Query 1: language-model scores of all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.context_mixing import is_held_out
from riskloom.llm.lm_scoring import score, train
from riskloom.llm.registry import query, table


@query()
def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learnt = ~is_held_out(F.col("doc_id"))
    scorer = train(docs.where(learnt))
    return score(docs, scorer, learnt=learnt).select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known",
        F.lit(scorer.tokens).cast("long").alias("train_tokens"), "base_score", "score", "bits", "bits_per_byte")
