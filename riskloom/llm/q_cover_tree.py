"""Query 10: links and components of all embeddings by cosine."""

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm.cover_tree import similar_vectors
from riskloom.llm.registry import query, table


@query()
def op10_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(table(spark, sf_dir, "embeddings"))
