"""Query 8: pieces of all documents."""

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm.pieces import tokenize
from riskloom.llm.registry import query, table


@query()
def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(table(spark, sf_dir, "documents"))
