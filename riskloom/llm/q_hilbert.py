"""Query 2: the ten nearest embeddings of every hundredth one."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.hilbert import nearest
from riskloom.llm.registry import query, table


@query()
def op2_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
