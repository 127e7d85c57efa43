"""Query 4: licence notices in all documents."""

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm.licenses import learn, scan
from riskloom.llm.registry import query, table


@query()
def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, learn(docs))
