"""Query 13: verdicts over the URLs of all pages."""

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm.registry import query, table
from riskloom.llm.url_filter import judge, labelled_urls, learn


@query()
def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), learn(labelled_urls(spark)))
