"""Query 7: pseudonyms for personal data in all documents."""

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm.pseudonyms import pseudonymise
from riskloom.llm.registry import query, table

#: The key of this registered query; a real run passes its own secret.
KEY = b"documents of the test tables"


@query()
def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents"), KEY)
