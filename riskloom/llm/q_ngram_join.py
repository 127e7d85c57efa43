"""Query 9: classes of all documents by similar sets of five-word shingles."""

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm.ngram_join import similar_classes
from riskloom.llm.registry import query, table


@query()
def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
