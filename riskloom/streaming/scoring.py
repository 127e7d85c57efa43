"""Labels and scores on a stream. Every step is stateless, so the batch expressions are used."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def score_stream(spark: SparkSession, source: str, kind: T.StructType,
                 step: Callable[[DataFrame], DataFrame], sink: str, progress: str):
    """Runs ``step`` over the files of a folder, new ones only, and appends to a table.

    ``progress`` holds the stream's own checkpoint and has to lie on shared storage.
    """
    arriving = spark.readStream.schema(kind).parquet(source)
    return (step(arriving).writeStream.format("parquet").outputMode("append")
            .option("path", sink).option("checkpointLocation", progress)
            .trigger(availableNow=True).start())
