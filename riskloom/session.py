"""Session settings and the shared scratch folder."""

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "riskloom", master: str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Session with adaptive execution; the cluster's own settings win over these."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Folder for written intermediate tables: the one named by ``spark.checkpoint.dir``.

    A machine-local folder is only taken when Spark itself runs on one machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    local = os.path.join(tempfile.gettempdir(), "riskloom-scratch")
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the scratch folder, never used before."""
    return f"{scratch_root(spark)}/riskloom/{name}-{uuid.uuid4().hex}"


def written(df, name: str):
    """Writes a table that several plans read to the scratch folder, and reads it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_once(df, name: str):
    """``written``, so that a table that is read several times is worked out once; a table with a
    column of no type, which no file can hold, stays as it is."""
    return df if any(kind == "void" for _, kind in df.dtypes) else written(df, name)


def checkpoint(df):
    """Cut lineage through the reliable checkpoint folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_root(df.sparkSession))
    return df.checkpoint()


def store(df, name: str, key: str):
    """Writes a table that is read many times, and reads it back.

    A table of fewer splits than there are cores is spread over them by its unique key; a larger
    one keeps the splits of its files.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("errorifexists").parquet(path)
    rows = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if rows.rdd.getNumPartitions() < cores else rows
