"""Where intermediate tables go: the folder that driver and executors share."""

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder's URI under spark.checkpoint.dir, which all executors share. Where that is unset, a local folder is
    set if driver and executors are one process, and an error is raised on a cluster, whose machines share no local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file:///tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df, written as a table in the shared folder and read again: cuts the lineage, survives a lost executor."""
    spark, to = df.sparkSession, shared_folder(df.sparkSession)
    df.write.parquet(to)
    return spark.read.schema(df.schema).parquet(to)
