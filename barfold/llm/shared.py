"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from barfold.session import checkpoint_root


def new_folder(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/barfold-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: it survives lost executors, and what reads it twice computes it once."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A small table of costly rows, dealt over all cores."""
    spark = df.sparkSession
    cores = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(cores)
