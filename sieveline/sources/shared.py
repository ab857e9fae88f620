"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the folder that spark.checkpoint.dir names. Where the setting is missing, a local master gets a folder
    under /tmp/checkpoints; on a cluster that is an error, as no machine's own folder is seen by the others."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file:///tmp/checkpoints"
    return f"{folder.rstrip('/')}/sieveline-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet to a path of its own and read again, so that what reads it several times computes it once and lost
    executors cost a reread."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame) -> DataFrame:
    """df computed now and broadcast where it is joined: for tables of a row per configuration, whatever the number of
    records. Plans that read it don't repeat what it was made from."""
    return F.broadcast(df.sparkSession.createDataFrame(df.collect(), df.schema))
