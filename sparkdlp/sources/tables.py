"""Parquet tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Some or all columns of a table; how many tasks read it is up to its files.

    Text scans are bound by CPU, so write text tables with row groups well below
    ``spark.sql.files.maxPartitionBytes``: a row group is never split.
    """
    table = spark.read.parquet(path)
    return table.select(*columns) if columns else table


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table below the shared checkpoint folder, so that every run of the plan sees the same ones."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix=f"{name}-")
        context.setCheckpointDir(folder)
    path = f"{context.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
