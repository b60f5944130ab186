"""Audit log as JSON lines, partitioned by day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdlp.operators.audit import SCHEMA


def with_day(audit: DataFrame) -> DataFrame:
    return audit.withColumn("day", F.to_date(F.timestamp_seconds("timestamp")))


def write_audit(audit: DataFrame, path: str) -> None:
    with_day(audit).write.mode("append").partitionBy("day").json(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """All audit logs under ``path``; filters on ``day`` prune folders."""
    return spark.read.schema(SCHEMA + ", day date").json(path)
