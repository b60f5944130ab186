"""Streaming counters and the streaming audit sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from sparkdlp.operators.decision import metrics
from sparkdlp.sources.audit_log import with_day


def counter_stream(decided: DataFrame, name: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Cumulative counters of a stream of decided requests, as an in-memory table."""
    writer = metrics(decided).writeStream.outputMode("complete").format("memory")
    return writer.queryName(name).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def audit_stream(audit: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Audit rows as JSON lines; the file sink's log makes each row land once."""
    writer = with_day(audit).writeStream.format("json").partitionBy("day").outputMode("append")
    return writer.option("path", path).option("checkpointLocation", checkpoint).trigger(
        **trigger
    ).start()
