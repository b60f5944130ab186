"""Streaming token-bucket limits in event time: arrivals wait until their order is certain.

A key's arrivals are kept until the watermark has passed them, then folded in the order of their times, whatever
order they came in, so the rows are those of the batch operator. What is kept of a key is its bucket and the
arrivals of the last ``delay``; one event-time timer says when the next of them is due. A bucket that is full again
says no more than none at all, so a timer removes it, and keys that have gone silent take no state.

Defined cases: arrivals of equal times are taken in the order of their ids. An arrival that is not newer than the
watermark when it comes is dropped by Spark and has no row; the query's progress counts such rows. Arrivals without
a key share one bucket. Needs the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sparkdlp.operators.rate_limit import Bucket

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_MS = 1000


class EventTimeBucket(StatefulProcessor):
    """One key: ``waiting`` arrivals (time, id), and the ``bucket``'s tokens, clock and the time that is due."""

    def __init__(self, bucket: Bucket, tie_type: str) -> None:
        self.limits, self.tie_type = bucket, tie_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"us bigint, tie {self.tie_type}")
        self.bucket = handle.getValueState("bucket", "units bigint, last bigint")
        self.due = handle.getValueState("due", "at bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            times = batch["us"].tolist()
            self.waiting.appendList(list(zip(times, batch["tie"].tolist())))
            first = min(times) if first is None else min(first, *times)
        if first is not None:
            self._wake(first // _MS + 1)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.due.exists() and self.due.get()[0] <= expiredTimerInfo.getExpiryTimeInMs():
            self.due.clear()
        passed = timerValues.getCurrentWatermarkInMs() * _MS
        held = sorted(tuple(row) for row in self.waiting.get()) if self.waiting.exists() else []
        ready = [row for row in held if row[0] <= passed]
        later = held[len(ready) :]
        state = tuple(self.bucket.get()) if self.bucket.exists() else None
        if ready:
            times = [us for us, _ in ready]
            units, last = state or (self.limits.full, times[0])
            allowed, waits, *state = self.limits.fold(times, units, last)
            self.bucket.update(tuple(state))
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
            yield pd.DataFrame(
                {"tie": [tie for _, tie in ready], "bucket_key": key[0], "allowed": allowed, "wait_us": [float(w) for w in waits]}
            )
        if later:
            self._wake(later[0][0] // _MS + 1)
        elif state:
            full_at = state[1] - (state[0] - self.limits.full) // self.limits.refill
            if full_at <= passed:
                self.bucket.clear()
            else:
                self._wake(full_at // _MS + 1)

    def _wake(self, at: int) -> None:
        """One timer per key, at the earliest time that anything is due."""
        if self.due.exists():
            known = self.due.get()[0]
            if known <= at:
                return
            self.handle.deleteTimer(known)
        self.handle.registerTimer(at)
        self.due.update((at,))

    def close(self) -> None:
        pass


def event_time_bucket_stream(
    arrivals: DataFrame,
    bucket: Bucket,
    key: str = "client_key",
    ts: str = "ts",
    row_id: str = "request_id",
    delay: str = "1 minute",
) -> DataFrame:
    """(row_id, key, allowed, wait_seconds, retry_after) as the batch operator gives, for any order within ``delay``."""
    provider = arrivals.sparkSession.conf.get(PROVIDER)
    if not provider.endswith("RocksDBStateStoreProvider"):
        raise ValueError(f"set {PROVIDER} to {ROCKSDB}")
    named = F.when(F.col(key).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(key).cast("string")))
    # Names that begin with an underscore do not reach the processor.
    narrow = arrivals.select(
        F.col(row_id).alias("tie"), named.alias("bucket_key"), F.col(ts).cast("timestamp").alias("arrived"),
        F.unix_micros(F.col(ts).cast("timestamp")).alias("us"),
    ).withWatermark("arrived", delay)
    tie = narrow.schema["tie"].dataType.simpleString()
    decided = narrow.groupBy("bucket_key").transformWithStateInPandas(
        EventTimeBucket(bucket, tie), f"tie {tie}, bucket_key string, allowed boolean, wait_us double", "append", "eventTime"
    )
    retry = F.floor(F.col("wait_us") / 1_000_000) + 1
    own = F.when(F.col("bucket_key") != "", F.substring("bucket_key", 2, 1 << 30)).cast(arrivals.schema[key].dataType)
    return decided.select(
        F.col("tie").alias(row_id),
        own.alias(key),
        "allowed",
        (F.col("wait_us") / 1_000_000).alias("wait_seconds"),
        F.when(F.col("allowed"), F.lit(0)).otherwise(retry).cast("int").alias("retry_after"),
    )
