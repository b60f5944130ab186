"""Streaming token-bucket limits, keyed by client.

State per key is two integers; an arrival older than the last one neither adds nor
takes time.  A micro-batch's arrivals of a key are ordered
within the batch, so bound the batch at the source (``maxFilesPerTrigger``,
``maxOffsetsPerTrigger``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkdlp.operators.rate_limit import Bucket, micros


def token_bucket_stream(
    arrivals: DataFrame,
    bucket: Bucket,
    key: str = "client_key",
    ts: str = "ts",
    row_id: str = "request_id",
) -> DataFrame:
    """(row_id, key, allowed, wait_seconds, retry_after), as the batch operator gives."""
    narrow = arrivals.select(
        F.col(row_id).alias("_tie"), F.col(key).alias("_key"),
        micros(arrivals, ts).alias("_us"),
    )

    def step(ids, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(frames)).sort_values(["_us", "_tie"])
        times = batch["_us"].tolist()
        units, last = state.get if state.exists else (bucket.full, times[0])
        allowed, waits, units, last = bucket.fold(times, units, last)
        state.update((units, last))
        yield pd.DataFrame(
            {"_tie": batch["_tie"], "_key": batch["_key"], "allowed": allowed,
             "wait_us": [float(w) for w in waits]}
        )

    types = {f.name: f.dataType.simpleString() for f in narrow.schema.fields}
    decided = narrow.groupBy("_key").applyInPandasWithState(
        step,
        f"_tie {types['_tie']}, _key {types['_key']}, allowed boolean, wait_us double",
        "units bigint, last bigint",
        "append",
        GroupStateTimeout.NoTimeout,
    )
    retry = F.floor(F.col("wait_us") / 1_000_000) + 1
    return decided.select(
        F.col("_tie").alias(row_id),
        F.col("_key").alias(key),
        "allowed",
        (F.col("wait_us") / 1_000_000).alias("wait_seconds"),
        F.when(F.col("allowed"), F.lit(0)).otherwise(retry).cast("int").alias("retry_after"),
    )
