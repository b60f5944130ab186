"""Token-bucket limits per key, over logged arrivals.

Tokens are counted in whole units of ``1 / period`` token, so refills are integer
and the result does not depend on where a key's timeline is cut.

A bucket is a fold over a key's arrivals in order.  Every key's timeline is cut into
chunks of about ``chunk_rows`` arrivals, most of them into one.  Chunks are folded
one after the other in a sorted partition, so that neither a key nor a partition has
to fit in memory.  Where a key has several, they start in parallel: a chunk is first
reduced to the function from the tokens at its start to the tokens at its end,
the functions of a key are applied one after the other, and then every chunk is
folded again from its now known start.  Results are the same row for row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from sparkdlp.config import GuardConfig
from sparkdlp.sources.tables import saved

CHUNK_ROWS = 1_000_000


@dataclass(frozen=True)
class Bucket:
    """``refill`` tokens come back every ``period_us`` microseconds."""

    capacity: int
    refill: int = 60
    period_us: int = 60_000_000

    @classmethod
    def of(cls, cfg: GuardConfig) -> "Bucket":
        return cls(cfg.bucket_capacity, cfg.requests_per_minute)

    @property
    def full(self) -> int:
        return self.capacity * self.period_us

    def refilled(self, units: int, elapsed_us: int) -> int:
        return min(self.full, units + elapsed_us * self.refill)

    def fold(
        self, times: Iterable[int], units: int, last: int
    ) -> tuple[list[bool], list[int], int, int]:
        """Decisions and waits (microseconds) of ordered arrivals, and the end state."""
        full, refill, one = self.full, self.refill, self.period_us
        allowed, waits = [], []
        for now in times:
            if now > last:  # the clock never goes back, whatever order arrivals come in
                units += (now - last) * refill
                if units > full:
                    units = full
                last = now
            if units >= one:
                units -= one
                allowed.append(True)
                waits.append(0)
            else:
                allowed.append(False)
                waits.append((one - units) / refill)
        return allowed, waits, units, last


# A transfer is a list of pieces (lo, hi, slope, value): start units lo..hi end as
# start + value when slope is 1, as value when it is 0.
Piece = tuple[int, int, int, int]


def transfer(times: list[int], bucket: Bucket) -> list[Piece]:
    """End units of a chunk as a function of the units at its first arrival."""
    full, one = bucket.full, bucket.period_us
    pieces: list[Piece] = [(0, full, 1, 0)]
    last = times[0]
    for now in times:
        gain = (now - last) * bucket.refill
        last = now
        moved: list[Piece] = []
        for lo, hi, slope, value in pieces:
            if not slope:
                units = min(full, value + gain)
                moved.append((lo, hi, 0, units - one if units >= one else units))
                continue
            shift = value + gain
            # start < accept: refused; accept <= start < clip: spends one; else full.
            accept, clip = one - shift, full - shift
            if lo < accept:
                moved.append((lo, min(hi, accept - 1), 1, shift))
            if hi >= accept and lo < clip:
                moved.append((max(lo, accept), min(hi, clip - 1), 1, shift - one))
            if hi >= clip:
                moved.append((max(lo, clip), hi, 0, full - one))
        pieces = [moved[0]]
        for piece in moved[1:]:
            if piece[2:] == pieces[-1][2:]:
                pieces[-1] = (pieces[-1][0], piece[1], *piece[2:])
            else:
                pieces.append(piece)
    return pieces


def apply_transfer(pieces: Iterable[Piece], units: int) -> int:
    for lo, hi, slope, value in pieces:
        if lo <= units <= hi:
            return units + value if slope else value
    raise ValueError("units outside the bucket")


def micros(df: DataFrame, ts: str) -> Column:
    """Microseconds since 1970, for timestamps with and without a time zone."""
    if isinstance(df.schema[ts].dataType, TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(ts))
    return F.unix_micros(F.col(ts))


def _cut(arrivals: DataFrame, chunk_rows: int) -> DataFrame:
    """Adds ``_chunk``: 0, or for keys with over ``chunk_rows`` arrivals a stretch of them in order.

    The arrivals of heavy keys are range-partitioned by key, time and tie into about
    ``chunk_rows`` rows each, however bursty they are, and written to a table: borders
    are sampled and have to be seen twice.  Two jobs run while the plan is built where
    there are heavy keys, one where there are none.  There is at most one heavy key for
    every ``chunk_rows`` arrivals.
    """
    whole = {"_chunk": F.lit(0), "_split": F.lit(False)}
    counted = arrivals.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    heavy = saved(counted.where(F.col("_n") > chunk_rows), "arrivals")
    rows = heavy.agg(F.sum("_n")).first()[0]
    if not rows:
        return arrivals.withColumns(whole)
    heavy = heavy.select("_key")
    ordered = arrivals.join(heavy, "_key", "left_semi").repartitionByRange(
        -(-rows // chunk_rows), "_key", "_us", "_tie"
    )
    split = saved(
        ordered.withColumns({"_chunk": F.spark_partition_id(), "_split": F.lit(True)}), "arrivals"
    )
    return split.unionByName(arrivals.join(heavy, "_key", "left_anti").withColumns(whole))


def _chunk_starts(chunked: DataFrame, bucket: Bucket) -> DataFrame:
    """(_key, _chunk, _units, _last): the state each chunk of a heavy key starts from."""
    summary = "_key string, _chunk int, "
    piece = "array<struct<lo:bigint,hi:bigint,slope:int,value:bigint>>"

    def reduce_chunk(ids: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        times = pdf.sort_values(["_us", "_tie"])["_us"].tolist()
        rows = [
            dict(zip(("lo", "hi", "slope", "value"), p)) for p in transfer(times, bucket)
        ]
        return pd.DataFrame(
            {"_key": [ids[0]], "_chunk": [ids[1]], "first": [times[0]], "last": [times[-1]],
             "pieces": [rows]}
        )

    def chain(ids: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        units, last, starts = bucket.full, None, []
        for row in pdf.sort_values("_chunk").itertuples(index=False):
            starts.append((ids[0], row[1], units, row.first if last is None else last))
            at_first = units if last is None else bucket.refilled(units, row.first - last)
            pieces = [(p["lo"], p["hi"], p["slope"], p["value"]) for p in row.pieces]
            units, last = apply_transfer(pieces, at_first), row.last
        return pd.DataFrame(starts, columns=["_key", "_chunk", "_units", "_last"])

    functions = chunked.groupBy("_key", "_chunk").applyInPandas(
        reduce_chunk, summary + f"first bigint, last bigint, pieces {piece}"
    )
    return functions.groupBy("_key").applyInPandas(chain, summary + "_units bigint, _last bigint")


def token_bucket(
    arrivals: DataFrame,
    bucket: Bucket,
    key: str = "client_key",
    ts: str = "ts",
    row_id: str = "request_id",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """(row_id, key, allowed, retry_after_us, retry_after) for every arrival.

    Arrivals at the same time are taken in the order of ``row_id``.
    """
    # Keys travel as text that is never null: arrivals without a key share one bucket.
    named = F.when(F.col(key).isNull(), F.lit("")).otherwise(
        F.concat(F.lit("="), F.col(key).cast("string"))
    )
    narrow = arrivals.select(
        F.col(row_id).alias("_tie"), F.col(key), named.alias("_key"),
        micros(arrivals, ts).alias("_us"),
    )
    cut = _cut(narrow, chunk_rows)
    starts = _chunk_starts(cut.where("_split"), bucket)
    rows = cut.join(starts, ["_key", "_chunk"], "left")

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sorted rows, key after key; only the running state crosses batches."""
        current, units, last = None, 0, 0
        for pdf in batches:
            keys, chunks = pdf["_key"].to_numpy(), pdf["_chunk"].to_numpy()
            new = np.flatnonzero((keys[1:] != keys[:-1]) | (chunks[1:] != chunks[:-1])) + 1
            edges = [0, *new.tolist(), len(pdf)]
            times, known = pdf["_us"].tolist(), pdf["_units"].notna().tolist()
            starts, lasts = pdf["_units"].tolist(), pdf["_last"].tolist()
            allowed, waits = [], []
            for lo, hi in zip(edges, edges[1:]):
                if (keys[lo], chunks[lo]) != current:
                    current = (keys[lo], chunks[lo])
                    units = int(starts[lo]) if known[lo] else bucket.full
                    last = int(lasts[lo]) if known[lo] else times[lo]
                oks, delays, units, last = bucket.fold(times[lo:hi], units, last)
                allowed += oks
                waits += delays
            yield pd.DataFrame(
                {"_tie": pdf["_tie"], key: pdf[key], "allowed": allowed,
                 "retry_after_us": np.array(waits, dtype=float)}
            )

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    placed = rows.repartition("_key", "_chunk").sortWithinPartitions(
        "_key", "_chunk", "_us", "_tie"
    )
    decided = placed.mapInPandas(
        replay,
        f"_tie {types['_tie']}, `{key}` {types[key]}, allowed boolean, retry_after_us double",
    )
    # Retry-After is the wait in whole seconds, plus one.
    retry = F.floor(F.col("retry_after_us") / 1_000_000) + 1
    return decided.select(
        F.col("_tie").alias(row_id),
        key,
        "allowed",
        (F.col("retry_after_us") / 1_000_000).alias("wait_seconds"),
        F.when(F.col("allowed"), F.lit(0)).otherwise(retry).cast("int").alias("retry_after"),
    )
