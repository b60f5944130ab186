"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only after its rows were counted and this many bytes suffice.
BROADCAST_BYTES = 24 << 20


def fresh(name: str, taken: Iterable[str]) -> str:
    """A column name that the table does not have yet (names compare without case)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> None:
    """Sets the checkpoint folder where there is none: the cluster's folder, or a temporary one for a single machine."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="llm-checkpoints-")
    context.setCheckpointDir(folder)


#: Folders of the tables saved in the open `temporary` blocks, innermost last; the first never ends.
_open: list[list[str]] = [[]]


def few(df: DataFrame, rows: int, each: int) -> DataFrame:
    """Counted rows, ``rows`` at most, in as many tasks as make ``each`` of them one, and at least two for each core.

    Partitions are only put together, never split, so a table of more rows than that keeps the partitions it has.
    """
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def saved(df: DataFrame) -> DataFrame:
    """The rows as a table in the application's own folder below the shared checkpoint folder.

    Later readers need no recomputation and start from a bare scan: unlike checkpoint(), nothing of the plan
    before (constraints above all, which grow with every round of an iteration) stays with the rows. The folder
    lasts until the application's checkpoints are removed, or until the `temporary` block around it ends.
    """
    return _saved(df, len(_open) - 1)


def _saved(df: DataFrame, depth: int) -> DataFrame:
    spark = df.sparkSession
    shared_folder(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    if depth:
        _open[depth].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Removes the tables that are saved inside when it ends. What it yields saves a table that outlives it."""
    depth = len(_open)
    _open.append([])
    try:
        yield lambda df: _saved(df, depth - 1)
    finally:
        for path in _open.pop():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def fits(rows: int, row_bytes: int) -> bool:
    """Whether counted rows are within the bound for a broadcast."""
    return rows * row_bytes <= BROADCAST_BYTES


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """Marks saved rows for broadcast if their counted size is within the bound, else leaves the join to Spark."""
    return F.broadcast(df) if fits(df.count(), row_bytes) else df


def hashes(text: Column) -> tuple[Column, Column]:
    """128 bits of a text in two columns; one 64-bit hash alone meets others at corpus scale."""
    return F.xxhash64(text), F.xxhash64(text, F.lit(1))


def same(left: DataFrame, right: DataFrame, pairs: Iterable[tuple[str, str]]) -> Column:
    """Null-safe equality on pairs of columns."""
    out = F.lit(True)
    for a, b in pairs:
        out = out & left[a].eqNullSafe(right[b])
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambler; works on whole arrays."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n, modulo 2 ** 64."""
    with np.errstate(over="ignore"):
        steps = np.full(n + 1, base & ((1 << 64) - 1), dtype=np.uint64)
        steps[0] = 1
        return np.cumprod(steps, dtype=np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end], all at once, from running polynomial sums."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data))[:-1], dtype=np.uint64, out=sums[1:])
        out = (sums[ends] - sums[starts]) * powers(_INVERSE, len(data))[starts]
        return mix(out + np.uint64(0x632BE59BD9B4E019) * (ends - starts).astype(np.uint64))


def is_space(data: np.ndarray) -> np.ndarray:
    """ASCII white space among UTF-8 bytes."""
    return (data == 32) | ((data >= 9) & (data <= 13))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without ASCII white space in UTF-8 bytes."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~is_space(data)
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def utf8(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
