"""Streaming scan of answer chunks that come in any order, with state that is linear and expires.

Chunks count up from a first number. One that comes before its predecessors is put into a map keyed by its number,
once, and taken out once when its turn has come, whatever else arrives meanwhile. Between chunks a request keeps the
characters that are held back, and how far each spelling of its canary has been matched: the automaton goes on from
there instead of reading the held text again. An event-time timer removes all of a request ``keep`` after its newest
chunk, a blocked one's tombstone too.

Defined cases: a repeated number is dropped. Chunks after the end, or after a block, are dropped. Chunks whose
predecessors do not come before the timer are never released. What comes after a request's state was removed starts
a new request that waits for its first chunk, so nothing of it is released either. Chunks behind the watermark are
dropped by Spark and counted in the query's progress. Needs the RocksDB state store.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sparkdlp.config import GuardConfig
from sparkdlp.functions.patterns import SECRET_PATTERNS
from sparkdlp.operators.chunk_dlp import SECRET_REASON
from sparkdlp.operators.output import LEAK_REASON
from sparkdlp.operators.redact import redact
from sparkdlp.streaming.event_time_limit import PROVIDER, ROCKSDB

_OUT = ["request_id", "seq", "raw", "blocked", "reason", "finish"]
_PLACE = "held string, stopped boolean, named boolean, next bigint, waiting bigint, due bigint, at0 int, at1 int"


def borders(word: str) -> list[int]:
    """For each length of a matched beginning, the length to go on from when the next character does not fit."""
    out, k = [0], 0
    for char in word[1:]:
        while k and word[k] != char:
            k = out[k - 1]
        k += word[k] == char
        out.append(k)
    return out


def follow(word: str, back: list[int], at: int, text: str) -> tuple[int, list[int]]:
    """How much of ``word`` is matched after ``text``, and the places in ``text`` behind which it ended."""
    ends = []
    for i, char in enumerate(text, 1):
        if at == len(word):
            at = back[at - 1]
        while at and word[at] != char:
            at = back[at - 1]
        at += word[at] == char
        if at == len(word):
            ends.append(i)
    return at, ends


class OrderedChunks(StatefulProcessor):
    """One request: ``place`` is where it stands, ``gaps`` the chunks that wait for their predecessors."""

    def __init__(self, cfg: GuardConfig, first_seq: int, keep_ms: int) -> None:
        self.cfg, self.first, self.keep_ms = cfg, first_seq, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", _PLACE)
        self.gaps = handle.getMapState("gaps", "seq bigint", "delta string, done boolean, finish string, token string")
        self.patterns = [re.compile(p) for p in SECRET_PATTERNS.values()] if self.cfg.output_secret_scan else []

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        if self.place.exists():
            self.held, self.stopped, self.named, self.next, waiting, due, *self.at = self.place.get()
        else:
            self.held, self.stopped, self.named, self.next, waiting, due, *self.at = "", False, False, self.first, 0, 0, 0, 0
        newest = due
        for batch in rows:
            newest = max(newest, int(batch["arrived_ms"].max()) + self.keep_ms)
            out = []
            ordered = batch.sort_values("seq", kind="stable")
            for seq, *chunk in zip(*(ordered[c].tolist() for c in ("seq", "delta", "done", "finish", "token"))):
                if self.stopped or seq < self.next:
                    continue
                if seq > self.next:
                    if not self.gaps.containsKey((seq,)):
                        self.gaps.updateValue((seq,), tuple(chunk))
                        waiting += 1
                    continue
                out.append((key[0], seq, *self._judged(*chunk)))
                while waiting and not self.stopped and self.gaps.containsKey((self.next,)):
                    seq, chunk = self.next, self.gaps.getValue((self.next,))
                    self.gaps.removeKey((seq,))
                    waiting -= 1
                    out.append((key[0], seq, *self._judged(*chunk)))
            if out:
                yield pd.DataFrame(out, columns=_OUT)
        if self.stopped and waiting:
            self.gaps.clear()
            waiting = 0
        if newest > due:
            if due:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(newest)
        self.place.update((self.held, self.stopped, self.named, self.next, waiting, newest, *self.at))

    def _leaks(self, token: str, delta: str, least: int) -> bool:
        """Whether a spelling of the token ends in the delta and starts at ``least`` or behind it."""
        found = False
        for i, word in enumerate((token, " ".join(token))):
            self.at[i], ends = follow(word, borders(word), self.at[i], delta)
            found |= any(end - len(word) >= least for end in ends)
        return found

    def _judged(self, delta: str, done: bool, finish_reason: str, token: str) -> tuple:
        """(raw, blocked, reason, finish) of the next chunk in order."""
        self.next += 1
        buffer, strict = self.cfg.buffer_chars, self.cfg.strict_streaming
        control = done or delta == ""
        delta = "" if control else delta
        seen = self.held + delta
        looked = seen if strict else seen[-2 * buffer :]
        # The delta ends where the looked-at text ends, which says where that begins within the delta.
        leak = bool(token) and not control and self._leaks(token, delta, len(delta) - len(looked))
        reason, finish = LEAK_REASON if leak else None, None
        if not reason and (strict or not control) and any(p.search(looked) for p in self.patterns):
            reason = SECRET_REASON
        if strict:
            cut = len(seen) if control else max(len(seen) - buffer, 0)
            raw, self.held = seen[:cut], seen[cut:]
            if control:
                self.at = [0, 0]
        elif control:
            raw = ""
        else:
            raw, self.held = delta, looked
        if reason:
            raw, self.stopped = "", True
        elif done:
            finish, self.stopped = (None if self.named else finish_reason or "stop"), True
        elif control and finish_reason and not self.named:
            finish, self.named = finish_reason, True
        if self.stopped:
            self.held = ""
        return raw, reason is not None, reason, finish

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.place.clear()
        self.gaps.clear()
        return iter(())

    def close(self) -> None:
        pass


def ordered_chunk_stream(
    chunks: DataFrame,
    cfg: GuardConfig = GuardConfig(),
    token: str | None = "token",
    at: str = "ts",
    first_seq: int = 0,
    keep_ms: int = 3_600_000,
    delay: str = "10 minutes",
) -> DataFrame:
    """The batch operator's rows, for chunks that come in any order within ``delay`` and ``keep_ms``.

    ``seq`` counts up from ``first_seq`` by one, ``at`` is a chunk's event time, ``token`` names the column that
    carries the request's canary.
    """
    if not chunks.sparkSession.conf.get(PROVIDER).endswith("RocksDBStateStoreProvider"):
        raise ValueError(f"set {PROVIDER} to {ROCKSDB}")
    moment = F.col(at).cast("timestamp")
    rows = chunks.select(
        "request_id", "seq", F.coalesce("text_delta", F.lit("")).alias("delta"),
        F.coalesce("is_done", F.lit(False)).alias("done"),
        F.coalesce("finish_reason", F.lit("")).alias("finish"),
        F.coalesce(F.col(token), F.lit("")).alias("token") if cfg.canary and token is not None else F.lit("").alias("token"),
        moment.alias("arrived"), F.unix_millis(moment).alias("arrived_ms"),
    ).withWatermark("arrived", delay)
    id_type = rows.schema["request_id"].dataType.simpleString()
    live = rows.groupBy("request_id").transformWithStateInPandas(
        OrderedChunks(cfg, first_seq, keep_ms),
        f"request_id {id_type}, seq bigint, raw string, blocked boolean, reason string, finish string",
        "append",
        "eventTime",
    )
    if not cfg.output_secret_scan:
        return live.withColumnRenamed("raw", "release")
    return redact(live, "raw", "release", "_found").select("request_id", "seq", "release", "blocked", "reason", "finish")
