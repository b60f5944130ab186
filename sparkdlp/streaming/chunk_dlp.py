"""Streaming scan of answer chunks, keyed by request.

The state operator keeps the order-dependent part: the held-back characters and
where a stream stopped.  Redaction of what it lets go is done by the same columns
as in batch.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkdlp.config import GuardConfig
from sparkdlp.functions.patterns import SECRET_PATTERNS
from sparkdlp.operators.chunk_dlp import SECRET_REASON
from sparkdlp.operators.output import LEAK_REASON
from sparkdlp.operators.redact import redact

_OUT = "request_id {id}, seq bigint, raw string, blocked boolean, reason string, finish string"
_STATE = "held string, stopped boolean, named boolean, last_seq bigint, early string"


def scan_chunk_stream(
    chunks: DataFrame,
    cfg: GuardConfig = GuardConfig(),
    token: str | None = "token",
    idle_ms: int | None = None,
    first_seq: int | None = None,
) -> DataFrame:
    """The batch operator's rows, for a stream of chunks.

    ``token`` names the column that carries the request's canary.  With
    ``first_seq``, ``seq`` counts up from there by one: chunks that come before
    their predecessors wait in the state, and only true repeats are dropped.
    Without it a chunk that comes in a later micro-batch than its successors cannot
    be told from a repeat, so order must hold from one micro-batch to the next.
    With ``idle_ms``, what a request holds back is dropped when it is silent for
    that long (batches then go on without new data, so it does not suit
    ``availableNow``); where it stopped is kept, so a blocked request stays blocked.
    """
    buffer, strict = cfg.buffer_chars, cfg.strict_streaming
    keep = buffer if strict else 2 * buffer
    secrets, use_canary = cfg.output_secret_scan, cfg.canary and token is not None
    rows = chunks.select(
        "request_id", "seq", F.coalesce("text_delta", F.lit("")).alias("text_delta"),
        F.coalesce("is_done", F.lit(False)).alias("is_done"),
        F.coalesce("finish_reason", F.lit("")).alias("finish_reason"),
        (F.col(token) if use_canary else F.lit("")).alias("token"),
    )

    def step(ids, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            _, *where, _ = state.get
            state.update(("", *where, "[]"))
            return
        patterns = [re.compile(p) for p in SECRET_PATTERNS.values()] if secrets else []

        def verdict(text: str, tok: str) -> str | None:
            if tok and (tok in text or " ".join(tok) in text):
                return LEAK_REASON
            return SECRET_REASON if any(p.search(text) for p in patterns) else None

        before = -(2**62) if first_seq is None else first_seq - 1
        held, stopped, named, last, early = (
            state.get if state.exists else ("", False, False, before, "[]")
        )
        batch = pd.concat(list(frames))
        waiting = json.loads(early)
        if waiting:
            batch = pd.concat([pd.DataFrame(waiting, columns=batch.columns), batch])
        batch, waiting = batch.sort_values("seq"), []
        out = []
        for row in batch.itertuples(index=False):
            if stopped or row.seq <= last:
                continue
            if first_seq is not None and row.seq > last + 1:
                waiting.append([x.item() if hasattr(x, "item") else x for x in row])
                continue
            last, finish = row.seq, None
            control = row.is_done or row.text_delta == ""
            delta = "" if control else row.text_delta
            seen = held + delta
            if strict:
                reason = verdict(seen, row.token)
                cut = len(seen) if control else max(len(seen) - buffer, 0)
                raw, held = seen[:cut], seen[cut:]
            elif control:
                reason, raw = None, ""
            else:
                held = seen[-keep:]
                reason, raw = verdict(held, row.token), delta
            if reason:
                raw, stopped = "", True
            elif row.is_done:
                finish, stopped = (None if named else row.finish_reason or "stop"), True
            elif control and row.finish_reason and not named:
                finish, named = row.finish_reason, True
            out.append((ids[0], row.seq, raw, reason is not None, reason, finish))
        state.update((held, stopped, named, last, json.dumps([] if stopped else waiting)))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(
            out, columns=["request_id", "seq", "raw", "blocked", "reason", "finish"]
        )

    timeout = (
        GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    )
    id_type = rows.schema["request_id"].dataType.simpleString()
    live = rows.groupBy("request_id").applyInPandasWithState(
        step, _OUT.format(id=id_type), _STATE, "append", timeout
    )
    if not secrets:
        return live.withColumnRenamed("raw", "release")
    kept = ("request_id", "seq", "release", "blocked", "reason", "finish")
    return redact(live, "raw", "release", "_found").select(*kept)
