"""From the raw logs to one outcome row per request."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from sparkdlp.config import GuardConfig
from sparkdlp.functions.text import settle
from sparkdlp.operators.requests import content_parts, message_explode
from sparkdlp.operators.score import Scorer
from sparkdlp.plans import guard
from sparkdlp.sources.chunk_log import parse_chunks
from sparkdlp.sources.request_log import parse_requests
from sparkdlp.sources.responses import parse_responses
from sparkdlp.sources.tables import saved

#: What a body says goes before columns of the log by these names.
_FROM_BODY = ("raw", "model", "messages", "stream", "temperature", "top_p", "max_tokens", "stop", "valid")


def outcomes(
    log: DataFrame,
    keys: DataFrame,
    responses: DataFrame,
    cfg: GuardConfig = GuardConfig(),
    chunk_lines: DataFrame | None = None,
    scorer: Callable[[], Scorer] | None = None,
    body: str = "value",
) -> DataFrame:
    """``guard.outcomes`` over logs as they were written.

    ``log`` has one row per arrival: request_id, ts, the headers, the upstream's status, and the body's text, which
    alone says whether the request is valid and whether it asks for a stream. ``responses`` are raw bodies with
    their provider, ``chunk_lines`` raw lines of streamed answers with theirs. Bodies that are not valid are
    refused unread: their texts are neither scanned nor scored.
    """
    known = log.select(*[c for c in log.columns if c not in _FROM_BODY])
    parsed = parse_requests(known, body)
    # Who only counts arrivals reads no body; who reads messages cuts each body once.
    parts = content_parts(message_explode(settle(parsed.select("request_id", "valid", "messages"), "valid", "messages").where("valid")))
    arrivals = parsed.select(*[c for c in known.columns if c != body], "stream", "valid")
    # The scan reads the chunks several times over; the lines are parsed once, into a table.
    chunks = None if chunk_lines is None else saved(parse_chunks(chunk_lines), "chunks")
    return guard.outcomes(arrivals, parts, keys, parse_responses(responses), cfg, chunks, scorer)
