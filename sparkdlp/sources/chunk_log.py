"""Logs of streamed answers: ``data:`` lines to ordered chunks.

Works on batch and streaming frames with a ``line`` column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdlp.functions.text import settle, strip

CHAT_CHUNK = (
    "choices array<struct<delta:struct<content:string>,finish_reason:string>>"
)
MESSAGES_CHUNK = (
    "type string, delta struct<type:string,text:string,stop_reason:string>"
)


def _payload(line: Column) -> Column:
    trimmed = strip(line)
    return F.when(trimmed.startswith("data:"), strip(F.substring(trimmed, 6, 2**31 - 1)))


def _chunks(parsed: DataFrame, text: Column, done: Column, finish: Column) -> DataFrame:
    keep = [c for c in parsed.columns if c not in ("line", "_data", "_json")]
    delta = F.coalesce(F.when(~done, text), F.lit(""))
    return parsed.select(
        *keep,
        delta.alias("text_delta"),
        (delta == "").alias("is_control"),
        done.alias("is_done"),
        F.when(~done, finish).alias("finish_reason"),
    )


def _json_lines(lines: DataFrame, schema: str) -> DataFrame:
    """Payload lines that hold JSON; others carry no chunk and are dropped. A line is stripped and parsed once."""
    payload = settle(lines.withColumn("_data", _payload(F.col("line"))), "_data").where(F.col("_data") != "")
    known = (F.col("_data") == "[DONE]") | F.try_parse_json("_data").isNotNull()
    return settle(payload.where(known).withColumn("_json", F.from_json("_data", schema)), "_json")


def _chat(parsed: DataFrame) -> tuple[Column, Column, Column]:
    first = F.get(F.col("_json.choices"), F.lit(0))
    return first["delta"]["content"], F.col("_data") == "[DONE]", first["finish_reason"]


def _messages(parsed: DataFrame) -> tuple[Column, Column, Column]:
    kind, delta = F.col("_json.type"), F.col("_json.delta")
    text = F.when(
        (kind == "content_block_delta") & (delta["type"] == "text_delta"), delta["text"]
    )
    done = F.coalesce(kind == "message_stop", F.lit(False))
    return text, done, F.when(kind == "message_delta", delta["stop_reason"])


def chat_chunks(lines: DataFrame) -> DataFrame:
    parsed = _json_lines(lines, CHAT_CHUNK)
    return _chunks(parsed, *_chat(parsed))


def messages_chunks(lines: DataFrame) -> DataFrame:
    parsed = _json_lines(lines, MESSAGES_CHUNK).where(F.col("_data") != "[DONE]")
    return _chunks(parsed, *_messages(parsed))


def parse_chunks(lines: DataFrame) -> DataFrame:
    """(…, provider, line) of either dialect to one shape, in one pass over the log."""
    is_messages = F.coalesce(F.col("provider") == "anthropic", F.lit(False))
    parsed = _json_lines(lines, f"{CHAT_CHUNK}, {MESSAGES_CHUNK}").where(~is_messages | (F.col("_data") != "[DONE]"))
    both = (F.when(is_messages, m).otherwise(c) for m, c in zip(_messages(parsed), _chat(parsed)))
    return _chunks(parsed, *both)
