"""Response logs of both dialects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What is read of the bodies; rewritten bodies are made from their whole JSON.
CHAT_BODY = (
    "id string, object string, created bigint, model string, "
    "choices array<struct<index:int,message:struct<role:string,content:string>,"
    "finish_reason:string>>, "
    "usage struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>"
)
MESSAGES_BODY = (
    "id string, model string, content array<struct<type:string,text:string>>, "
    "stop_reason string, usage struct<input_tokens:bigint,output_tokens:bigint>"
)


_PARSED = ("output_text", "stop_reason", "response_id", "model", "prompt_tokens", "completion_tokens")


def _chat(body: Column) -> tuple[Column, ...]:
    """First choice's text, or an empty one; other choices are left alone."""
    b = F.from_json(body, CHAT_BODY)
    first = F.get(b["choices"], F.lit(0))
    text = F.coalesce(first["message"]["content"], F.lit(""))
    usage = b["usage"]
    return text, first["finish_reason"], b["id"], b["model"], usage["prompt_tokens"], usage["completion_tokens"]


def _messages(body: Column) -> tuple[Column, ...]:
    """Text blocks joined."""
    b = F.from_json(body, MESSAGES_BODY)
    blocks = F.filter(
        F.coalesce(b["content"], F.array().cast("array<struct<type:string,text:string>>")),
        lambda block: block["type"] == "text",
    )
    text = F.array_join(F.transform(blocks, lambda x: F.coalesce(x["text"], F.lit(""))), "")
    usage = b["usage"]
    return text, b["stop_reason"], b["id"], b["model"], usage["input_tokens"], usage["output_tokens"]


def _with_fields(raw: DataFrame, fields: tuple[Column, ...]) -> DataFrame:
    return raw.select("*", *(c.alias(name) for name, c in zip(_PARSED, fields)))


def parse_chat(raw: DataFrame) -> DataFrame:
    return _with_fields(raw, _chat(F.col("body")))


def parse_messages(raw: DataFrame) -> DataFrame:
    return _with_fields(raw, _messages(F.col("body")))


def parse_responses(raw: DataFrame) -> DataFrame:
    """(…, provider, body) of either dialect to one shape, in one pass over the log."""
    is_messages = F.coalesce(F.col("provider") == "anthropic", F.lit(False))
    # A body is parsed by its own dialect only: the other parser gets a null.
    chat = _chat(F.when(~is_messages, F.col("body")))
    messages = _messages(F.when(is_messages, F.col("body")))
    both = (F.when(is_messages, m).otherwise(c) for m, c in zip(messages, chat))
    return _with_fields(raw, tuple(both))
