"""Requests rewritten for a messages-API provider."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------
DEFAULT_MAX_TOKENS = 1024
# ------------------------------------------------------------------------------


def system_text(messages: Column) -> Column:
    """System contents joined by a blank line, empty ones skipped; null without any."""
    systems = F.filter(messages, lambda m: m["role"] == "system")
    texts = F.transform(systems, lambda m: F.coalesce(m["content"], F.lit("")))
    return F.when(F.size(systems) > 0, F.array_join(F.filter(texts, lambda t: t != ""), "\n\n"))


def chat_turns(messages: Column) -> Column:
    """The other messages, with every role but assistant turned into user."""
    others = F.filter(messages, lambda m: m["role"] != "system")
    return F.transform(
        others,
        lambda m: F.struct(
            F.when(m["role"] == "assistant", "assistant").otherwise("user").alias("role"),
            F.coalesce(m["content"], F.lit("")).alias("content"),
        ),
    )


def to_messages_api(requests: DataFrame) -> DataFrame:
    """(request_id, model, system, messages, max_tokens, stream, …) of the rewritten body.

    ``stop_sequences`` stays absent without ``stop``; a single string becomes a list.
    """
    messages = F.col("messages")
    return requests.select(
        "request_id",
        "model",
        system_text(messages).alias("system"),
        chat_turns(messages).alias("messages"),
        F.coalesce(F.nullif("max_tokens", F.lit(0)), F.lit(DEFAULT_MAX_TOKENS)).alias("max_tokens"),
        F.coalesce("stream", F.lit(False)).alias("stream"),
        "temperature",
        "top_p",
        F.coalesce(
            F.try_variant_get("stop", "$", "array<string>"),
            F.when(
                F.try_variant_get("stop", "$", "string").isNotNull(),
                F.array(F.try_variant_get("stop", "$", "string")),
            ),
        ).alias("stop_sequences"),
    )
