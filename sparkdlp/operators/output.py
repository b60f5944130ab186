"""Whole-answer scan and rewritten responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdlp.config import GuardConfig
from sparkdlp.operators.canary import leak_check
from sparkdlp.operators.redact import FINDINGS, redact

LEAK_REASON = "canary_token_leak_detected"

# --- fixed values: provider stop reasons and what they are called outside ------
STOP_REASONS = {"end_turn": "stop", "max_tokens": "length", "stop_sequence": "stop"}
# ------------------------------------------------------------------------------


def finish_reason(stop_reason: Column, default: str | None = "stop") -> Column:
    """Mapped stop reason; unknown ones become ``default``."""
    mapped = F.lit(default).cast("string")
    for name, value in STOP_REASONS.items():
        mapped = F.when(stop_reason == name, F.lit(value)).otherwise(mapped)
    return mapped


def scan_outputs(
    responses: DataFrame, canaries: DataFrame | str, cfg: GuardConfig = GuardConfig()
) -> DataFrame:
    """Adds ``leak``, ``sanitized_output``, ``output_findings``, ``block_reason``.

    A leaked canary withholds the text; anything else is redacted, not blocked.
    """
    checked = (
        leak_check(responses, canaries) if cfg.canary
        else responses.withColumn("leak", F.lit(False))
    )
    source = checked.withColumn(
        "_scan", F.when(F.col("leak"), F.lit("")).otherwise(F.col("output_text"))
    )
    if cfg.output_secret_scan:
        scanned = redact(source, "_scan", "sanitized_output", "output_findings")
    else:
        scanned = source.withColumns(
            {"sanitized_output": F.col("_scan"), "output_findings": F.array().cast(FINDINGS)}
        )
    return scanned.withColumn(
        "block_reason", F.when(F.col("leak"), F.lit(LEAK_REASON))
    ).drop("_scan")


def chat_response(row: DataFrame, text: str = "sanitized_output") -> Column:
    """A messages-API response in the chat-completion shape, as a struct."""
    tokens_in = F.coalesce(F.col("prompt_tokens"), F.lit(0))
    tokens_out = F.coalesce(F.col("completion_tokens"), F.lit(0))
    message = F.struct(F.lit("assistant").alias("role"), F.col(text).alias("content"))
    choice = F.struct(
        F.lit(0).alias("index"),
        message.alias("message"),
        finish_reason(F.col("stop_reason")).alias("finish_reason"),
    )
    return F.struct(
        F.col("response_id").alias("id"),
        F.lit("chat.completion").alias("object"),
        F.coalesce(F.col("model"), F.lit("")).alias("model"),
        F.array(choice).alias("choices"),
        F.struct(
            tokens_in.alias("prompt_tokens"),
            tokens_out.alias("completion_tokens"),
            (tokens_in + tokens_out).alias("total_tokens"),
        ).alias("usage"),
    )


_MEMBERS = "map<string,variant>"


def with_member(members: Column, name: str, value: Column) -> Column:
    """A map of JSON members with one of them set; the others stay whatever they are."""
    others = F.map_filter(members, lambda k, _: k != name)
    return F.map_concat(others, F.create_map(F.lit(name), value))


def replace_first_choice(body: Column, text: Column) -> Column:
    """Chat-completion JSON with the first choice's text replaced, all else kept."""
    whole = F.try_parse_json(body)
    choices = F.try_variant_get(whole, "$.choices", "array<variant>")

    def answered(choice: Column) -> Column:
        message = F.try_variant_get(choice, "$.message", _MEMBERS)
        said = with_member(message, "content", text.cast("variant"))
        return F.to_variant_object(
            with_member(choice.cast(_MEMBERS), "message", F.to_variant_object(said))
        )

    edited = F.transform(choices, lambda c, i: F.when(i == 0, answered(c)).otherwise(c))
    return F.to_json(
        with_member(whole.cast(_MEMBERS), "choices", F.to_variant_object(edited))
    )


def replace_only_block(body: Column, text: Column) -> Column:
    """Messages-API JSON whose content is one text block holding ``text``, all else kept."""
    block = F.array(F.struct(F.lit("text").alias("type"), text.alias("text")))
    members = F.try_parse_json(body).cast(_MEMBERS)
    return F.to_json(with_member(members, "content", F.to_variant_object(block)))


def rewritten_bodies(scanned: DataFrame) -> DataFrame:
    """``final_body``: the response that goes to the client.

    Messages-API responses always change shape; chat completions are rewritten
    only where something was redacted.
    """
    return scanned.withColumn(
        "final_body",
        F.when(F.col("leak"), F.lit(None).cast("string"))
        .when(F.col("provider") == "anthropic", F.to_json(chat_response(scanned)))
        .when(
            F.size("output_findings") > 0,
            replace_first_choice(F.col("body"), F.col("sanitized_output")),
        )
        .otherwise(F.col("body")),
    )
