"""Audit columns and rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdlp.config import GuardConfig
from sparkdlp.functions.text import rstrip, strip

SCHEMA = (
    "request_id string, timestamp double, client_key_fingerprint string, decision string, "
    "layer2_score double, injection_heuristic_hit boolean, secret_findings array<string>, "
    "pii_findings array<string>, evasion_signals array<string>, prompt_preview string, "
    "latency_ms double, upstream_provider string, reason string"
)
# Exits before the body is understood leave no audit row.
UNAUDITED = ("blocked_auth", "blocked_rate_limit", "invalid_request")


def fingerprint(key: Column) -> Column:
    """Short, one-way name of a client key."""
    return F.when(F.coalesce(key, F.lit("")) == "", F.lit("anonymous")).otherwise(
        F.substring(F.sha2(key, 256), 1, 12)
    )


def prompt_preview(text: Column, limit: int = 120) -> Column:
    one_line = strip(F.replace(text, F.lit("\n"), F.lit(" ")))
    cut = F.concat(rstrip(F.left(one_line, F.lit(limit))), F.lit("…"))
    return F.when(F.length(one_line) <= limit, one_line).otherwise(cut)


# A preview shows the start of a text and whether more follows, so a part needs to
# send at most ``limit + 1`` characters and three numbers to be merged in order.

_SUMMARY = "struct<n:bigint,first:bigint,last:bigint,head:string,shown:string>"


def preview_summary(text: Column, limit: int) -> Column:
    """Length, first and last visible position, start, and start at ``first``."""
    left = F.regexp_replace(text, r"\A[\t-\r\x1C-\x1F\x85\p{Z}]+", "")
    n, visible = F.length(text).cast("bigint"), F.length(strip(text))
    first = F.when(visible > 0, n - F.length(left))
    return F.struct(
        n.alias("n"),
        first.alias("first"),
        (first + visible - 1).alias("last"),
        F.left(text, F.lit(limit + 1)).alias("head"),
        F.when(visible > 0, F.left(left, F.lit(limit + 1))).alias("shown"),
    ).cast(_SUMMARY)


def merge_summaries(order: Column, summary: Column, limit: int) -> Column:
    """Summary of the texts joined, in order, by one space."""
    item = F.when(summary.isNotNull(), F.struct(order.alias("o"), summary.alias("s")))
    items = F.array_sort(F.collect_list(item))
    start = F.lit(None).cast(_SUMMARY)

    def add(acc: Column, item: Column) -> Column:
        s = item["s"]
        base = acc["n"] + 1
        last = F.coalesce(base + s["last"], acc["last"])
        # Visible text began before: it goes on with a space and the next start,
        # as long as nothing of the earlier text was cut off.
        room = acc["n"] - acc["first"] <= limit
        longer = F.when(
            room, F.left(F.concat(acc["shown"], F.lit(" "), s["head"]), F.lit(limit + 1))
        ).otherwise(acc["shown"])
        both = F.struct(
            (base + s["n"]).alias("n"),
            F.coalesce(acc["first"], base + s["first"]).alias("first"),
            last.alias("last"),
            F.left(F.concat(acc["head"], F.lit(" "), s["head"]), F.lit(limit + 1)).alias("head"),
            F.when(acc["first"].isNotNull(), longer).otherwise(s["shown"]).alias("shown"),
        ).cast(_SUMMARY)
        return F.when(acc.isNull(), s).otherwise(both)

    return F.aggregate(items, start, add)


def summary_preview(s: Column, limit: int) -> Column:
    """The preview of the text that ``s`` summarizes."""
    length = s["last"] - s["first"] + 1
    cut = F.concat(rstrip(F.left(s["shown"], F.lit(limit))), F.lit("…"))
    return (
        F.when(s["first"].isNull(), F.lit(""))
        .when(length <= limit, F.left(s["shown"], length.cast("int")))
        .otherwise(cut)
    )


def round_binary(x: Column, digits: int) -> Column:
    """Rounds the exact value of a double, halves to even, as a correctly rounding library does.

    The product with the power of ten is rounded itself; where it looks like a half,
    its exact error (by splitting ``x``) says on which side of the half it lies.
    """
    scale = F.lit(float(10**digits))
    product = x * scale
    spread = x * F.lit(134217729.0)
    high = spread - (spread - x)
    error = (high * scale - product) + (x - high) * scale
    low = F.floor(product).cast("double")
    rest = product - low
    up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & (low % 2 != 0))))
    return F.when(up, low + 1).otherwise(low) / scale


def audit_rows(outcomes: DataFrame, cfg: GuardConfig = GuardConfig()) -> DataFrame:
    """One row per decided request; labels only, never previews of findings."""
    decided = outcomes.where(~F.col("exit").isin(*UNAUDITED))
    return decided.select(
        F.col("request_id").cast("string").alias("request_id"),
        (F.unix_micros("ts") / 1e6).alias("timestamp"),
        fingerprint(F.col("client_key")).alias("client_key_fingerprint"),
        "decision",
        F.when(F.col("exit") != "blocked_secret_or_pii", round_binary(F.col("score"), 4)).alias(
            "layer2_score"
        ),
        F.col("inj_hit").alias("injection_heuristic_hit"),
        "secret_findings",
        "pii_findings",
        "evasion_signals",
        "prompt_preview",
        round_binary(F.col("latency_ms"), 2).alias("latency_ms"),
        F.lit(cfg.provider).alias("upstream_provider"),
        "reason",
    )
