"""The one outcome of each request, and the counters over outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdlp.config import GuardConfig
from sparkdlp.operators.score import at_or_above

# --- fixed values: the ladder's exits (decision, error code) -------------------
# ``decision`` is what the audit row says; the first three exits are not audited.
EXITS = {
    "blocked_auth": ("blocked_auth", "authentication_error"),
    "blocked_rate_limit": ("blocked_rate_limit", "rate_limited"),
    "invalid_request": ("invalid_request", "invalid_request"),
    "blocked_secret_or_pii": ("blocked_secret_or_pii", "secret_or_pii_detected"),
    "blocked_injection": ("blocked_injection", "injection_detected"),
    "upstream_error": ("error", "upstream_error"),
    "blocked_output": ("blocked_canary_leak", "canary_token_leak_detected"),
    "allowed": ("allowed", None),
}
METRICS = (
    "requests_total",
    "requests_blocked_injection",
    "requests_blocked_secret_or_pii",
    "requests_blocked_canary_leak",
    "requests_blocked_rate_limit",
    "requests_blocked_auth",
    "requests_allowed",
    "upstream_errors",
)
# ------------------------------------------------------------------------------
METRIC_PREFIX = "sparkdlp_"


def policy_block(cfg: GuardConfig) -> Column:
    secret = F.lit(cfg.block_on_secret) & F.col("has_secret")
    return secret | (F.lit(cfg.block_on_pii) & F.col("has_pii"))


def decide(requests: DataFrame, cfg: GuardConfig = GuardConfig()) -> DataFrame:
    """Adds ``exit``, ``decision``, ``status``, ``code`` and ``reason``.

    Needs ``auth_ok``, ``rate_ok``, ``valid``, ``has_secret``, ``has_pii``,
    ``score``, ``stream``, ``upstream_status``, ``upstream_detail`` and
    ``block_reason``.  A stream that fails upstream still ends as allowed.
    """
    failed = F.coalesce(~F.col("upstream_status").between(1, 399), F.lit(False))
    exit_ = (
        F.when(~F.col("auth_ok"), "blocked_auth")
        .when(~F.col("rate_ok"), "blocked_rate_limit")
        .when(~F.col("valid"), "invalid_request")
        .when(policy_block(cfg), "blocked_secret_or_pii")
        .when(at_or_above(cfg.injection_threshold), "blocked_injection")
        .when(failed & ~F.col("stream"), "upstream_error")
        .when(F.col("block_reason").isNotNull(), "blocked_output")
        .otherwise("allowed")
    )
    step = requests.withColumns({"exit": exit_, "upstream_failed": failed})

    def by_exit(values: dict) -> Column:
        out = F.lit(None)
        for name, value in values.items():
            if value is not None:
                shown = F.lit(value) if isinstance(value, (str, int)) else value
                out = F.when(F.col("exit") == name, shown).otherwise(out)
        return out

    upstream = F.when(F.col("upstream_status") >= 400, F.col("upstream_status")).otherwise(502)
    status = {
        "blocked_auth": 401,
        "blocked_rate_limit": 429,
        "invalid_request": 400,
        "blocked_secret_or_pii": 400,
        "blocked_injection": 422,
        "upstream_error": upstream,
        "blocked_output": F.when(F.col("stream"), 200).otherwise(502),
        "allowed": 200,
    }
    codes = {name: code for name, (_, code) in EXITS.items()}
    codes["blocked_output"] = F.when(F.col("stream"), F.lit("output_blocked")).otherwise(
        F.col("block_reason")
    )
    reasons = {
        "blocked_secret_or_pii": "secret_or_pii_policy",
        "blocked_injection": F.concat(
            F.format_string("layer2_score=%.3f", F.col("score")),
            F.lit(f" >= threshold={float(cfg.injection_threshold)}"),
        ),
        "upstream_error": F.col("upstream_detail"),
        "blocked_output": F.col("block_reason"),
    }
    return step.withColumns(
        {
            "decision": by_exit({name: decision for name, (decision, _) in EXITS.items()}),
            "status": by_exit(status).cast("int"),
            "code": by_exit(codes),
            "reason": by_exit(reasons),
        }
    )


def metrics(decided: DataFrame) -> DataFrame:
    """(metric, value): the eight counters in one pass.

    They are not a partition of the requests: a failed stream counts both as an
    upstream error and as allowed.
    """

    def counted(*exits: str) -> Column:
        return F.count_if(F.col("exit").isin(*exits))

    forwarded = F.col("exit").isin("allowed", "blocked_output")
    stream_failed = F.col("stream") & F.col("upstream_failed") & forwarded
    counters = (
        F.count(F.lit(1)),
        counted("blocked_injection"),
        counted("blocked_secret_or_pii"),
        counted("blocked_output"),
        counted("blocked_rate_limit"),
        counted("blocked_auth"),
        counted("allowed"),
        F.count_if((F.col("exit") == "upstream_error") | stream_failed),
    )
    pairs = F.array(
        *(
            F.struct(F.lit(METRIC_PREFIX + name).alias("metric"), c.alias("value"))
            for name, c in zip(METRICS, counters)
        )
    )
    return decided.agg(pairs.alias("m")).select(F.inline("m"))
