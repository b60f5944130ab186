"""The whole path of a request: from the log to one outcome row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdlp.config import GuardConfig
from sparkdlp.operators import gates, output, rate_limit
from sparkdlp.operators.chunk_dlp import chunk_outcome, scan_chunks
from sparkdlp.operators.decision import decide
from sparkdlp.operators.requests import ordered_text, rollup, scan_parts
from sparkdlp.operators.score import Scorer, model_score


def admit(requests: DataFrame, keys: DataFrame, cfg: GuardConfig = GuardConfig()) -> DataFrame:
    """Adds ``client_key``, ``auth_ok`` and ``rate_ok``.

    Every authenticated arrival spends a token, whatever becomes of it later.
    """
    keyed = requests.withColumn(
        "client_key", gates.client_key(F.col("auth_header"), F.col("x_api_key"))
    )
    checked = gates.with_auth(keyed, keys, cfg.require_auth)
    if not cfg.rate_limit:
        return checked.withColumns({"rate_ok": F.lit(True), "retry_after": F.lit(0)})
    arrivals = checked.where("auth_ok").select(
        "request_id", "ts",
        gates.rate_key(F.col("client_key"), F.col("client_host")).alias("rate_key"),
    )
    limited = rate_limit.token_bucket(arrivals, rate_limit.Bucket.of(cfg), "rate_key").select(
        "request_id", F.col("allowed").alias("rate_ok"), "retry_after"
    )
    return checked.join(limited, "request_id", "left").withColumn(
        "rate_ok", F.coalesce("rate_ok", F.lit(True))
    )


def verdicts(
    requests: DataFrame,
    parts: DataFrame,
    keys: DataFrame,
    cfg: GuardConfig = GuardConfig(),
    scorer: Callable[[], Scorer] | None = None,
) -> DataFrame:
    """One row per request with all that is known before its answer: gates, flags, score, labels, preview."""
    if cfg.classifier == "onnx" and scorer is None:
        raise RuntimeError("classifier 'onnx' needs a scorer; use 'auto' to fall back")
    admitted = admit(requests, keys, cfg)
    rolled = rollup(scan_parts(parts, cfg), cfg.preview_chars)
    if scorer is not None and cfg.classifier != "heuristic":
        scored = model_score(ordered_text(scan_parts(parts, cfg), "scored_text"), scorer, "scan_text")
        rolled = rolled.drop("score").join(scored.select("request_id", "score"), "request_id", "left")
    joined = admitted.join(rolled, "request_id", "left")
    no_labels = F.array().cast("array<string>")
    return joined.withColumns(
        {
            **{c: F.coalesce(c, F.lit(False)) for c in ("inj_hit", "has_secret", "has_pii")},
            **{
                c: F.coalesce(c, no_labels)
                for c in ("secret_findings", "pii_findings", "evasion_signals")
            },
            "score": F.coalesce("score", F.lit(0.0)),
            "prompt_preview": F.coalesce("prompt_preview", F.lit("")),
        }
    )


def outcomes(
    requests: DataFrame,
    parts: DataFrame,
    keys: DataFrame,
    responses: DataFrame,
    cfg: GuardConfig = GuardConfig(),
    chunks: DataFrame | None = None,
    scorer: Callable[[], Scorer] | None = None,
) -> DataFrame:
    """One row per request: flags, score, labels, decision, status, code, reason.

    ``responses`` are parsed whole answers (``sources.responses``), ``chunks`` the
    ordered chunks of streamed ones (``sources.chunk_log``): a streamed answer with
    a secret is stopped, a whole one is redacted.  Requests without any text keep
    score 0.  ``scorer`` loads a model that scores each request's text instead of
    the heuristic.  Canary tokens are columns, so no answer is moved to meet its
    token; all joins are on ``request_id``, unique on every side, and carry no text
    but the preview.
    """
    known = verdicts(requests, parts, keys, cfg, scorer)
    answers = output.scan_outputs(
        responses.select("request_id", "output_text"), cfg.canary_secret, cfg
    ).select("request_id", F.col("block_reason").alias("_whole"))
    joined = known.join(answers, "request_id", "left")
    if chunks is None:
        streamed = F.lit(None).cast("string")
    else:
        ended = chunk_outcome(scan_chunks(chunks, cfg.canary_secret, cfg))
        joined = joined.join(
            ended.select("request_id", F.col("reason").alias("_streamed")), "request_id", "left"
        )
        streamed = F.col("_streamed")
    block_reason = F.when(F.col("stream"), streamed).otherwise(F.col("_whole"))
    return decide(joined.withColumn("block_reason", block_reason).drop("_whole", "_streamed"), cfg)
