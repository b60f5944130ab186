"""Verdicts and answers as two streams, joined to one outcome per request.

A request's verdict is known when it arrives, its answer comes later. Requests whose outcome no answer can change
pass at once; the others wait in the state of a stream-stream join until the answer comes or the time that is
allowed for it has passed. Both sides have watermarks and the join bounds the answer's time, so Spark removes what
has been joined or has waited long enough.

Defined cases: of several answers to a request the first that is read counts. An answer later than ``patience``
after its request, or behind the watermark, does not count: the request's outcome is that of one without an answer,
as in the batch plan where the answer log has no row. A verdict behind the watermark is dropped by Spark and counted
in the query's progress.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdlp.config import GuardConfig
from sparkdlp.operators.decision import decide, policy_block
from sparkdlp.operators.output import scan_outputs
from sparkdlp.operators.score import at_or_above


def needs_answer(cfg: GuardConfig = GuardConfig()) -> Column:
    """Whether a verdict leaves the outcome to the answer."""
    refused = ~F.col("auth_ok") | ~F.col("rate_ok") | ~F.col("valid") | policy_block(cfg) | at_or_above(cfg.injection_threshold)
    failed = F.coalesce(~F.col("upstream_status").between(1, 399), F.lit(False)) & ~F.col("stream")
    return ~F.coalesce(refused | failed, F.lit(False))


def judged_answers(responses: DataFrame, cfg: GuardConfig = GuardConfig(), at: str = "answered_at") -> DataFrame:
    """(request_id, at, block_reason) of whole answers; one projection, on streams as in batch."""
    scanned = scan_outputs(responses.select("request_id", at, "output_text"), cfg.canary_secret, cfg)
    return scanned.select("request_id", at, "block_reason")


def outcome_stream(
    verdicts: DataFrame,
    answers: DataFrame,
    cfg: GuardConfig = GuardConfig(),
    ts: str = "ts",
    at: str = "answered_at",
    patience: str = "10 minutes",
    delay: str = "1 minute",
) -> DataFrame:
    """One decided row per verdict. ``verdicts`` are those of ``guard.verdicts``, ``answers`` have a block reason."""
    waiting = needs_answer(cfg)
    done = decide(verdicts.where(~waiting).withColumn("block_reason", F.lit(None).cast("string")), cfg)
    said = answers.select(F.col("request_id").alias("_of"), F.col(at).alias("_said"), F.col("block_reason").alias("_reason"))
    said = said.withWatermark("_said", delay).dropDuplicatesWithinWatermark(["_of"])
    asked = verdicts.where(waiting).withWatermark(ts, delay)
    in_time = (F.col("_said") >= F.col(ts)) & (F.col("_said") <= F.col(ts) + F.expr(f"INTERVAL {patience}"))
    joined = asked.join(said, (F.col("request_id") == F.col("_of")) & in_time, "left_outer")
    late = decide(joined.withColumn("block_reason", F.col("_reason")).drop("_of", "_said", "_reason"), cfg)
    return late.unionByName(done)
