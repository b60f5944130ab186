"""Settings, captured as literals when a plan is built."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class GuardConfig:
    redact_secrets: bool = True
    redact_pii: bool = True
    decode_evasions: bool = True
    block_on_secret: bool = False
    block_on_pii: bool = False
    injection_threshold: float = 0.70
    classifier: str = "auto"  # auto | onnx | heuristic
    score_on: str = "sanitized"  # sanitized | normalized
    canary: bool = True
    canary_secret: str = "change-me"
    output_secret_scan: bool = True
    strict_streaming: bool = True
    stream_buffer_chars: int = 64
    require_auth: bool = True
    client_keys: str = ""
    rate_limit: bool = True
    requests_per_minute: int = 60
    burst: int = 20
    preview_chars: int = 120
    provider: str = "openai"  # openai | anthropic | openai_compatible

    def __post_init__(self):
        if not 0.0 <= self.injection_threshold <= 1.0:
            raise ValueError("injection_threshold must lie in 0..1")
        if self.classifier not in ("auto", "onnx", "heuristic"):
            raise ValueError(f"unknown classifier {self.classifier!r}")
        if self.score_on not in ("sanitized", "normalized"):
            raise ValueError(f"unknown score_on {self.score_on!r}")
        if self.provider not in ("openai", "anthropic", "openai_compatible"):
            raise ValueError(f"unknown provider {self.provider!r}")

    @property
    def redacts(self) -> bool:
        """Either switch turns on both kinds of redaction."""
        return self.redact_secrets or self.redact_pii

    @property
    def buffer_chars(self) -> int:
        return max(self.stream_buffer_chars, 32)

    @property
    def bucket_capacity(self) -> int:
        return max(self.burst, 1)

    @property
    def known_keys(self) -> list[str]:
        return sorted({k.strip() for k in self.client_keys.split(",") if k.strip()})

    def with_(self, **changes) -> "GuardConfig":
        return replace(self, **changes)


def require_single_machine(spark: SparkSession) -> None:
    """Refuses a cluster without a folder that all of its machines see."""
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
