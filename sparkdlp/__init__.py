"""Scanning, redaction and guard analytics over LLM traffic, as Spark DataFrames."""

from sparkdlp.config import GuardConfig

__all__ = ["GuardConfig"]
