"""Request logs: JSON lines to typed requests, with bad rows kept and flagged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdlp.functions import json_spans as js
from sparkdlp.functions.text import let

BODY = (
    "model string, messages array<struct<role:string,content:variant,name:variant>>, "
    "stop variant"
)
ROLES = ("system", "user", "assistant", "tool")


def _is_kind(value: Column, *kinds: str) -> Column:
    kind = F.schema_of_variant(value)
    return F.coalesce(
        F.greatest(*(kind.startswith(k) for k in kinds), F.lit(False)), F.lit(False)
    )


def _field(raw: Column, path: str, *kinds: str) -> Column:
    """True where a field is absent, null, or of one of the given kinds."""
    value = F.try_variant_get(raw, f"$.{path}", "variant")
    return value.isNull() | _is_kind(value, "VOID", *kinds)


_NUMBER = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
_WHOLE = r"^\s*[+-]?[0-9]+(\.0*)?\s*$"
_TRUTH = ("true", "false", "t", "f", "yes", "no", "y", "n", "on", "off", "1", "0")


def _text_of(raw: Column, path: str) -> Column:
    return F.try_variant_get(raw, f"$.{path}", "string")


def _number(raw: Column, path: str, pattern: str = _NUMBER) -> Column:
    """Absent, null, a number, or a text that reads as one; whole numbers by ``_WHOLE``."""
    plain = _field(raw, path, "BIGINT", "DECIMAL", "DOUBLE", "STRING")
    value = F.try_variant_get(raw, f"$.{path}", "variant")
    return plain & (value.isNull() | _is_kind(value, "VOID") | _text_of(raw, path).rlike(pattern))


def _truth(raw: Column, path: str) -> Column:
    """Absent, a truth value, or a text or number that stands for one; null is refused."""
    value = F.try_variant_get(raw, f"$.{path}", "variant")
    named = F.lower(_text_of(raw, path)).isin(*_TRUTH)
    return value.isNull() | _is_kind(value, "BOOLEAN") | (
        _is_kind(value, "STRING", "BIGINT") & F.coalesce(named, F.lit(False))
    )


def raw_contents(body: Column, found: Column) -> Column:
    """The contents of a body's messages as they came, by the message's place as text; ``found`` are its spans."""
    own = F.filter(
        found,
        lambda s: (F.size(s["path"]) == 3) & (F.get(s["path"], F.lit(0)) == "messages") & (F.get(s["path"], F.lit(2)) == "content"),
    )
    return F.map_from_entries(F.transform(own, lambda s: F.struct(F.get(s["path"], F.lit(1)), js.cut(body, s["start"], s["end"]))))


def parse_requests(lines: DataFrame, body: str = "value", spans: str | None = None) -> DataFrame:
    """Typed fields next to ``raw`` (unknown fields stay there) and ``valid``.

    A message's ``content`` is JSON text cut out of the body, so lists keep the order of their members. The body's
    spans, which tell where everything stands, go into the column ``spans`` where it is named.
    """
    parsed = lines.withColumn("raw", F.try_parse_json(body)).withColumn(
        "_b", F.from_json(body, BODY)
    )
    # A member that is named twice leaves no VARIANT, and no spans either.
    read = parsed.withColumn("_read", F.when(F.col("raw").isNotNull(), F.col(body)))
    parsed = read.withColumn("_s", js.spans("_read"))
    raw = F.col("raw")
    messages = F.col("_b.messages")
    listed = F.try_variant_get(raw, "$.stop", "array<variant>")
    is_message = lambda m: (
        m["role"].isin(*ROLES)
        & (m["name"].isNull() | _is_kind(m["name"], "STRING", "VOID"))
        & (m["content"].isNull() | _is_kind(m["content"], "STRING", "ARRAY", "VOID"))
    )
    valid = (
        raw.isNotNull()
        & F.col("_s").isNotNull()
        & _is_kind(F.try_variant_get(raw, "$.model", "variant"), "STRING")
        & _is_kind(F.try_variant_get(raw, "$.messages", "variant"), "ARRAY")
        & F.coalesce(F.forall(messages, lambda m: F.coalesce(is_message(m), F.lit(False))), F.lit(False))
        & _number(raw, "temperature")
        & _number(raw, "top_p")
        & _number(raw, "max_tokens", _WHOLE)
        & _truth(raw, "stream")
        & _field(raw, "stop", "STRING", "ARRAY")
        & F.coalesce(F.forall(listed, lambda s: _is_kind(s, "STRING")), F.lit(True))
    )
    return parsed.select(
        *lines.columns,
        "raw",
        F.col("_b.model").alias("model"),
        let(raw_contents(F.col(body), F.col("_s")), lambda contents: F.transform(
            messages,
            lambda m, i: F.struct(
                m["role"],
                F.try_element_at(contents, i.cast("string")).alias("content"),
                F.try_variant_get(m["name"], "$", "string").alias("name"),
            ),
        )).alias("messages"),
        F.coalesce(F.lower(_text_of(raw, "stream")).isin("true", "t", "yes", "y", "on", "1"), F.lit(False)).alias("stream"),
        F.try_variant_get(raw, "$.temperature", "double").alias("temperature"),
        F.try_variant_get(raw, "$.top_p", "double").alias("top_p"),
        F.try_variant_get(raw, "$.max_tokens", "double").cast("int").alias("max_tokens"),
        F.col("_b.stop").alias("stop"),
        F.coalesce(valid, F.lit(False)).alias("valid"),
        *([F.col("_s").alias(spans)] if spans else []),
    )


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """A folder of JSON-lines request bodies."""
    return parse_requests(spark.read.text(path))
