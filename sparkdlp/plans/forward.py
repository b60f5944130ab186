"""From raw request bodies to the bodies that go upstream.

Messages and their parts are cut out of the body's text, exploded and scanned like any
text; what comes back is put in its place, so members that nobody here knows stay as
they came, in their order.  A body is one row, so its texts are gathered by request once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdlp.config import GuardConfig
from sparkdlp.functions import json_spans as js
from sparkdlp.functions.text import settle
from sparkdlp.operators.canary import instruction, merge_instruction, token
from sparkdlp.operators.requests import content_parts, scan_parts, with_texts
from sparkdlp.operators.rewrite import DEFAULT_MAX_TOKENS
from sparkdlp.sources.request_log import parse_requests

_LISTED = "array<struct<name:string,raw:string>>"


def _present(listed: Column) -> Column:
    """Without the members that are null."""
    return F.filter(listed, lambda m: m["raw"] != "null")


def _at(listed: Column, name: str) -> Column:
    return F.get(F.filter(listed, lambda m: m["name"] == name), F.lit(0))["raw"]


def sanitized_messages(parsed: DataFrame, cfg: GuardConfig = GuardConfig(), body: str = "value") -> DataFrame:
    """(request_id, messages): structs of role, kind, content and the members as they came, in their order.

    ``parsed`` are parsed bodies with their spans in ``_spans``.
    """
    rows = parsed.select("request_id", F.posexplode(js.elements(F.col(body), F.col("_spans"), "messages")).alias("msg_ix", "_m"))
    spanned = settle(rows.withColumn("_members", js.members(F.col("_m"), js.spans("_m"))), "_members")
    rows = spanned.select(
        "request_id", "msg_ix", js.text_of(_at(F.col("_members"), "role")).alias("role"),
        _at(F.col("_members"), "content").alias("content"), F.col("_members").alias("members"),
    )
    scanned = scan_parts(content_parts(rows.drop("members"), places=True), cfg).where("scan")
    texts = scanned.groupBy("request_id", "msg_ix").agg(
        F.collect_list(F.struct("start", "end", F.col("forwarded").alias("text"))).alias("_texts")
    )
    joined = rows.join(texts, ["request_id", "msg_ix"], "left")
    is_list, is_text = F.startswith("content", F.lit("[")), F.startswith("content", F.lit('"'))
    nothing = F.array().cast("array<struct<start:int,end:int,text:string>>")
    content = F.when(is_text, F.get("_texts", F.lit(0))["text"]).when(
        is_list, with_texts(F.col("content"), F.coalesce("_texts", nothing))
    )
    message = F.struct(
        "msg_ix",
        "role",
        F.when(is_text, "text").when(is_list, "parts").otherwise("none").alias("kind"),
        content.alias("content"),
        _present(F.col("members")).alias("members"),
    )
    return joined.groupBy("request_id").agg(F.array_sort(F.collect_list(message)).alias("messages"))


def _content(m: Column) -> Column:
    """A message's content as JSON text."""
    return F.when(m["kind"] == "parts", m["content"]).when(m["content"].isNotNull(), js.literal_of(m["content"]))


def _with_canary(messages: Column, request_id: Column, cfg: GuardConfig) -> tuple[Column, Column]:
    """The messages with the instruction, and their members in the same places."""
    plain = F.transform(messages, lambda m: F.struct(m["role"], m["kind"], m["content"]))
    merged = merge_instruction(plain, instruction(token(request_id, cfg.canary_secret))) if cfg.canary else plain
    members = F.transform(messages, lambda m: m["members"])
    none = F.array(F.array().cast(_LISTED))
    return merged, F.when(F.size(merged) > F.size(members), F.concat(none, members)).otherwise(members)


def _chat_message(m: Column, listed: Column) -> Column:
    named = js.with_raw(listed, "role", js.literal_of(m["role"]))
    content = _content(m)
    return js.object_of(F.when(content.isNull(), named).otherwise(js.with_raw(named, "content", content)))


def _list(raws: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(raws, ","), F.lit("]"))


def forwarded_bodies(lines: DataFrame, cfg: GuardConfig = GuardConfig(), body: str = "value") -> DataFrame:
    """(request_id, forwarded): the JSON that goes upstream for every valid body.

    ``lines`` hold request_id and the body's text. What nobody here changes goes on byte for byte: members and
    parts keep their order. Whether a request goes upstream at all is up to ``guard.outcomes``.  A request without
    messages keeps an empty list, or the canary's own message.
    """
    parsed = settle(parse_requests(lines, body, spans="_spans"), "valid", "_spans").where("valid")
    nothing = F.array().cast(f"array<struct<msg_ix:int,role:string,kind:string,content:string,members:{_LISTED}>>")
    joined = parsed.drop("messages").join(sanitized_messages(parsed, cfg, body), "request_id", "left")
    joined = joined.withColumn("messages", F.coalesce("messages", nothing))
    merged, listed = _with_canary(F.col("messages"), F.col("request_id"), cfg)
    joined = settle(joined.withColumns({"_m": merged, "_b": listed}), "_m", "_b")
    if cfg.provider == "anthropic":
        out = _messages_body(joined)
    else:
        own = js.members(F.col(body), F.col("_spans"))
        known = js.with_raw(_present(own), "messages", _list(F.zip_with("_m", "_b", _chat_message)))
        out = js.object_of(js.with_raw(known, "stream", F.col("stream").cast("string")))
    return joined.select("request_id", out.alias("forwarded"))


def _messages_body(joined: DataFrame) -> Column:
    systems = F.filter("_m", lambda m: m["role"] == "system")
    system = F.array_join(F.filter(F.transform(systems, lambda m: m["content"]), lambda t: t != ""), "\n\n")
    turns = F.transform(
        F.filter("_m", lambda m: m["role"] != "system"),
        lambda m: F.concat(
            F.when(m["role"] == "assistant", '{"role":"assistant","content":').otherwise('{"role":"user","content":'),
            F.coalesce(_content(m), F.lit('""')),
            F.lit("}"),
        ),
    )
    one = F.try_variant_get("stop", "$", "string")
    stops = F.coalesce(F.try_variant_get("stop", "$", "array<string>"), F.when(one.isNotNull(), F.array(one)))
    rest = F.to_json(
        F.struct(
            "model",
            F.coalesce(F.nullif("max_tokens", F.lit(0)), F.lit(DEFAULT_MAX_TOKENS)).alias("max_tokens"),
            "stream",
            F.when(F.size(systems) > 0, system).alias("system"),
            "temperature",
            "top_p",
            stops.alias("stop_sequences"),
        )
    )
    return F.concat(F.lit('{"messages":'), _list(turns), F.lit(","), F.substring(rest, F.lit(2), F.length(rest)))
