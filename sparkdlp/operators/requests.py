"""Requests: parts, per-part scan, and the roll-up to one row per request.

A request is one input row.  Its parts are exploded without a shuffle, scanned in
the same stage, and only short facts (bits, counts, labels) are shuffled to be
merged.  The merge goes over blocks of ``BLOCK`` messages first, so a request that
holds a large share of all rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import VariantType

from sparkdlp.config import GuardConfig
from sparkdlp.functions import json_spans as js
from sparkdlp.functions import sqltext as sql
from sparkdlp.functions.text import settle
from sparkdlp.operators import score as S
from sparkdlp.operators.audit import merge_summaries, preview_summary, summary_preview
from sparkdlp.operators.inject import scan_text

BLOCK = 1024
PARTS = "array<struct<text:string,scan:boolean,start:int,end:int>>"
SCORED_ROLES = ("user", "system")


def message_explode(requests: DataFrame) -> DataFrame:
    """One row per message, in order."""
    return requests.select("request_id", F.posexplode("messages").alias("msg_ix", "m")).select(
        "request_id", "msg_ix", "m.role", "m.content", "m.name"
    )


def _raw(messages: DataFrame) -> Column:
    """The content as JSON text; a VARIANT gives its members in name order, since it keeps no other."""
    content = F.col("content")
    return F.to_json(content) if isinstance(messages.schema["content"].dataType, VariantType) else content


def _begins(raw: Column, mark: str) -> Column:
    return F.startswith(F.ltrim(raw, F.lit(" \t\r\n")), F.lit(mark))


def text_parts(name: str) -> Column:
    """The text parts of a column of JSON contents: text, scan, and the bytes of the string they stand in.

    A list's parts come as a reader takes them: a part's own text first, then what its members nest, in input
    order. Lists nest to any depth. A dict that a part holds is searched for findings but is neither redacted nor
    scored, so its text carries ``scan=False``; what such a dict holds is not read.
    """
    raw = F.col(name)
    place = lambda s: F.struct(s["places"], s["start"], s["end"], F.endswith(s["within"], F.lit("{{")).alias("dict"))

    def listed(found: Column) -> Column:
        texts = F.filter(
            found,
            lambda s: (s["kind"] == "string")
            & (F.try_element_at(s["path"], F.lit(-1)) == "text")
            & s["within"].rlike(r"^(\[\{)+\{?$"),
        )
        return F.transform(
            F.array_sort(F.transform(texts, place)),
            lambda p: F.struct(
                js.text_of(js.cut(raw, p["start"], p["end"])).alias("text"), (~p["dict"]).alias("scan"),
                p["start"].alias("start"), p["end"].alias("end"),
            ),
        )

    before = F.octet_length(raw) - F.octet_length(F.ltrim(raw, F.lit(" \t\r\n")))
    single = F.struct(
        js.text_of(F.trim(raw, F.lit(" \t\r\n"))).alias("text"), F.lit(True).alias("scan"),
        before.alias("start"), F.octet_length(F.rtrim(raw, F.lit(" \t\r\n"))).alias("end"),
    )
    in_list = js.spans(rf"if(TRIM(LEADING ' \t\r\n' FROM {name}) LIKE '[%', {name}, NULL)")
    return F.when(_begins(raw, '"'), F.array(single).cast(PARTS)).otherwise(listed(in_list).cast(PARTS))


def content_parts(messages: DataFrame, places: bool = False) -> DataFrame:
    """One row per text part of every message; ``content`` is JSON text, or a VARIANT.

    With ``places`` also the start and end of the part's string in the content, in bytes.
    """
    keep = [c for c in messages.columns if c not in ("content", "name")]
    raw = settle(messages.select(*keep, _raw(messages).alias("_raw")), "_raw")
    parts = raw.select(*keep, F.posexplode(text_parts("_raw")).alias("part_ix", "p"))
    return parts.select(*keep, "part_ix", "p.text", "p.scan", *(["p.start", "p.end"] if places else []))


def with_texts(raw: Column, texts: Column) -> Column:
    """A JSON content with some of its strings replaced in place; ``texts`` (start, end, text) in any order."""
    edits = F.transform(F.array_sort(texts), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), js.literal_of(t["text"]).alias("new")))
    return js.splice(raw, edits)


def sanitize_contents(messages: DataFrame, sanitizer: Callable[[Column], Column]) -> DataFrame:
    """Messages with ``kind`` (text, parts, none) and sanitized ``content`` text.

    Contents of kind ``parts`` are the JSON lists as they came, in which every scanned text went through
    ``sanitizer``; dicts nested in a part are left as they are.
    """
    others = [c for c in messages.columns if c != "content"]
    raw = settle(messages.select(*others, _raw(messages).alias("_raw")), "_raw")
    found = settle(raw.withColumn("_parts", text_parts("_raw")), "_parts")
    is_text, is_list = _begins(F.col("_raw"), '"'), _begins(F.col("_raw"), "[")
    edits = F.transform(
        F.filter("_parts", lambda p: p["scan"]),
        lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), sanitizer(p["text"]).alias("text")),
    )
    edited = settle(found.withColumn("_edits", edits), "_edits")
    kind = F.when(is_text, "text").when(is_list & F.col("_parts").isNotNull(), "parts").otherwise("none")
    return edited.select(
        *others,
        kind.alias("kind"),
        F.when(is_text, F.get("_edits", F.lit(0))["text"]).when(is_list, with_texts(F.col("_raw"), F.col("_edits"))).alias("content"),
    )


def parts_of_turns(turns: DataFrame, request: str = "conv_id", order: str = "turn") -> DataFrame:
    """Parts of a turn-per-row table with plain text contents."""
    return turns.select(
        F.col(request).alias("request_id"),
        F.col(order).alias("msg_ix"),
        F.lit(0).alias("part_ix"),
        "role",
        "text",
        F.lit(True).alias("scan"),
    )


def scan_parts(parts: DataFrame, cfg: GuardConfig = GuardConfig()) -> DataFrame:
    """Layer one on every part; ``scored_text`` is what the score looks at."""
    scanned = scan_text(parts, "text", cfg.decode_evasions)
    forwarded = F.col("sanitized") if cfg.redacts else F.col("text")
    shown = F.col("normalized") if cfg.score_on == "normalized" else forwarded
    scored = F.col("scan") & F.col("role").isin(*SCORED_ROLES)
    return scanned.withColumns(
        {"forwarded": forwarded, "scored_text": F.when(scored, shown)}
    )


def ordered_text(parts: DataFrame, column: str = "forwarded") -> DataFrame:
    """Texts of user and system parts in order, joined by line breaks.

    The result holds each request's whole text in one row; scores do not need it.
    """
    kept = parts.where(F.col("scan") & F.col("role").isin(*SCORED_ROLES))
    pieces = F.array_sort(F.collect_list(F.struct("msg_ix", "part_ix", F.col(column).alias("t"))))
    return kept.groupBy("request_id").agg(
        F.array_join(F.transform(pieces, lambda p: p["t"]), "\n").alias("scan_text")
    )


def with_features(parts: DataFrame, text: str = "scored_text") -> DataFrame:
    """Mergeable score facts per part; null text gives neutral facts."""
    x = f"`{text}`"
    step = parts.withColumn("_fold", F.expr(sql.fold(x)))

    def fact(value: str, neutral: str) -> Column:
        return F.expr(f"if({x} IS NULL, {neutral}, {value})")

    facts = step.withColumns(
        {
            "f_mask": fact(S.feature_mask(x, "_fold"), "0"),
            "f_letters": fact(S.letters(x), "0"),
            "f_capitals": fact(S.capitals(x), "0"),
            "f_edge": fact(S.edge(x, "_fold"), "NULL"),
        }
    ).drop("_fold")
    return settle(facts, "f_mask", "f_letters", "f_capitals", "f_edge")


def _in_order(value: Column) -> Column:
    return F.array_sort(F.collect_list(value))


def merge_features(featured: DataFrame, *extra: tuple[Column, Column]) -> DataFrame:
    """Score per request from part facts, in two levels.

    ``extra`` pairs are (block-level, request-level) aggregates carried along.
    """
    blocks = (
        featured.withColumn("_block", F.floor(F.col("msg_ix") / BLOCK))
        .groupBy("request_id", "_block")
        .agg(
            F.bit_or("f_mask").alias("f_mask"),
            F.sum("f_letters").alias("f_letters"),
            F.sum("f_capitals").alias("f_capitals"),
            _in_order(
                F.when(
                    F.col("f_edge").isNotNull(), F.struct("msg_ix", "part_ix", "f_edge")
                )
            ).alias("_edges"),
            *(b for b, _ in extra),
        )
        .withColumn(
            "f_edge",
            F.when(
                F.size("_edges") > 0,
                S.squeeze_edges(F.array_join(F.col("_edges")["f_edge"], "\n")),
            ),
        )
        .drop("_edges")
    )
    merged = blocks.groupBy("request_id").agg(
        F.bit_or("f_mask").alias("_mask"),
        F.sum("f_letters").alias("_letters"),
        F.sum("f_capitals").alias("_capitals"),
        _in_order(
            F.when(F.col("f_edge").isNotNull(), F.struct("_block", "f_edge"))
        ).alias("_edges"),
        *(r for _, r in extra),
    )
    crossing = S.crossing_mask(F.array_join(F.col("_edges")["f_edge"], "\n"))
    mask = F.col("_mask").bitwiseOR(crossing)
    return merged.withColumn(
        "score", S.combine(mask, F.col("_letters"), F.col("_capitals"))
    ).drop("_mask", "_letters", "_capitals", "_edges")


def score_requests(parts: DataFrame, text: str = "scored_text") -> DataFrame:
    """(request_id, score) of the ordered user and system text, without joining it."""
    return merge_features(
        with_features(parts.select("request_id", "msg_ix", "part_ix", text), text)
    )


def rollup(scanned: DataFrame, preview_chars: int = 120) -> DataFrame:
    """One row per request: flags, labels and signals in match order, score, preview.

    Only parts that found something put a row into the ordered lists.
    """
    kinds = F.col("findings")["kind"]
    noted = F.when(
        (F.size("findings") > 0) | (F.size("signals") > 0),
        F.struct("msg_ix", "part_ix", "findings", "signals"),
    )
    featured = with_features(
        scanned.select(
            "request_id", "msg_ix", "part_ix", "scored_text", "inj_hit",
            F.array_contains(kinds, "secret").alias("has_secret"),
            F.array_contains(kinds, "pii").alias("has_pii"),
            noted.alias("noted"),
            F.when(
                F.col("scored_text").isNotNull(),
                preview_summary(
                    F.replace(F.col("forwarded"), F.lit("\n"), F.lit(" ")), preview_chars
                ),
            ).alias("shown"),
        )
    )
    merged = merge_features(
        featured,
        (F.bool_or("inj_hit").alias("inj_hit"), F.bool_or("inj_hit").alias("inj_hit")),
        (F.bool_or("has_secret").alias("has_secret"), F.bool_or("has_secret").alias("has_secret")),
        (F.bool_or("has_pii").alias("has_pii"), F.bool_or("has_pii").alias("has_pii")),
        (F.collect_list("noted").alias("noted"), F.flatten(F.collect_list("noted")).alias("noted")),
        (
            merge_summaries(
                F.struct("msg_ix", "part_ix"), F.col("shown"), preview_chars
            ).alias("shown"),
            merge_summaries(F.col("_block"), F.col("shown"), preview_chars).alias("shown"),
        ),
    )
    notes = F.array_sort("noted")

    def labels(kind: str) -> Column:
        found = F.filter(F.flatten(F.col("_notes")["findings"]), lambda f: f["kind"] == kind)
        return F.transform(found, lambda f: f["label"])

    return (
        merged.withColumn("_notes", notes)
        .withColumns(
            {
                "secret_findings": labels("secret"),
                "pii_findings": labels("pii"),
                "injection_findings": labels("injection_heuristic"),
                "evasion_signals": F.flatten(F.col("_notes")["signals"]),
                "prompt_preview": F.coalesce(
                    summary_preview(F.col("shown"), preview_chars), F.lit("")
                ),
            }
        )
        .drop("noted", "_notes", "shown")
    )
