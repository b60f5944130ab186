"""Scan and release of streamed answers, over a log of ordered chunks.

What is scanned and released at a chunk depends only on the chunk and on the last
``buffer`` characters before it, so this is a stencil over the ordered chunks, not
a fold: every chunk holds at least one character or resets the buffer, hence
``lookback`` preceding chunks always suffice.  Chunks are laid out in blocks of
``BLOCK`` per request; a block needs only the few characters its predecessors
carry into it, so a request with very many chunks is spread over many tasks.  Only
"where does the stream stop" is global, and that is a minimum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkdlp.config import GuardConfig
from sparkdlp.functions import sqltext as sql
from sparkdlp.functions.text import settle
from sparkdlp.operators.canary import leaks, with_token
from sparkdlp.operators.output import LEAK_REASON, finish_reason
from sparkdlp.operators.redact import has_secret, redact

BLOCK = 1024
SECRET_REASON = "secret_detected_in_output_stream"

_KEYS = ("request_id", "_block")


def _block_facts(
    rows: DataFrame, lookback: int, resets: bool, tokens: DataFrame | str | None
) -> DataFrame:
    """Per (request, block): ``_carry``, ``token``, ``_more`` and ``_many``.

    ``_carry`` is the text that earlier blocks hold back for this one, ``_more``
    tells whether later blocks exist and ``_many`` whether any other does.
    """
    # Only a block's last ``lookback`` chunks can reach into the next block.
    tail = F.right("text_delta", F.lit(lookback)).alias("text_delta")
    chunk = F.struct("seq", "is_control", tail)
    counts = F.lit(True) if resets else ~F.col("is_control")
    blocks = rows.groupBy(*_KEYS).agg(
        F.array_sort(F.collect_list(F.when(counts, chunk))).alias("_chunks"),
        (F.bool_or("is_control") & F.lit(resets)).alias("_reset"),
    )
    last = F.slice("_chunks", F.greatest(F.size("_chunks") - lookback, F.lit(0)) + 1, lookback)
    suffix = F.aggregate(
        last,
        F.lit(""),
        lambda acc, c: F.when(c["is_control"], F.lit("")).otherwise(
            F.right(F.concat(acc, c["text_delta"]), F.lit(lookback))
        ),
    )
    blocks = blocks.select(
        *_KEYS, "_reset", F.when(F.size("_chunks") > 0, suffix).alias("_suffix")
    )
    in_order = Window.partitionBy("request_id").orderBy("_block")
    # A block of text without a reset holds a character per chunk, so no more of
    # them than characters can matter; blocks that carry nothing are stepped over.
    earlier = Window.partitionBy("request_id", F.col("_suffix").isNull()).orderBy("_block")
    states = F.collect_list(F.struct("_reset", "_suffix")).over(earlier.rowsBetween(-lookback, -1))
    carry = F.aggregate(
        states,
        F.lit(""),
        lambda acc, s: F.when(s["_reset"], s["_suffix"]).otherwise(
            F.right(F.concat(acc, s["_suffix"]), F.lit(lookback))
        ),
    )
    facts = blocks.select(
        *_KEYS,
        F.when(F.col("_suffix").isNotNull(), carry).otherwise(F.lit("")).alias("_carry"),
        F.lead("_block").over(in_order).isNotNull().alias("_more"),
        F.lag("_block").over(in_order).isNotNull().alias("_follows"),
    )
    facts = facts.withColumn("_many", F.col("_more") | F.col("_follows")).drop("_follows")
    if tokens is None:
        return facts.withColumn("token", F.lit(None).cast("string"))
    return with_token(facts, tokens)


def _preceding_text(rows: DataFrame, lookback: int, resets: bool) -> DataFrame:
    """``_before``: the last ``lookback`` characters ahead of each chunk.

    With ``resets`` a control chunk empties what came before it.
    """
    if resets:
        # A control chunk closes its segment, so it still sees the text before it.
        in_block = Window.partitionBy(*_KEYS).orderBy("seq")
        closed = F.sum(F.col("is_control").cast("int")).over(
            in_block.rowsBetween(Window.unboundedPreceding, -1)
        )
        rows = rows.withColumn("_segment", F.coalesce(closed, F.lit(0)))
        segment = Window.partitionBy(*_KEYS, "_segment")
    else:
        # Control chunks are passed over.
        rows = rows.withColumn("_segment", F.lit(0))
        segment = Window.partitionBy(*_KEYS, "is_control")
    frame = segment.orderBy("seq").rowsBetween(-lookback, -1)
    # No chunk can hand on more than its last characters, so only those are gathered.
    local = F.array_join(F.collect_list(F.right("text_delta", F.lit(lookback))).over(frame), "")
    carried = F.when(F.col("_segment") == 0, F.concat("_carry", "_local")).otherwise(
        F.col("_local")
    )
    return (
        rows.withColumn("_local", local)
        .withColumn("_before", F.right(carried, F.lit(lookback)))
        .drop("_local", "_carry", "_segment")
    )


def _judge(rows: DataFrame, cfg: GuardConfig) -> DataFrame:
    """``_raw`` (what a chunk would release) and ``reason`` (why it must not)."""
    buffer, strict = cfg.buffer_chars, cfg.strict_streaming
    seen = _preceding_text(rows, buffer if strict else 2 * buffer, strict)
    joined = F.concat("_before", "text_delta")
    if strict:
        looked_at = joined
        raw = F.when(F.col("is_control"), F.col("_before")).otherwise(
            F.left(joined, F.greatest(F.length(joined) - buffer, F.lit(0)))
        )
    else:
        looked_at = F.when(F.col("is_control"), F.lit("")).otherwise(
            F.right(joined, F.lit(2 * buffer))
        )
        raw = F.col("text_delta")
    seen = seen.withColumns({"_look": looked_at, "_raw": raw})
    secret = (
        F.expr(has_secret("_look", sql.fold("_look"))) if cfg.output_secret_scan else F.lit(False)
    )
    reason = F.when(leaks(F.col("_look"), F.col("token")), F.lit(LEAK_REASON)).when(
        secret, F.lit(SECRET_REASON)
    )
    judged = seen.withColumn("reason", reason).drop("_look", "_before", "text_delta", "token")
    return settle(judged, "_raw", "reason")


_ENDS = "reason IS NOT NULL OR is_done"
_NAMES = "is_control AND NOT is_done AND finish_reason <> ''"


def scan_chunks(
    chunks: DataFrame,
    canaries: DataFrame | str | None,
    cfg: GuardConfig = GuardConfig(),
) -> DataFrame:
    """(request_id, seq, release, blocked, reason, finish) up to where a stream stops.

    ``finish`` is the finish reason sent to the client at that chunk, if any.
    """
    lookback = cfg.buffer_chars if cfg.strict_streaming else 2 * cfg.buffer_chars
    control = "is_done OR text_delta = ''"
    rows = chunks.select(
        "request_id",
        "seq",
        F.coalesce("text_delta", F.lit("")).alias("text_delta"),
        F.coalesce("is_done", F.lit(False)).alias("is_done"),
        "finish_reason",
        F.floor(F.col("seq") / BLOCK).alias("_block"),
    ).withColumns(
        {
            "is_control": F.expr(control),
            "text_delta": F.expr(f"if({control}, '', text_delta)"),
        }
    )
    tokens = canaries if cfg.canary else None
    known = _block_facts(rows, lookback, cfg.strict_streaming, tokens)
    rows = rows.join(known, list(_KEYS))
    judged = _judge(rows, cfg)

    # Stops within a block come from a window on the layout at hand.  Stops in
    # earlier blocks exist only for requests of more than one block; their blocks
    # are judged a second time, for the two minima alone.
    firsts = (
        _judge(rows.where("_more"), cfg)
        .groupBy(*_KEYS)
        .agg(
            F.expr(f"min(if({_ENDS}, seq, NULL))").alias("_end"),
            F.expr(f"min(if({_NAMES}, seq, NULL))").alias("_name"),
        )
    )
    before = (
        Window.partitionBy("request_id")
        .orderBy("_block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    earlier = (
        known.where("_many")
        .select(*_KEYS)
        .join(firsts, list(_KEYS), "left")
        .select(
            *_KEYS,
            F.min("_end").over(before).alias("_end0"),
            F.min("_name").over(before).alias("_name0"),
        )
        .where("_end0 IS NOT NULL OR _name0 IS NOT NULL")
    )
    block = Window.partitionBy(*_KEYS)
    bounded = judged.withColumns(
        {
            "_end": F.expr(f"if({_ENDS}, seq, NULL)"),
            "_name": F.expr(f"if({_NAMES}, seq, NULL)"),
        }
    ).withColumns({"_end": F.min("_end").over(block), "_name": F.min("_name").over(block)})
    bounded = bounded.join(earlier, list(_KEYS), "left")
    stop, named = F.least("_end0", "_end"), F.least("_name0", "_name")
    live = bounded.withColumns({"_stop": stop, "_named": named}).where(
        "_stop IS NULL OR seq <= _stop"
    )
    blocked = F.col("reason").isNotNull()
    finish = F.when(
        F.col("is_done") & (F.col("_named").isNull() | (F.col("_named") > F.col("seq"))),
        F.coalesce(F.nullif(F.col("finish_reason"), F.lit("")), F.lit("stop")),
    ).when(F.col("seq") == F.col("_named"), F.col("finish_reason"))
    live = live.select(
        "request_id",
        "seq",
        F.when(blocked, F.lit("")).otherwise(F.col("_raw")).alias("_raw"),
        blocked.alias("blocked"),
        "reason",
        F.when(~blocked, finish).alias("finish"),
    )
    if not cfg.output_secret_scan:
        return live.withColumnRenamed("_raw", "release")
    kept = ("request_id", "seq", "release", "blocked", "reason", "finish")
    return redact(live, "_raw", "release", "_found").select(*kept)


def client_finish(finish: Column, provider: str) -> Column:
    """Finish reason as it is encoded for the client; unknown ones are null."""
    return finish_reason(finish, None) if provider == "anthropic" else finish


def chunk_outcome(released: DataFrame) -> DataFrame:
    """One decision per streamed request; a secret counts as a leak too."""
    return released.groupBy("request_id").agg(
        F.when(F.bool_or("blocked"), F.lit("blocked_canary_leak"))
        .otherwise(F.lit("allowed"))
        .alias("decision"),
        F.max("reason").alias("reason"),
        F.sum(F.length("release")).cast("bigint").alias("released_chars"),
    )


def _cells(rows: DataFrame, text: str, size: int) -> DataFrame:
    """(request_id, cell, piece): ordered texts cut anew every ``size`` characters.

    Offsets are summed per block and then over the blocks, so no task holds a
    whole request.
    """
    sized = rows.select(
        "request_id",
        F.floor(F.col("seq") / BLOCK).alias("_block"),
        "seq",
        F.coalesce(F.col(text), F.lit("")).alias("_t"),
    ).withColumn("_n", F.length("_t").cast("bigint"))
    before = Window.partitionBy(*_KEYS).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    local = sized.withColumn("_at", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    earlier = Window.partitionBy("request_id").orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    bases = (
        sized.groupBy(*_KEYS)
        .agg(F.sum("_n").alias("_total"))
        .select(*_KEYS, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_base"))
    )
    placed = local.join(bases, list(_KEYS)).withColumn("_at", F.col("_at") + F.col("_base"))
    placed = placed.where(F.col("_n") > 0).withColumn(
        "cell",
        F.explode(
            F.sequence(
                F.floor(F.col("_at") / size), F.floor((F.col("_at") + F.col("_n") - 1) / size)
            )
        ),
    )
    start = F.greatest(F.col("cell") * size - F.col("_at"), F.lit(0))
    stop = F.least((F.col("cell") + 1) * size - F.col("_at"), F.col("_n"))
    piece = F.substring(F.col("_t"), (start + 1).cast("int"), (stop - start).cast("int"))
    ordered = F.array_sort(F.collect_list(F.struct("seq", piece.alias("t"))))
    return placed.groupBy("request_id", "cell").agg(
        F.array_join(F.transform(ordered, lambda c: c["t"]), "").alias("piece")
    )


def chunk_lossless(chunks: DataFrame, released: DataFrame, cell: int = 4096) -> DataFrame:
    """Per request: did the client get exactly the text that came in?"""
    keys = ["request_id", "cell"]
    sent = _cells(chunks, "text_delta", cell)
    got = _cells(released, "release", cell).withColumnRenamed("piece", "got")
    compared = sent.join(got, keys, "full").select(
        "request_id",
        F.col("piece").eqNullSafe(F.col("got")).alias("same"),
    )
    empty = chunks.select("request_id", F.lit(True).alias("same"))
    return compared.unionByName(empty).groupBy("request_id").agg(
        F.bool_and("same").alias("lossless")
    )


def split_into_chunks(texts: DataFrame, size: int, text: str = "text") -> DataFrame:
    """Texts as logs of ``size``-character chunks with a done chunk at the end."""
    # One walk over the text; the pieces hold a character at least, the one behind them none.
    cut = F.concat(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)), F.array(F.lit("")))
    pieces = texts.select("request_id", F.posexplode(cut).alias("_i", "text_delta"))
    last = F.col("text_delta") == ""
    return pieces.select(
        "request_id",
        F.col("_i").cast("bigint").alias("seq"),
        "text_delta",
        last.alias("is_control"),
        last.alias("is_done"),
        F.lit(None).cast("string").alias("finish_reason"),
    )
