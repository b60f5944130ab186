"""Injection scores.

A score needs only a few facts about a text (``features``), and those facts merge:
bits are ORed and letters are added.  A request's score is therefore an aggregate
over its parts, and no text has to travel to be joined into one string.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkdlp.functions import patterns as P
from sparkdlp.functions.patterns import SPACE, java_form
from sparkdlp.functions import sqltext as sql
from sparkdlp.functions.text import matches, settle
from sparkdlp.operators.inject import N_PHRASES, PHRASE_BITS, phrase_mask

# --- fixed values: weights of the heuristic score -----------------------------
PHRASE_WEIGHT, MAX_PHRASES = 0.35, 3
ROLEPLAY_WEIGHT = 0.15
IMPERATIVE_WEIGHT = 0.15
PUNCTUATION_WEIGHT = 0.05
SHOUT_WEIGHT, SHOUT_MIN_LETTERS, SHOUT_SHARE = 0.08, 20, 0.6
# ------------------------------------------------------------------------------

_ROLEPLAY, _IMPERATIVE, _PUNCTUATION = (1 << (N_PHRASES + i) for i in range(3))

# The phrases that may run across the line break between two parts.
_CROSSING = [i for i, p in enumerate(P.INJECTION_PATTERNS) if r"\s*" in p]
_EDGE_WORDS = ("override", "mode", "system", "dan", "developer", "prompt")
_HEAD = java_form(r"(?i)\A\s*(prompt\s*override|override|mode\b)")
_TAIL = java_form(r"(?i)(system\s*prompt|system|\bDAN|\bdeveloper)\s*\z")
_ONLY_PROMPT = rf"(?iu)\A{SPACE}*prompt{SPACE}*\z"
_INERT = "|"


def feature_mask(x: str, folded: str) -> str:
    """SQL text: phrase bits plus the role-play, imperative and punctuation bits."""
    bits = (
        f"if({sql.gate(g, x, folded)} AND {sql.matches(p, x)}, {bit}, 0)"
        for bit, p, g in (
            (_ROLEPLAY, P.ROLEPLAY_PATTERN, P.ROLEPLAY_GATE),
            (_IMPERATIVE, P.IMPERATIVE_PATTERN, P.IMPERATIVE_GATE),
            (_PUNCTUATION, P.PUNCTUATION_PATTERN, P.PUNCTUATION_GATE),
        )
    )
    return f"({phrase_mask(x, folded)} | {' | '.join(bits)})"


def edge(x: str, folded: str) -> str:
    """SQL text: what a part can give to a phrase that crosses its first or last line.

    Empty for a blank part, ``|`` for a part that gives nothing, else the words at
    its edges around a ``|``.
    """
    live = " OR ".join(f"contains({folded}, '{word}')" for word in _EDGE_WORDS)
    visible = sql.raw(SPACE.replace("[", "[^", 1))
    return (
        f"CASE WHEN NOT {x} RLIKE {visible} THEN '' WHEN NOT ({live}) THEN '{_INERT}' "
        f"WHEN {x} RLIKE {sql.raw(_ONLY_PROMPT)} THEN 'prompt' "
        f"ELSE concat(regexp_extract({x}, {sql.raw(_HEAD)}, 1), '{_INERT}', "
        f"regexp_extract({x}, {sql.raw(_TAIL)}, 1)) END"
    )


def squeeze_edges(edges: Column) -> Column:
    """Runs of parts that give nothing, as one."""
    return F.regexp_replace(edges, r"\|[|\n]*\|", _INERT)


def crossing_mask(edges: Column) -> Column:
    """Phrase bits found across part borders in line-joined, ordered edges."""
    mask = F.lit(0)
    for i in _CROSSING:
        hit = matches(P.INJECTION_PATTERNS[i], edges)
        mask = mask.bitwiseOR(F.when(hit, F.lit(1 << i)).otherwise(F.lit(0)))
    return F.when(edges.isNull() | (F.length(edges) < 6), F.lit(0)).otherwise(mask)


def letters(x: str) -> str:
    return f"length(regexp_replace({x}, r'[^\\p{{L}}]+', ''))"


def capitals(x: str) -> str:
    return f"length(regexp_replace({x}, r'[^\\p{{Lu}}]+', ''))"


def phrase_count(mask: Column) -> Column:
    return F.bit_count(mask.bitwiseAND(F.lit(PHRASE_BITS)))


def combine(mask: Column, n_letters: Column, n_capitals: Column) -> Column:
    """The score from merged features, adding in the fixed order."""

    def weight(condition: Column, value: float) -> Column:
        return F.when(condition, F.lit(value)).otherwise(F.lit(0.0))

    def bit(b: int) -> Column:
        return mask.bitwiseAND(F.lit(b)) != 0

    shouting = (n_letters > SHOUT_MIN_LETTERS) & (
        n_capitals / F.greatest(n_letters, F.lit(1)) > SHOUT_SHARE
    )
    total = (
        F.least(phrase_count(mask), F.lit(MAX_PHRASES)) * F.lit(PHRASE_WEIGHT)
        + weight(bit(_ROLEPLAY), ROLEPLAY_WEIGHT)
        + weight(bit(_IMPERATIVE), IMPERATIVE_WEIGHT)
        + weight(bit(_PUNCTUATION), PUNCTUATION_WEIGHT)
        + weight(shouting, SHOUT_WEIGHT)
    )
    return F.greatest(F.lit(0.0), F.least(total, F.lit(1.0)))


def heuristic_score(df: DataFrame, text: str = "text", out: str = "score") -> DataFrame:
    """Score of each row's text; empty and null texts score 0."""
    keep = [c for c in df.columns if c != out]
    t = F.coalesce(F.col(text), F.lit(""))
    step = df.select(*keep, t.alias("_t")).withColumn("_fold", F.expr(sql.fold("_t")))
    step = step.withColumns(
        {
            "_mask": F.expr(feature_mask("_t", "_fold")),
            "_letters": F.expr(letters("_t")),
            "_capitals": F.expr(capitals("_t")),
        }
    )
    return settle(step.drop("_t", "_fold"), "_mask", "_letters", "_capitals").select(
        *keep, combine(F.col("_mask"), F.col("_letters"), F.col("_capitals")).alias(out)
    )


def softmax_probability(logits: Column) -> Column:
    """Probability of the injection class: index 1, or index 0 of a single output."""
    weights = F.transform(logits, lambda x: F.exp(x.cast("double") - F.array_max(logits)))
    total = F.aggregate(weights, F.lit(0.0), lambda acc, x: acc + x)
    return F.coalesce(F.get(weights, F.lit(1)), F.get(weights, F.lit(0))) / total


Scorer = Callable[[pd.Series], pd.Series]
#: Texts that a scorer is given at a time; a batch of Arrow holds up to ten times as many.
STEP = 1000


def model_score(
    df: DataFrame, factory: Callable[[], Scorer], text: str = "text", out: str = "score"
) -> DataFrame:
    """Scores by a model that ``factory`` loads once in each task and that is given ``STEP`` texts at most.

    Texts stay in Arrow's buffers until their turn, so a task holds one batch and the Python texts of one step.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = factory()
        for batch in batches:
            for at in range(0, len(batch), STEP):
                texts = batch.slice(at, STEP).to_pandas().fillna("")
                yield pa.Array.from_pandas(scorer(texts), type=pa.float64(), safe=False)

    run = F.arrow_udf(run, "double")

    return df.withColumn(out, run(F.col(text)))


def score(
    df: DataFrame,
    backend: str = "auto",
    factory: Callable[[], Scorer] | None = None,
    text: str = "text",
    out: str = "score",
) -> DataFrame:
    """``auto`` takes the model when there is one; ``onnx`` insists on it."""
    if backend == "onnx" and factory is None:
        raise RuntimeError("classifier 'onnx' needs a model; use 'auto' to fall back")
    if backend == "heuristic" or factory is None:
        return heuristic_score(df, text, out)
    return model_score(df, factory, text, out)


def at_or_above(threshold: float, column: str = "score") -> Column:
    return F.col(column) >= F.lit(float(threshold))


def threshold_sweep(scored: DataFrame, thresholds: list[float], margin: float = 0.05) -> DataFrame:
    """Rows blocked, and rows within ``margin``, for each candidate threshold.

    One pass: every threshold is a pair of counters of a single aggregation.
    """
    counters = F.array(
        *(
            F.struct(
                F.lit(float(t)).alias("threshold"),
                F.count_if(F.col("score") >= F.lit(float(t))).alias("blocked"),
                F.count_if(F.abs(F.col("score") - F.lit(float(t))) <= F.lit(margin)).alias(
                    "borderline"
                ),
                F.count(F.lit(1)).alias("total"),
            )
            for t in thresholds
        )
    )
    return scored.agg(counters.alias("c")).select(F.inline("c"))


def threshold_curve(scored: DataFrame, label: str = "label", score: str = "score", buckets: int = 4096) -> DataFrame:
    """What every score that occurs would give as the threshold: one row per distinct score.

    ``flagged`` rows score at least as much; of those with a label ``hits`` are true and ``false_alarms`` are not,
    ``missed`` are true and score less. ``precision`` and ``recall`` are null where nothing is counted. Rows without
    a score (null or NaN) are left out, rows without a label count as flagged only.

    The running sums go over a histogram: within equal-width buckets of scores in parallel, and over the buckets'
    totals, of which there are never more than ``buckets``.
    """
    value, truth = F.col(score).cast("double"), F.col(label).cast("boolean")
    sums = ("flagged", "hits", "false_alarms")
    counts = (F.count(F.lit(1)), F.count_if(truth), F.count_if(~truth))
    steps = (
        scored.where(value.isNotNull() & ~F.isnan(value))
        .groupBy(value.alias("threshold"))
        .agg(*(c.alias(name) for c, name in zip(counts, sums)))
        .withColumn("_bucket", F.least(F.greatest(F.floor(F.col("threshold") * buckets), F.lit(0)), F.lit(buckets - 1)))
    )
    totals = steps.groupBy("_bucket").agg(*(F.sum(c).alias(f"_{c}") for c in sums))
    above = Window.orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "_bucket",
        F.sum("_hits").over(Window.partitionBy()).alias("_true"),
        *(F.coalesce(F.sum(f"_{c}").over(above), F.lit(0)).alias(f"_{c}") for c in sums),
    )
    here = Window.partitionBy("_bucket").orderBy(F.desc("threshold"))
    running = steps.select("threshold", "_bucket", *(F.sum(c).over(here).alias(c) for c in sums))
    # At most ``buckets`` rows of five numbers are broadcast.
    joined = running.join(F.broadcast(totals), "_bucket").select(
        "threshold", "_true", *((F.col(c) + F.col(f"_{c}")).alias(c) for c in sums)
    )
    ratio = lambda a, b: F.when(b > 0, a / F.nullif(b, F.lit(0)))
    return joined.select(
        "threshold",
        *sums,
        (F.col("_true") - F.col("hits")).alias("missed"),
        ratio(F.col("hits"), F.col("hits") + F.col("false_alarms")).alias("precision"),
        ratio(F.col("hits"), F.col("_true")).alias("recall"),
    )
