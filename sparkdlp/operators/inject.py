"""Injection phrases: flags, findings and the full text scan (layer one)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdlp.functions import patterns as P
from sparkdlp.functions import sqltext as sql
from sparkdlp.functions.text import settle
from sparkdlp.operators.normalize import normalize
from sparkdlp.operators.redact import FINDINGS, redact

N_PHRASES = len(P.INJECTION_PATTERNS)
PHRASE_BITS = (1 << N_PHRASES) - 1


def phrase_mask(x: str, folded: str) -> str:
    """SQL text of an integer with bit ``i`` set where phrase pattern ``i`` occurs."""
    bits = (
        f"if({sql.gate(g, x, folded)} AND {sql.matches(p, x)}, {1 << i}, 0)"
        for i, (p, g) in enumerate(zip(P.INJECTION_PATTERNS, P.INJECTION_GATES))
    )
    return "(" + " | ".join(bits) + ")"


def mask_findings(mask: str) -> str:
    """SQL text of one finding per set phrase bit, in catalog order."""
    labels = "array(" + ", ".join(sql.raw(P.injection_label(p)) for p in P.INJECTION_PATTERNS) + ")"
    return (
        f"if({mask} = 0, cast(array() AS {FINDINGS}), transform(filter(sequence(0, {N_PHRASES - 1}), "
        f"i -> ({mask} & shiftleft(1, i)) <> 0), i -> named_struct('kind', 'injection_heuristic', "
        f"'label', {labels}[i], 'preview', '{P.INJECTION_PREVIEW}')))"
    )


def injection_hits(targets: DataFrame, *ids: str, target: str = "target") -> DataFrame:
    """(ids, label) for every pattern found in every scan target."""
    masked = targets.withColumn("_fold", F.expr(sql.fold(f"`{target}`"))).withColumn(
        "_mask", F.expr(phrase_mask(f"`{target}`", "_fold"))
    )
    return settle(masked, "_mask").where(F.col("_mask") != 0).select(
        *ids, F.explode(F.expr(f"({mask_findings('_mask')}).label")).alias("label")
    )


def scan_text(df: DataFrame, text: str = "text", decode: bool = True) -> DataFrame:
    """Adds ``sanitized``, ``findings``, ``inj_hit``, ``signals``, ``normalized``, ``variants``.

    Redaction works on the raw text; phrases are searched in the normalized view
    and in every decoded payload.  One narrow stage, whatever the table size.
    """
    view = redact(normalize(df, text, decode), text)
    view = view.withColumn("_fold", F.expr(sql.fold("normalized")))
    in_variants = (
        f"if(size(variants) = 0, cast(array() AS array<int>), "
        f"transform(variants, v -> {phrase_mask('v', sql.fold('v'))}))"
    )
    view = view.withColumns(
        {
            "_mask": F.expr(phrase_mask("normalized", "_fold")),
            "_vmasks": F.expr(in_variants),
        }
    )
    view = settle(view.drop("_fold"), "_mask", "_vmasks")
    phrases = (
        f"concat({mask_findings('_mask')}, "
        f"flatten(transform(_vmasks, vm -> {mask_findings('vm')})))"
    )
    return (
        view.withColumn("inj_hit", F.expr("_mask <> 0 OR exists(_vmasks, m -> m <> 0)"))
        .withColumn("findings", F.expr(f"if(inj_hit, concat(findings, {phrases}), findings)"))
        .drop("_mask", "_vmasks")
    )
