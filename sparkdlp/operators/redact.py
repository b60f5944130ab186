"""Secret and personal-data redaction: table -> redacted table + findings.

Everything is a projection: no shuffle, no Python worker.  A pattern runs only on
rows that hold its literals (``patterns.SECRET_GATES``), each on the output of the
one before it.  Results leave through a one-row generator (see ``text.settle``).
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdlp.functions import patterns as P
from sparkdlp.functions import sqltext as sql
from sparkdlp.functions.text import find_all, let, matches, substitute, substitute_before_last

FINDINGS = "array<struct<kind:string,label:string,preview:string>>"

_KEY_END = "PRIVATE KEY-----"


@cache
def _decimal_digits() -> tuple[str, str]:
    """Every decimal digit outside ASCII, and the ASCII digit of the same value."""
    pairs = [
        (chr(c), str(unicodedata.decimal(chr(c))))
        for c in range(0x80, 0x20000)
        if unicodedata.category(chr(c)) == "Nd"
    ]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def luhn_valid(candidate: Column) -> Column:
    """Checksum test over the 13 to 19 digits of a card candidate."""

    def check(digits: Column) -> Column:
        ascii_digits = F.when(
            F.octet_length(digits) == F.length(digits), digits
        ).otherwise(F.translate(digits, *_decimal_digits()))
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", ascii_digits)

    return let(F.regexp_replace(candidate, r"\P{Nd}+", ""), check)


def _substitute_secret(label: str, text: Column) -> Column:
    pattern = P.SECRET_PATTERNS[label]
    if label == "private_key_block":
        return substitute_before_last(pattern, text, _KEY_END, P.REDACTED_SECRET)
    return substitute(pattern, text, P.REDACTED_SECRET)


def redact_ssn(text: Column) -> Column:
    return substitute(P.SSN_PATTERN, text, P.REDACTED_SSN)


def redact_email(text: Column) -> Column:
    return substitute(P.EMAIL_PATTERN, text, P.REDACTED_EMAIL)


def _replace_cards(text: Column, candidates: Column) -> Column:
    gaps = F.split(text, P.java_form(P.CARD_PATTERN), -1)
    kept = F.transform(
        candidates, lambda m: F.when(luhn_valid(m), F.lit(P.REDACTED_CARD)).otherwise(m)
    )
    return F.array_join(
        F.zip_with(gaps, F.concat(kept, F.array(F.lit(""))), lambda g, m: F.concat(g, m)), ""
    )


def redact_cards(text: Column) -> Column:
    return let(
        text,
        lambda t: F.when(
            matches(P.CARD_PATTERN, t), _replace_cards(t, find_all(P.CARD_PATTERN, t))
        ).otherwise(t),
    )


def has_secret(x: str, folded: str) -> str:
    """SQL text: does any secret pattern match (what the redaction would find)?"""
    return "(" + " OR ".join(
        f"({sql.gate(P.SECRET_GATES[label], x, folded)} AND {sql.matches(pattern, x)})"
        for label, pattern in P.SECRET_PATTERNS.items()
    ) + ")"


def redact_text(text: Column) -> Column:
    """The whole redaction as one expression, for use inside array lambdas."""

    def chain(t: Column) -> Column:
        out = t
        for label in P.SECRET_PATTERNS:
            out = _substitute_secret(label, out)
        return redact_cards(redact_email(redact_ssn(out)))

    return let(text, chain)


_NONE = f"cast(array() AS {FINDINGS})"
_STATE = "named_struct('t', {t}, 'f', {f})"


def _secret_chain(x: str, folded: str) -> str:
    """SQL text of struct(t, f): text and findings after all secret patterns."""
    state = _STATE.format(t=x, f=_NONE)
    for k, (label, pattern) in enumerate(P.SECRET_PATTERNS.items()):
        s, m = f"s{k}", f"m{k}"
        found = sql.let(
            f"if({sql.gate(P.SECRET_GATES[label], x, folded)}, "
            f"{sql.find_all(pattern, s + '.t')}, cast(array() AS array<string>))",
            m,
            f"if(size({m}) = 0, {s}, "
            + _STATE.format(
                t=sql.substitute(pattern, s + ".t", P.REDACTED_SECRET),
                f=f"concat({s}.f, transform({m}, h -> named_struct('kind', 'secret', 'label', "
                f"{sql.raw(label)}, 'preview', concat(substring(h, 1, {P.SECRET_PREVIEW_CHARS}), "
                f"{sql.raw(P.SECRET_PREVIEW_SUFFIX)}))))",
            )
            + ")",
        )
        state = sql.let(state, s, found)
    return state


def redact_secrets(
    df: DataFrame, text: str = "text", out: str = "sanitized", findings: str = "findings"
) -> DataFrame:
    """Twelve patterns in catalog order; one finding per match.

    Rows without any literal of any pattern pass in one scan per literal.
    """
    keep = [c for c in df.columns if c not in (out, findings)]
    step = df.select(*keep, F.col(text).alias("_t")).withColumn("_fold", F.expr(sql.fold("_t")))
    possible = " OR ".join(sql.gate(g, "_t", "_fold") for g in P.SECRET_GATES.values())
    unchanged = _STATE.format(t="_t", f=_NONE)
    done = f"if({possible}, {_secret_chain('_t', '_fold')}, {unchanged})"
    return step.select(*keep, F.expr(f"inline(array({done}))").alias(out, findings))


def _pii_chain(x: str) -> str:
    """SQL text of struct(t, f): text and findings after SSN, e-mail and cards."""

    def counted(pattern: str, needle: str, t: str) -> str:
        return f"if(contains({t}, '{needle}'), size({sql.find_all(pattern, t)}), 0)"

    def replaced(n: str, pattern: str, t: str, replacement: str) -> str:
        return f"if({n} > 0, {sql.substitute(pattern, t, replacement)}, {t})"

    def repeated(label: str, preview: str, n: str) -> str:
        item = f"named_struct('kind', 'pii', 'label', '{label}', 'preview', {sql.raw(preview)})"
        return f"array_repeat({item}, {n})"

    digits = r"regexp_replace(m, r'\P{Nd}+', '')"
    foreign, native = _decimal_digits()
    valid = sql.let(
        digits,
        "d",
        f"length(d) BETWEEN 13 AND 19 AND luhn_check(if({sql.is_ascii('d')}, d, "
        f"translate(d, '{foreign}', '{native}')))",
    )
    card = sql.raw(P.REDACTED_CARD)
    cards = (
        f"if(n3 = 0, t2, array_join(zip_with(split(t2, {sql.pattern(P.CARD_PATTERN)}, -1), "
        "concat(shown, array('')), (g, m) -> concat(g, m)), ''))"
    )
    labels = ", ".join(
        repeated(*item)
        for item in (
            ("ssn", P.SSN_PREVIEW, "n1"),
            ("email", P.EMAIL_PREVIEW, "n2"),
            ("credit_card", P.CARD_PREVIEW, "n3"),
        )
    )
    found = f"if(n1 + n2 + n3 = 0, {_NONE}, concat({labels}))"
    body = _STATE.format(t=cards, f=found)
    for value, name in (
        (f"size(filter(shown, c -> c = {card}))", "n3"),
        (
            f"if(size(cs) = 0, cs, transform(cs, m -> if({valid}, {card}, m)))",
            "shown",
        ),
        (sql.find_all(P.CARD_PATTERN, "t2"), "cs"),
        (replaced("n2", P.EMAIL_PATTERN, "t1", P.REDACTED_EMAIL), "t2"),
        (counted(P.EMAIL_PATTERN, "@", "t1"), "n2"),
        (replaced("n1", P.SSN_PATTERN, "t0", P.REDACTED_SSN), "t1"),
        (counted(P.SSN_PATTERN, "-", "t0"), "n1"),
        (x, "t0"),
    ):
        body = sql.let(value, name, body)
    return body


def redact_pii(
    df: DataFrame, text: str = "text", out: str = "sanitized", findings: str = "findings"
) -> DataFrame:
    """SSN, then e-mail, then cards that pass the checksum."""
    keep = [c for c in df.columns if c not in (out, findings)]
    step = df.select(*keep, F.col(text).alias("_t"))
    return step.select(*keep, F.expr(f"inline(array({_pii_chain('_t')}))").alias(out, findings))


def redact(
    df: DataFrame, text: str = "text", out: str = "sanitized", findings: str = "findings"
) -> DataFrame:
    """Secrets, then personal data on the secret-free text."""
    keep = [c for c in df.columns if c not in (out, findings)]
    secrets = redact_secrets(df, text, "_secret_free", "_secrets")
    both = redact_pii(secrets, "_secret_free", out, "_pii")
    merged = f"if(size(_secrets) + size(_pii) = 0, {_NONE}, concat(_secrets, _pii))"
    return both.select(*keep, out, F.expr(merged).alias(findings))


def findings_table(scanned: DataFrame, *ids: str, findings: str = "findings") -> DataFrame:
    """One row per match: ids, position, kind, label, preview."""
    return scanned.select(*ids, F.posexplode(findings).alias("match_ix", "_f")).select(
        *ids, "match_ix", "_f.kind", "_f.label", "_f.preview"
    )


def findings_by_label(scanned: DataFrame, findings: str = "findings") -> DataFrame:
    """Matches and rows per (kind, label).

    Counted within each row first, so the shuffle carries partial sums and no
    distinct over row ids is needed.
    """
    per_row = scanned.select(
        F.explode(
            F.transform(
                F.array_distinct(
                    F.transform(
                        F.col(findings),
                        lambda f: F.struct(f["kind"].alias("kind"), f["label"].alias("label")),
                    )
                ),
                lambda key: F.struct(
                    key["kind"].alias("kind"),
                    key["label"].alias("label"),
                    F.size(
                        F.filter(
                            F.col(findings),
                            lambda f: (f["kind"] == key["kind"]) & (f["label"] == key["label"]),
                        )
                    ).alias("n"),
                ),
            )
        ).alias("f")
    )
    return per_row.groupBy("f.kind", "f.label").agg(
        F.sum("f.n").cast("bigint").alias("matches"), F.count(F.lit(1)).alias("rows")
    )
