"""Catalog-driven expressions as Spark SQL text.

Expressions over a whole catalog are long; as text they reach the JVM in one call
and are bound once.  Every argument ``x`` is the SQL text of a string expression.
"""

from __future__ import annotations

from sparkdlp.functions.patterns import Gate, java_form

# Letters outside ASCII that a case-insensitive match takes for an ASCII letter.
FOLD_FROM, FOLD_TO = "\u017F\u212A\u0130\u0131", "skii"


def raw(text: str) -> str:
    """A raw string literal; regular expressions may spell the quote as ``\\x27``."""
    return "r'" + text.replace("'", r"\x27") + "'"


def pattern(p: str) -> str:
    return raw(java_form(p))


def is_ascii(x: str) -> str:
    return f"octet_length({x}) = length({x})"


def fold(x: str) -> str:
    """Lower-cased text in which every case-insensitive ASCII match is literal."""
    return f"if({is_ascii(x)}, lower({x}), lower(translate({x}, '{FOLD_FROM}', '{FOLD_TO}')))"


def gate(g: Gate, x: str, folded: str) -> str:
    source = folded if g.folded else x
    groups = (" OR ".join(f"contains({source}, {raw(n)})" for n in needles) for needles in g.groups)
    return "(" + " AND ".join(f"({group})" for group in groups) + ")"


def matches(p: str, x: str) -> str:
    return f"({x} RLIKE {pattern(p)})"


def find_all(p: str, x: str) -> str:
    return f"regexp_extract_all({x}, {pattern(p)}, 0)"


def substitute(p: str, x: str, replacement: str) -> str:
    return f"regexp_replace({x}, {pattern(p)}, {raw(replacement)})"


def let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"
