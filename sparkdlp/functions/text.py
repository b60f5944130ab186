"""Column helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdlp.functions.patterns import SPACE, java_form

STRINGS = "array<string>"

def empty_strings() -> Column:
    return F.array().cast(STRINGS)


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def matches(pattern: str, text: Column) -> Column:
    return text.rlike(java_form(pattern))


def find_all(pattern: str, text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(java_form(pattern)), F.lit(0))


def substitute(pattern: str, text: Column, replacement: str) -> Column:
    return F.regexp_replace(text, java_form(pattern), replacement)


def substitute_before_last(pattern: str, text: Column, end: str, replacement: str) -> Column:
    """Substitution for a pattern whose matches all end in ``end``.

    The tail behind the last ``end`` cannot match and is left out, which keeps a
    text with many openings and no closing linear.
    """
    tail = F.substring_index(text, end, -1)
    head = F.left(text, F.length(text) - F.length(tail))
    return F.when(
        F.contains(text, F.lit(end)), F.concat(substitute(pattern, head, replacement), tail)
    ).otherwise(text)


def strip(text: Column) -> Column:
    """Python's ``str.strip``."""
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, rf"{SPACE}+\z", "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, inside one expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def settle(df: DataFrame, *computed: str) -> DataFrame:
    """``df`` with ``computed`` columns that later filters do not look through.

    A filter on a column is otherwise moved below the projection that computes it
    and the whole computation is repeated there, once per step of a chain that
    reads its input more than once.  A one-row generator stops that.
    """
    keep = [c for c in df.columns if c not in computed]
    return df.select(*keep, F.inline(F.array(F.struct(*computed))))
