"""Anti-evasion normalization: table -> table with a view of the text made for scanning.

Order: repair -> zero-width -> HTML -> compatibility forms and look-alikes ->
white space.  Embedded encodings are searched in the raw text.  ASCII rows skip
every Unicode step behind one byte-length comparison, and only rows holding a
character that compatibility folding can change visit a Python worker.
"""

from __future__ import annotations

import html
import json
import unicodedata
from functools import cache
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sparkdlp.functions import patterns as P
from sparkdlp.functions.text import (
    STRINGS, empty_strings, find_all, is_ascii, let, settle, substitute, substitute_before_last,
)

# Characters that no repair, folding or removal touches: printable ASCII, tab, line
# feed, form feed and the Latin-1 letters.  Texts of nothing else skip the Unicode
# steps after one scan.
# (One possessive run is by far the quickest way to ask this of a Java pattern.)
_INERT_ONLY = r"\A[\t\n\f\x20-\x7E\xC0-\xFF]*+\z"


def is_special(text: Column) -> Column:
    return ~text.rlike(_INERT_ONLY)


# --- N1: text repair ----------------------------------------------------------

_CP1252 = {
    bytes([b]).decode("cp1252"): chr(b)
    for b in range(0x80, 0xA0)
    if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)
}
_CP1252_CHARS = "".join(_CP1252)
_C1_CHARS = "".join(_CP1252.values())

# Curly quotes and the straight ones that replace them.
_CURLY = {
    "ʼ": "'", "‘": "'", "’": "'", "‚": "'", "‛": "'",
    "“": '"', "”": '"', "„": '"', "‟": '"',
}
_CONTROL = r"[\x00-\x08\x0B\x0E-\x1F\x7F⁪-⁯﻿￹-￼]"
_NEEDS_CLEANING = r"[\x00-\x08\x0B\x0D-\x1F\x7F\x85\x{2BC}\x{2018}-\x{206F}\x{FEFF}-\x{FFFC}]"
_LINE_BREAK = r"\r\n|[\r\x85  ]"
_QUOTED_CAPITAL = "(?<=[A-Z])[À-Þ][»”’](?![a-zà-ÿ])"
# Full-width forms of ASCII and the wide blank.
_WIDE = "　" + "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = " " + "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
_ENTITY = r"&#?[0-9A-Za-z]{1,24};"


def _reencode(line: Column) -> Column:
    """UTF-8 that was read as Latin-1 or Windows-1252, read again as UTF-8."""
    latin = F.translate(line, _CP1252_CHARS, _C1_CHARS)
    fits = ~latin.rlike(r"[^\x00-\xFF]")
    again = F.try_validate_utf8(F.encode(latin, "ISO-8859-1").cast("string"))
    # A capital at the end of a word in capitals with a closing quote after it is good
    # text, though its two bytes happen to be valid UTF-8.
    suspicious = ~is_ascii(F.regexp_replace(line, _QUOTED_CAPITAL, ""))
    return F.when(~is_ascii(line) & fits & suspicious, F.coalesce(again, line)).otherwise(line)


# Bytes that go on a UTF-8 sequence, as Latin-1 or Windows-1252 shows them.
_GOES_ON = f"\\u0080-\\u00BF{_CP1252_CHARS}"
# Marks that stand behind a letter in sound text, and signs that may.
_CLOSERS = "«»‘’“”‹›…–—"
_SIGNS = "©®™"
_LOWER = "a-zß-öø-ÿ"
_SEQUENCE = f"(?:[\\u00C2-\\u00DF][{_GOES_ON}]|[\\u00E0-\\u00EF][{_GOES_ON}]{{2}}|[\\u00F0-\\u00F4][{_GOES_ON}]{{3}})"
# A stretch that is rather damage than text. Two sequences side by side are; of single ones: the two leads that stand
# for Latin-1 letters, unless a closing mark follows that nothing lower-case goes on after; leads of other alphabets
# before anything but marks and signs, or at a word's start before a mark in it; the lead of punctuation before anything but a closing mark; that of pictures.
_DAMAGE = (
    f"(?:{_SEQUENCE}{{2,}}"
    f"|[\\u00C2\\u00C3][{_GOES_ON}&&[^{_CLOSERS}]]|[\\u00C2\\u00C3][{_CLOSERS}](?=[{_LOWER}])"
    f"|[\\u00C4-\\u00D1][{_GOES_ON}&&[^{_CLOSERS}{_SIGNS}]]|(?<![A-Za-z\\u00C0-\\u00FF])[\\u00C4\\u00C5][{_CLOSERS}](?=[{_LOWER}])"
    f"|\\u00E2[{_GOES_ON}&&[^{_CLOSERS}]][{_GOES_ON}]"
    f"|\\u00F0[\\u009F\\u0178][{_GOES_ON}]{{2}})"
)


def _bytes_of(text: Column) -> Column:
    """The text whose UTF-8 bytes were shown as Latin-1 or Windows-1252; null if they are none."""
    return F.try_validate_utf8(F.encode(F.translate(text, _CP1252_CHARS, _C1_CHARS), "ISO-8859-1").cast("string"))


def _repair_stretches(line: Column) -> Column:
    """Damaged stretches of a line that is sound elsewhere, each on its own."""
    between = F.split(line, _DAMAGE, -1)
    found = F.transform(F.regexp_extract_all(line, F.lit(_DAMAGE), F.lit(0)), lambda d: F.coalesce(_bytes_of(d), d))
    whole = F.array_join(F.zip_with(between, F.concat(found, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    return F.when(line.rlike(_DAMAGE), whole).otherwise(line)


@cache
def _entities() -> dict[str, str]:
    """Named entities, with the capitalized spelling of all-lower names."""
    table = {f"&{name}": text for name, text in html5.items() if name.endswith(";")}
    for name, text in list(table.items()):
        if name == name.lower() and html.unescape(name.upper()) == name.upper():
            table[name.upper()] = text.upper()
    return table


def _entity_text(entity: Column) -> Column:
    known = F.from_json(F.lit(json.dumps(_entities())), "map<string,string>")
    # Leading zeros are skipped, so padding does not hide a reference.
    reference = r"\A&#([xX]?)0*([0-9A-Fa-f]{1,7});\z"
    base, digits = (F.regexp_extract(entity, reference, i) for i in (1, 2))
    number = F.when((base != "") & (digits != ""), F.conv(digits, 16, 10).cast("int")).when(
        (base == "") & digits.rlike(r"\A[0-9]{1,7}\z"), digits.cast("int")
    )
    sane = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    utf32 = F.unhex(F.lpad(F.hex(number), 8, "0"))
    decoded = F.when(sane, F.decode(utf32, "UTF-32"))
    as_latin = F.translate(decoded, _C1_CHARS, _CP1252_CHARS)
    return F.coalesce(F.try_element_at(known, entity), as_latin, entity)


def unescape_entities(text: Column) -> Column:
    """Character references of the lines before the first ``<``-holding line."""

    def replace(t: Column) -> Column:
        before = F.substring_index(t, "<", 1)
        n_lines = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))
        head = F.when(~F.contains(t, F.lit("<")), t).otherwise(
            F.when(
                n_lines > 0, F.concat(
                    F.call_function("substring_index", before, F.lit("\n"), n_lines), F.lit("\n")
                ),
            ).otherwise(F.lit(""))
        )

        def fill(h: Column) -> Column:
            parts = F.split(h, _ENTITY, -1)
            found = F.transform(F.regexp_extract_all(h, F.lit(_ENTITY), F.lit(0)), _entity_text)
            joined = F.zip_with(
                parts, F.concat(found, F.array(F.lit(""))), lambda a, b: F.concat(a, b)
            )
            rest = F.substring(t, F.length(h) + 1, F.length(t))
            return F.concat(F.array_join(joined, ""), rest)

        return let(head, fill)

    present = F.contains(text, F.lit("&")) & text.rlike(_ENTITY)
    return F.when(present, let(text, replace)).otherwise(text)


def repair_text(text: Column) -> Column:
    """Native subset of the usual text repairs, applied per line where that matters."""
    suspect = f"[\\u00C2-\\u00F4][\\u0080-\\u00BF{_CP1252_CHARS}]"

    def per_line(t: Column) -> Column:
        lines = F.split(t, "\n", -1)
        # Whole lines first, then what is left in lines that also hold sound text; twice each, for double damage.
        for step in (_reencode, _reencode, _repair_stretches, _repair_stretches):
            lines = F.transform(lines, step)
        return F.array_join(lines, "\n")

    def encoding(t: Column) -> Column:
        present = ~is_ascii(t) & t.rlike(r"[\x{80}-\x{BF}\x{152}-\x{2122}]") & t.rlike(suspect)
        return F.when(present, per_line(t)).otherwise(t)

    def clean(t: Column) -> Column:
        straight = F.when(
            ~is_ascii(t), F.translate(t, "".join(_CURLY), "".join(_CURLY.values()))
        ).otherwise(t)
        lines = F.regexp_replace(straight, _LINE_BREAK, "\n")
        return F.regexp_replace(lines, rf"\x1B\[[0-9;]*[A-Za-z]|{_CONTROL}", "")

    def narrow(t: Column) -> Column:
        """Width is repaired before tags are looked for, so wide brackets hide nothing."""
        return let(
            t,
            lambda u: F.when(
                u.rlike(r"[\x{3000}\x{FF01}-\x{FF5E}]"), F.translate(u, _WIDE, _NARROW)
            ).otherwise(u),
        )

    def whole(t: Column) -> Column:
        return let(
            let(unescape_entities(t), encoding),
            lambda u: narrow(F.when(u.rlike(_NEEDS_CLEANING), clean(u)).otherwise(u)),
        )

    return F.when(may_change(text), let(text, whole)).otherwise(text)


def may_change(text: Column) -> Column:
    """False only for texts that the repair and the Unicode steps leave as they are."""
    return F.contains(text, F.lit("&")) | is_special(text)


# --- N2, N3, N5, N6 -----------------------------------------------------------


def strip_zero_width(text: Column) -> Column:
    return F.when(is_special(text), substitute(P.ZERO_WIDTH_PATTERN, text, "")).otherwise(text)


def strip_html(text: Column) -> Column:
    """Comments, then tags, each replaced by one space."""

    def strip(t: Column) -> Column:
        no_comments = substitute_before_last(P.HTML_COMMENT_PATTERN, t, "-->", " ")
        return let(
            no_comments, lambda u: substitute_before_last(P.HTML_TAG_PATTERN, u, ">", " ")
        )

    return F.when(F.contains(text, F.lit("<")), let(text, strip)).otherwise(text)


def fold_homoglyphs(text: Column) -> Column:
    folded = F.translate(text, "".join(P.HOMOGLYPHS), "".join(P.HOMOGLYPHS.values()))
    return F.when(is_special(text), folded).otherwise(text)


def collapse_spaces(text: Column) -> Column:
    present = F.contains(text, F.lit("  ")) | F.contains(text, F.lit("\t"))
    return F.when(present, F.regexp_replace(text, r"[ \t]{2,}", " ")).otherwise(text)


# --- N4: compatibility forms --------------------------------------------------


@cache
def _stable_ranges() -> str:
    """Code points that NFKC never changes, as the ranges of a character class.

    A code point counts when it is its own NFKC form, has combining class zero
    and never composes with what stands before it.  Only long runs are
    listed, so the class stays quick; the others just take the exact path.
    """
    composing = set(range(0x1100, 0x1200))
    for c in range(0xC0, 0x30000):
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            composing.add(int(parts[1], 16))

    def stable(c: int) -> bool:
        ch = chr(c)
        return (
            not 0xD800 <= c < 0xE000
            and c not in composing
            and unicodedata.category(ch) != "Cn"
            and unicodedata.combining(ch) == 0
            and unicodedata.normalize("NFKC", ch) == ch
        )

    runs, start = [], None
    for c in range(0x80, 0x20001):
        if c < 0x20000 and stable(c):
            start = c if start is None else start
        elif start is not None:
            runs.append((start, c - 1))
            start = None
    kept = [(a, b) for a, b in runs if b - a >= (48 if a < 0x3400 else 1000)]
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in kept)


def needs_nfkc(text: Column) -> Column:
    return (
        ~is_ascii(text)
        & is_special(text)
        & text.rlike(f"[^\\x00-\\x7F{_stable_ranges()}]")
    )


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def fold_compatibility(df: DataFrame, column: str, where: Column | None = None) -> DataFrame:
    """NFKC of ``column``; rows that it cannot change send only a null to Python."""
    needed = needs_nfkc(F.col(column))
    needed = needed if where is None else where & needed
    folded = _nfkc(F.when(needed, F.col(column)))
    return df.withColumn("_nfkc", folded).withColumn(
        column, F.coalesce("_nfkc", column)
    ).drop("_nfkc")


# --- N7, N8: embedded encodings -----------------------------------------------

ENCODED = "array<struct<text:string,signal:string>>"


def _kept(candidates: Column, decode, signal: str) -> Column:
    rows = F.transform(
        candidates,
        lambda c: F.struct(
            decode(c).alias("text"),
            F.concat(F.lit(f"{signal}:"), F.substring(c, 1, 16), F.lit("...")).alias("signal"),
        ),
    )
    return F.filter(rows, lambda r: r["text"].isNotNull())


def _base64_text(candidate: Column) -> Column:
    """Decoded text of a well-padded candidate that reads as text, else null."""
    text = F.when(
        F.length(candidate) % 4 == 0,
        F.try_validate_utf8(F.try_to_binary(candidate, F.lit("base64")).cast("string")),
    )
    shown = F.length(F.regexp_replace(text, r"[\p{C}\p{Z}&&[^ ]]", ""))
    readable = (F.length(text) >= 4) & (shown / F.length(text) > 0.85)
    return F.when(readable, text)


def _percent_text(candidate: Column) -> Column:
    text = F.try_url_decode(candidate)
    return F.when((text != candidate) & (text != ""), text)


def decode_base64(text: Column) -> Column:
    candidates = find_all(r"(?<![A-Za-z0-9+/])" + P.BASE64_PATTERN, text)
    return let(
        candidates,
        lambda c: F.when(F.size(c) > 0, _kept(c, _base64_text, "base64_payload")).otherwise(
            F.array().cast(ENCODED)
        ),
    )


def decode_percent(text: Column) -> Column:
    candidates = find_all(P.PERCENT_PATTERN + "+", text)
    return F.when(
        F.contains(text, F.lit("%")), _kept(candidates, _percent_text, "url_encoded_payload")
    ).otherwise(F.array().cast(ENCODED))


# --- N9, N10 ------------------------------------------------------------------


def normalize(df: DataFrame, text: str = "text", decode: bool = True) -> DataFrame:
    """Adds ``normalized``, ``variants`` and ``signals``."""
    source, flag, view = F.col(text), F.col("_flag"), F.col("normalized")

    def when_flagged(value: Column) -> Column:
        return F.when(flag, value).otherwise(view)

    step = df.withColumns({"_flag": may_change(source), "normalized": source})
    step = step.withColumn("normalized", when_flagged(strip_zero_width(repair_text(source))))
    step = step.withColumn("normalized", strip_html(view))
    step = fold_compatibility(step, "normalized", flag)
    step = step.withColumn("normalized", when_flagged(fold_homoglyphs(view)))
    view = step.withColumn("normalized", collapse_spaces(view)).drop("_flag")
    if not decode:
        return settle(view, "normalized").withColumns(
            {"variants": empty_strings(), "signals": empty_strings()}
        )
    view = view.withColumn("_enc", F.concat(decode_base64(source), decode_percent(source)))
    return settle(view, "normalized", "_enc").withColumns(
        {
            "variants": F.col("_enc")["text"].cast(STRINGS),
            "signals": F.col("_enc")["signal"].cast(STRINGS),
        }
    ).drop("_enc")


def scan_targets(normalized: DataFrame, *ids: str) -> DataFrame:
    """One row per text to search: the normalized view, then each decoded payload."""
    targets = F.concat(F.array("normalized"), F.col("variants"))
    return normalized.select(*ids, F.posexplode(targets).alias("target_ix", "target"))
