"""SQL fragments for DuckDB that compute what the operators compute."""

from __future__ import annotations

from sparkdlp.functions import patterns as P

from checks.inputs import lit

# RE2 has neither look-arounds nor Unicode-aware \b and \d.  The three-digit group
# is spelled out, and digit patterns run on text in which every letter outside
# ASCII stands between two underscores, so that it counts as a word character.
SSN = (
    r"\b(?:00[1-9]|0[1-9]\d|[1-578]\d{2}|6[0-57-9]\d|66[0-57-9])"
    r"-(?:0[1-9]|[1-9]\d)-(?:000[1-9]|00[1-9]\d|0[1-9]\d\d|[1-9]\d{3})\b"
)
_LETTER = r"([^\x00-\x7F\p{P}\p{S}\p{Z}\p{C}])"


def sub(x: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(replacement)}, 'g')"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {lit(pattern)}))"


def mark(x: str) -> str:
    return sub(x, _LETTER, r"_\1_")


def unmark(x: str) -> str:
    return sub(x, "_" + _LETTER + "_", r"\1")


def secrets(x: str, upto: int | None = None) -> str:
    for pattern in list(P.SECRET_PATTERNS.values())[:upto]:
        x = sub(x, pattern, P.REDACTED_SECRET)
    return x


def any_secret(x: str) -> str:
    return "(" + " OR ".join(
        f"regexp_matches({x}, {lit(p)})" for p in P.SECRET_PATTERNS.values()
    ) + ")"


def luhn(m: str) -> str:
    d = rf"regexp_replace({m}, '\D', '', 'g')"
    digit = f"CAST(substr({d}, length({d}) - CAST(i AS INTEGER), 1) AS INTEGER)"
    return (
        f"(length({d}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(length({d})), "
        f"lambda i: CASE WHEN i % 2 = 0 THEN {digit} WHEN {digit} > 4 THEN 2 * {digit} - 9 "
        f"ELSE 2 * {digit} END)) % 10 = 0)"
    )


def redaction(source: str, keys: str, text: str, name: str = "red", pii_only: bool = False) -> str:
    """CTEs ending in ``name``(keys, sanitized, n_ssn, n_email, n_card, found)."""
    start = text if pii_only else secrets(text)
    found = "[]" if pii_only else "[" + ", ".join(
        f"{{'label': {lit(label)}, 'hits': regexp_extract_all({secrets(text, k)}, {lit(p)})}}"
        for k, (label, p) in enumerate(P.SECRET_PATTERNS.items())
    ) + "]"
    card = lit(P.CARD_PATTERN)
    return f"""{name}_0 AS (SELECT {keys}, {text} AS raw_text, {start} AS t FROM {source}),
{name}_1 AS (SELECT *, {mark('t')} AS mt FROM {name}_0),
{name}_2 AS (SELECT *, {count('mt', SSN)} AS n_ssn, {unmark(sub('mt', SSN, P.REDACTED_SSN))} AS t2 FROM {name}_1),
{name}_3 AS (SELECT *, {count('t2', P.EMAIL_PATTERN)} AS n_email, {mark(sub('t2', P.EMAIL_PATTERN, P.REDACTED_EMAIL))} AS t3 FROM {name}_2),
{name}_4 AS (SELECT *, regexp_split_to_array(t3, {card}) AS gaps, regexp_extract_all(t3, {card}) AS cards FROM {name}_3),
{name}_5 AS (SELECT *, list_transform(cards, lambda m: CASE WHEN {luhn('m')} THEN {lit(P.REDACTED_CARD)} ELSE m END) AS shown FROM {name}_4),
{name} AS (SELECT {keys}, raw_text, n_ssn, n_email, len(list_filter(shown, lambda s: s = {lit(P.REDACTED_CARD)})) AS n_card,
  {found.replace(text, 'raw_text') if not pii_only else found} AS found,
  CASE WHEN len(cards) = 0 THEN {unmark('t3')} ELSE
  {unmark("array_to_string(list_transform(range(len(gaps)), lambda g: gaps[g + 1] || CASE WHEN g < len(shown) THEN shown[g + 1] ELSE '' END), '')")} END AS sanitized
  FROM {name}_5)"""


def normalized(x: str) -> str:
    """The scanning view of texts that need no encoding repair."""
    x = sub(x, r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{FEFF}]", "")
    x = sub(sub(x, P.HTML_COMMENT_PATTERN, " "), P.HTML_TAG_PATTERN, " ")
    return sub(homoglyphs(f"nfc_normalize({x})"), r"[ \t]{2,}", " ")


def homoglyphs(x: str) -> str:
    return f"translate({x}, {lit(''.join(P.HOMOGLYPHS))}, {lit(''.join(P.HOMOGLYPHS.values()))})"


def variants(source: str, keys: str, text: str, name: str = "var") -> str:
    """CTEs ending in ``name``(keys, kind, ix, candidate, decoded)."""

    def found(kind: str, pattern: str) -> str:
        return (
            f"SELECT {keys}, {kind} AS kind, generate_subscripts(regexp_extract_all({text}, {lit(pattern)}), 1) AS ix, "
            f"unnest(regexp_extract_all({text}, {lit(pattern)})) AS candidate FROM {source}"
        )

    return f"""{name}_c AS ({found('1', P.BASE64_PATTERN)} UNION ALL {found('2', P.PERCENT_PATTERN)}),
{name}_d AS (SELECT *, CASE WHEN kind = 1 AND length(candidate) % 4 = 0 THEN try(decode(from_base64(candidate)))
  WHEN kind = 2 THEN url_decode(candidate) END AS decoded FROM {name}_c),
{name} AS (SELECT * FROM {name}_d WHERE decoded IS NOT NULL AND (kind = 2 OR (length(decoded) >= 4 AND
  (length(regexp_replace(decoded, '[\\p{{C}}\\p{{Z}}]', '', 'g')) + length(decoded) - length(replace(decoded, ' ', '')))
  / CAST(length(decoded) AS DOUBLE) > CAST(0.85 AS DOUBLE))))"""


def phrase_hits(x: str) -> list[str]:
    return [f"regexp_matches({x}, {lit(p)})" for p in P.INJECTION_PATTERNS]


def phrase_count(x: str) -> str:
    return "(" + " + ".join(f"CAST({h} AS INTEGER)" for h in phrase_hits(x)) + ")"


def score(x: str) -> str:
    def w(cond: str, value: float) -> str:
        return f"CASE WHEN {cond} THEN CAST({value} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"

    letters = rf"length(regexp_replace({x}, '[^\p{{L}}]', '', 'g'))"
    capitals = rf"length(regexp_replace({x}, '[^\p{{Lu}}]', '', 'g'))"
    imperative = P.IMPERATIVE_PATTERN.replace("(?i)", "(?im)")
    return (
        f"greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), "
        f"least({phrase_count(x)}, 3) * CAST(0.35 AS DOUBLE)"
        f" + {w(f'regexp_matches({x}, {lit(P.ROLEPLAY_PATTERN)})', 0.15)}"
        f" + {w(f'regexp_matches({x}, {lit(imperative)})', 0.15)}"
        f" + {w(f'regexp_matches({x}, {lit(P.PUNCTUATION_PATTERN)})', 0.05)}"
        f" + {w(f'{letters} > 20 AND {capitals} / CAST(greatest({letters}, 1) AS DOUBLE) > CAST(0.6 AS DOUBLE)', 0.08)}))"
    )


def preview(x: str, limit: int = 120) -> str:
    s = rf"regexp_replace(replace({x}, chr(10), ' '), '^\s+|\s+$', '', 'g')"
    return rf"CASE WHEN length({s}) <= {limit} THEN {s} ELSE regexp_replace(substr({s}, 1, {limit}), '\s+$', '') || '…' END"


# Token bucket over (request_id, key, us), as whole units of 1/period token.
def bucket(source: str, capacity: int, refill: int, period: int) -> str:
    full = capacity * period
    level = f"least({full}, b.units + (o.us - b.us) * {refill})"
    return f"""ordered AS (SELECT request_id, key, us, row_number() OVER (PARTITION BY key ORDER BY us, request_id) AS n FROM {source}),
bucket AS (
  SELECT request_id, key, us, n, CAST({full - period} AS BIGINT) AS units, TRUE AS allowed, CAST(0 AS BIGINT) AS missing FROM ordered WHERE n = 1
  UNION ALL
  SELECT o.request_id, o.key, o.us, o.n,
    CAST(CASE WHEN {level} >= {period} THEN {level} - {period} ELSE {level} END AS BIGINT),
    {level} >= {period},
    CAST(CASE WHEN {level} >= {period} THEN 0 ELSE {period} - {level} END AS BIGINT)
  FROM bucket b JOIN ordered o ON o.key = b.key AND o.n = b.n + 1)"""
