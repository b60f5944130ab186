"""Where the values of a JSON text stand: spans in input order, without leaving the JVM.

A text is cut into tokens by one pattern, and a fold over the tokens keeps the open containers. Every value gives
one span: its path, the kinds of the containers around it, its own kind, and where its bytes start and end in the
UTF-8 text. Values can then be read, and replaced in place, while all else stays byte for byte as it came: the
order of members, unknown members, number forms, white space.

The fold goes over blocks of ``BLOCK`` tokens, because a list that grows by one value at a time is copied each time.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkdlp.functions.text import let

BLOCK = 256
SPAN = "struct<path:array<string>,places:array<int>,within:string,kind:string,start:int,end:int>"
#: One token with what stands before it: a string, with its colon where it names a member; a bracket; a scalar.
#: All repetitions are possessive, so that long strings need no stack.
_TOKEN = r'(?s)[ \t\r\n,]*+(?:"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:[ \t\r\n]*+:)?|[{}\[\]]|[^ \t\r\n,:{}\[\]"]++)'
_BLANKS = r"' \t\r\n'"

# The fold is SQL text, which is parsed once where calls would be made one by one. ``s`` is the state: bytes read,
# kinds of the open containers, the path to the innermost one, where each starts and how many values it has had,
# the last member's name, and the spans so far. ``t`` is a token.

#: The token without what stands before it.
_BARE = r"""named_struct('t', t, 'bare', TRIM(LEADING ' \t\r\n,' FROM t))"""
#: What a token is: q key, s string, o opening, c closing, v scalar.
_KIND = r"""named_struct('t', x.t, 'bare', x.bare, 'first', left(x.bare, 1), 'kind',
  CASE left(x.bare, 1) WHEN '"' THEN if(endswith(x.bare, ':'), 'q', 's') WHEN '{' THEN 'o' WHEN '[' THEN 'o' WHEN '}' THEN 'c' WHEN ']' THEN 'c' ELSE 'v' END,
  'start', CAST(s.pos + octet_length(x.t) - octet_length(x.bare) AS INT), 'end', CAST(s.pos + octet_length(x.t) AS INT))"""
_HAD = "coalesce(try_element_at(s.nexts, -1), 0)"
_IN_OBJECT = "endswith(s.within, '{')"
_PATH = f"if(s.within = '', s.path, concat(s.path, array(if({_IN_OBJECT}, s.key, CAST({_HAD} AS STRING)))))"
#: Among a part's members its own text comes first, the others follow in input order.
_PLACES = f"""if(s.within = '', s.places, concat(s.places, array(
  CASE WHEN NOT {_IN_OBJECT} THEN {_HAD} WHEN s.key = 'text' AND k.kind = 's' THEN 0 ELSE {_HAD} + 1 END)))"""
_POP = "slice({0}, 1, greatest(size({0}) - 1, 0))"
_COUNTED = f"if(s.within = '', s.nexts, concat({_POP.format('s.nexts')}, array({_HAD} + 1)))"


def _state(pos: str, within: str, path: str, places: str, starts: str, nexts: str, key: str, last: str) -> str:
    return (
        f"named_struct('pos', {pos}, 'within', {within}, 'path', {path}, 'places', {places}, "
        f"'starts', {starts}, 'nexts', {nexts}, 'key', {key}, {last})"
    )


def _span(path: str, places: str, within: str, kind: str, start: str) -> str:
    return f"named_struct('path', {path}, 'places', {places}, 'within', {within}, 'kind', {kind}, 'start', {start}, 'end', k.end)"


_OUTER = "left(s.within, length(s.within) - 1)"
_NAME = f"TRIM(TRAILING {_BLANKS} FROM left(k.bare, length(k.bare) - 1))"
_TEXT = r"if(contains({0}, '\\'), try_variant_get(try_parse_json({0}), '$', 'string'), substring({0}, 2, length({0}) - 2))"
_OPENED = _state("k.end", "concat(s.within, k.first)", _PATH, _PLACES, "concat(s.starts, array(k.start))", f"concat({_COUNTED}, array(0))", "s.key", "'out', s.out")
_CLOSED = _state(
    "k.end", _OUTER, _POP.format("s.path"), _POP.format("s.places"), _POP.format("s.starts"), _POP.format("s.nexts"), "s.key",
    "'out', concat(s.out, array(" + _span("s.path", "s.places", _OUTER, "if(k.first = '}', 'object', 'array')", "coalesce(try_element_at(s.starts, -1), 0)") + "))",
)
_NAMED = _state("k.end", "s.within", "s.path", "s.places", "s.starts", "s.nexts", f"coalesce({_TEXT.format(_NAME)}, '')", "'out', s.out")
_VALUE = _state(
    "k.end", "s.within", "s.path", "s.places", "s.starts", _COUNTED, "s.key",
    "'out', concat(s.out, array(" + _span(_PATH, _PLACES, "s.within", "if(k.kind = 's', 'string', 'scalar')", "k.start") + "))",
)
_STEP = f"""get(transform(transform(array({_BARE}), x -> {_KIND}), k ->
  CASE k.kind WHEN 'o' THEN {_OPENED} WHEN 'c' THEN {_CLOSED} WHEN 'q' THEN {_NAMED} ELSE {_VALUE} END), 0)"""

_KEPT = ("pos", "within", "path", "places", "starts", "nexts", "key")


def _carried(state: str, last: str) -> str:
    return _state(*(f"{state}.{c}" for c in _KEPT), last)


_INTS, _TEXTS = "CAST(array() AS ARRAY<INT>)", "CAST(array() AS ARRAY<STRING>)"
_ZERO = _state("0", "''", _TEXTS, _INTS, _INTS, _INTS, "''", f"'blocks', CAST(array() AS ARRAY<ARRAY<{SPAN}>>)")
_ENTRY = _carried("a", f"'out', CAST(array() AS ARRAY<{SPAN}>)")
_BLOCK = f"""get(transform(array(aggregate(slice(ts, b * {BLOCK} + 1, {BLOCK}), {_ENTRY}, (s, t) -> {_STEP})),
  d -> {_carried("d", "'blocks', concat(a.blocks, array(d.out))")}), 0)"""
# What the pattern skips would shift all places, so the tokens must cover the text.
_SPANS = f"""get(transform(array({{0}}), body -> get(transform(array(regexp_extract_all(body, r'{_TOKEN}', 0)), ts ->
  if(size(ts) > 0, aggregate(sequence(0, CAST(floor((size(ts) - 1) / {BLOCK}) AS INT)), {_ZERO}, (a, b) -> {_BLOCK},
    a -> if(a.pos = octet_length(TRIM(TRAILING {_BLANKS} FROM body)), flatten(a.blocks), NULL)), NULL)), 0)), 0)"""


def spans(body: str) -> Column:
    """All values of a JSON text in the order in which they end: path, places, within, kind, start, end.

    ``body`` is a column's name or an SQL expression. ``path`` holds member names and list places as texts.
    ``within`` holds an opening bracket for each container around the value. ``places`` orders values as a reader
    of parts wants them, a part's text first. A null body, and one that is not made of JSON tokens alone, has no
    spans (null); the grammar is not checked.
    """
    return F.expr(_SPANS.replace("{0}", body, 1))


def text_of(literal: Column) -> Column:
    """The text that a JSON string literal stands for."""
    plain = F.substring(literal, F.lit(2), F.length(literal) - 2)
    parsed = F.try_variant_get(F.try_parse_json(literal), "$", "string")
    return F.when(F.contains(literal, F.lit("\\")), parsed).otherwise(plain)


def literal_of(text: Column) -> Column:
    """A text as a JSON string literal."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def cut(body: Column, start: Column, end: Column | None = None) -> Column:
    """Bytes of a text, as text; to its end if no end is given."""
    size = F.octet_length(body) if end is None else end
    return F.substring(body.cast("binary"), start + 1, size - start).cast("string")


def splice(body: Column, edits: Column) -> Column:
    """The text with byte ranges replaced; ``edits`` (start, end, new) ascend and do not overlap."""

    def put(both: Column) -> Column:
        text, listed = both["text"], both["edits"]
        ended = lambda i: F.coalesce(F.get(listed, i)["end"], F.lit(0))
        pieces = F.transform(listed, lambda e, i: F.concat(cut(text, ended(i - 1), e["start"]), e["new"]))
        return F.concat(F.array_join(pieces, ""), cut(text, ended(F.size(listed) - 1)))

    return let(F.struct(body.alias("text"), edits.alias("edits")), put)


def members(body: Column, found: Column) -> Column:
    """The members of an object text in input order: name, and the raw value as it came. ``found`` are its spans."""
    own = F.filter(found, lambda s: F.size(s["path"]) == 1)
    in_order = F.array_sort(F.transform(own, lambda s: F.struct(s["start"], s["end"], s["path"])))
    return F.transform(in_order, lambda m: F.struct(F.get(m["path"], F.lit(0)).alias("name"), cut(body, m["start"], m["end"]).alias("raw")))


def elements(body: Column, found: Column, name: str) -> Column:
    """The raw elements of the list that an object text has under a name, in order."""
    own = F.filter(found, lambda s: (F.size(s["path"]) == 2) & (F.get(s["path"], F.lit(0)) == name))
    in_order = F.array_sort(F.transform(own, lambda s: F.struct(s["start"], s["end"])))
    return F.transform(in_order, lambda m: cut(body, m["start"], m["end"]))


def object_of(listed: Column) -> Column:
    """JSON of members (name, raw)."""
    return F.concat(F.lit("{"), F.array_join(F.transform(listed, lambda m: F.concat(literal_of(m["name"]), F.lit(":"), m["raw"])), ","), F.lit("}"))


def with_raw(listed: Column, name: str, raw: Column) -> Column:
    """Members with one of them set in its place, or at the end where it was not there."""
    there = F.exists(listed, lambda m: m["name"] == name)
    put = F.transform(listed, lambda m: F.struct(m["name"].alias("name"), F.when(m["name"] == name, raw).otherwise(m["raw"]).alias("raw")))
    return F.when(there, put).otherwise(F.concat(listed, F.array(F.struct(F.lit(name).alias("name"), raw.alias("raw")))))
