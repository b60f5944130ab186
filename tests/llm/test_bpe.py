import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkdlp.llm import bpe, token_counts

tokenizer = Tokenizer.from_file(bpe.default_path())
with open(bpe.default_path(), "rb") as file:
    encoder = bpe.load(file.read())


def want(text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab 'sé\n\t 12!<|> 😀"), max_size=80))
def test_same_ids_as_the_tokenizers_library(text):
    assert bpe.ids_of(encoder, text).tolist() == want(text)
    assert bpe.decode_ids(encoder, bpe.ids_of(encoder, text)) == tokenizer.decode(want(text), skip_special_tokens=False)


@pytest.mark.parametrize("text", ["<|endoftext|>", "a <|endoftext|>  b", "x" * 5000, " " * 3000 + "a", "don't I'LL"])
def test_special_and_long_runs(text):
    assert bpe.ids_of(encoder, text).tolist() == want(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["word ", "a\n", "  b", "é ", "<|endoftext|>", "12 34", "'s it", "\n\n x"]), max_size=400))
def test_bodies_encode_alike_in_any_text(parts):
    text = "".join(parts)
    data = bpe.utf8(text)
    shared = [(a, b, bpe.ids_of(encoder, data[a:b].tobytes().decode())) for a, b in bpe.bodies(data)]
    assert bpe.repaired(encoder, text, shared).tolist() == want(text)


def test_whole_tables(awkward, empty):
    rows = awkward.select("doc_id", "text").collect()
    got = bpe.encode(awkward, finish="digest").collect()
    digest = lambda ids: hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
    expected = sorted((str(r.doc_id), len(want(r.text)), digest(want(r.text)), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == expected
    assert bpe.encode(empty).count() == 0


def test_shared_passages_round_trip(spark):
    passage = " ".join(f"passage{i} text" for i in range(400))
    rows = [(i, f"start {i} " * (i % 5) + passage + f" end {i * i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert bpe.shared_bodies(docs.selectExpr("string(doc_id) doc", "xxhash64(text) body", "text")).count() > 100
    back = bpe.decode(bpe.encode(docs), to="back").select("doc_id", "back", "ids").collect()
    assert {r.doc_id: r.back for r in back} == dict(rows)
    assert {r.doc_id: r.ids for r in back} == {i: want(t) for i, t in rows}


class Held:
    """Stands for a broadcast value."""

    def __init__(self, value):
        self.value = value


def test_texts_without_shared_bodies_among_others():
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("ids", pa.binary())]))
    text = "some words that stand for themselves"
    ids = np.asarray(want(text[:10]), bpe._width(encoder)).tobytes()
    arrays = [pa.array(["1", "2"]), pa.array([1, 2]), pa.array([text, text]), pa.array([None, [{"start": 0, "end": 10, "ids": ids}]], kind)]
    with open(bpe.default_path(), "rb") as file:
        run = bpe._assemble(Held(file.read()), "ids")
    (got,) = run(iter([pa.RecordBatch.from_arrays(arrays, ["doc", "body", "text", "shared"])]))
    assert got.column("ids").to_pylist() == [want(text), want(text)]


@pytest.mark.parametrize("bits", [1 << 15, 1 << 27])
def test_bitmap_tells_members(spark, monkeypatch, bits):
    monkeypatch.setattr(bpe, "MARK_BITS", bits)
    rows = spark.range(20_000).selectExpr("id", "if(id = 0, -9223372036854775808, xxhash64(id)) as k")
    marks = bpe.marked(rows.where("id % 2 = 0"), "k")
    told = bpe.in_bitmap(rows, "k", marks).collect()
    assert len(told) == 20_000 and all(r.hit for r in told if r.id % 2 == 0)
    wrong, whole = sum(r.hit for r in told if r.id % 2), bpe._gathered(marks)
    assert 8 * len(whole) == marks[1] <= bits and (wrong < 1000 if bits > 1 << 15 else 1000 < wrong < 5000)
    assert [bool(whole[(s := r.k & (marks[1] - 1)) >> 3] >> (s & 7) & 1) for r in told] == [r.hit for r in told]


def test_texts_that_a_full_bitmap_takes_along(spark, monkeypatch):
    """Every text and every body is told as shared: those that are not come out the same."""
    passage = " ".join(f"passage{i} text" for i in range(400))
    rows = [(i, " ".join(f"own{i}x{k}" for k in range(600)) + (passage if i % 3 == 0 else "")) for i in range(30)] + [(None, None), (5, "x"), (None, passage), (None, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(bpe, "in_bitmap", lambda rows, key, marks: rows.selectExpr("*", "true as hit"))
    monkeypatch.setattr(bpe, "_gathered", lambda marks: b"\xff" * 4096)
    got = bpe.encode(docs).collect()
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(i), want(t)) for i, t in rows)


def test_counts_after_edits(awkward, empty, spark):
    edits = spark.createDataFrame(
        [(1, 0, 5, "new"), (1, 3, 9, "skipped"), (1, 40, 40, " put"), (4, 10, None, "x"), (4, 50, 99999, None), (6, 0, 0, "filled"), (11, 1000, 1001, ""),
         (12, 5, 6, " "), (20, 3, 2, "bad"), (22, 1, 3, "é\n"), (99, 0, 1, "unknown"), (None, 0, 3, "n"), (5, 0, 4, "was null")],
        "doc_id long, start long, end long, replacement string",
    )
    own = {}
    for e in edits.collect():
        own.setdefault(e.doc_id, []).append((e.start, e.end, e.replacement))

    def after(text, changes):
        text, out, at = text or "", [], 0
        for start, end, put in token_counts.accepted(changes, len(text)):
            out += [text[at:start], put]
            at = end
        return "".join(out) + text[at:]

    expected = sorted((str(r.doc_id), len(want(r.text)), len(want(after(r.text, own.get(r.doc_id, []))))) for r in awkward.collect())
    got = token_counts.recount(awkward, edits).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_tokens_after) for r in got) == expected
    assert next(r for r in got if r.doc_id == 11).reencoded < 5_000
    assert token_counts.recount(empty, edits).count() == 0


@settings(max_examples=100, deadline=None)
@given(
    st.lists(st.sampled_from(["word ", "a\n", "  b", "é ", "12 34", "'s it", "longerword"]), max_size=600),
    st.lists(st.tuples(st.integers(0, 3000), st.integers(0, 60), st.sampled_from(["", " ", "x", "\n", " foo bar", "'s"])), max_size=6),
)
def test_trees_follow_edits(parts, places):
    text = "".join(parts)
    edits = [(a, a + n, put) for a, n, put in places]
    ends, tree = token_counts.plant(encoder, text)
    ends, tree, _, _ = token_counts.edited(encoder, text, ends, tree, edits)
    out, at = [], 0
    for start, end, put in token_counts.accepted(edits, len(text)):
        out += [text[at:start], put]
        at = end
    text = "".join(out) + text[at:]
    assert tree[1] == len(want(text)) and ends[-1] == len(text.encode())


def test_cleaning_edits(spark):
    docs = spark.createDataFrame([(1, "a 1234567\nb\na 1234567\nb\nc"), (2, None), (3, "plain")], "doc_id long, text string")
    got = token_counts.cleaning_edits(docs).collect()
    assert sorted((r.doc_id, r.start, r.end, r.replacement) for r in got) == [(1, 2, 9, "0"), (1, 11, 21, ""), (1, 21, 23, "")]


def test_edits_go_to_the_text_that_they_are_for(spark):
    rows = [(1, "same line here\nsame line here\nend"), (1, "another text without edits"), ("x", None)][:2]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.n_tokens: r for r in token_counts.recount(docs, token_counts.cleaning_edits(docs)).collect()}
    assert sorted(r.n_edits for r in got.values()) == [0, 1]
    untouched = next(r for r in got.values() if r.n_edits == 0)
    assert untouched.n_tokens_after == untouched.n_tokens and untouched.reencoded == 0
    named = docs.withColumn("doc_id", docs.doc_id.cast("string"))
    assert sorted(r.n_edits for r in token_counts.recount(named, token_counts.cleaning_edits(named)).collect()) == [0, 1]
