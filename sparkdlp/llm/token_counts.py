"""Token counts that follow edits.

Every document keeps a segment tree over its pre-tokens: leaves are stretches of text that begin and end on safe
boundaries (see bpe), each with its number of tokens, and every inner node has the sum of its two children. An
edit re-encodes the leaves that it touches, and those whose border it touches, as one stretch; the counts of the
leaves and the sums above them are updated, everything else stays as it was.

Edits are rows of start, end (code points of the text before any edit, end exclusive) and replacement. Edits of a
document are taken by start, then end; one that begins before the end of an edit already taken is skipped.

Defined cases: null counts as the empty text, with no tokens and one empty leaf. Edits beyond a text's end are cut
to it; a null or negative start or end, or an end before its start, is skipped; a null replacement deletes. Edits
of unknown documents have no effect. Rows that repeat an id are told apart by their texts; repeated edits of one
place count once. An empty table gives an empty result. Other columns than those named are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdlp.llm.bpe import _vocabulary, ids_of, load, safe_boundaries
from sparkdlp.llm.common import fits, same, saved, utf8

#: Least bytes of a leaf but the last.
LEAF_BYTES = 512

Edit = tuple[int, int, str]


def leaves(data: np.ndarray) -> np.ndarray:
    """Ends of the leaves in bytes; the last is the text's end."""
    safe, out, at = safe_boundaries(data), [], 0
    while len(data) - at > LEAF_BYTES:
        i = int(np.searchsorted(safe, at + LEAF_BYTES))
        if i == len(safe):
            break
        at = int(safe[i])
        out.append(at)
    return np.asarray([*out, len(data)], dtype=np.int64)


def grown(counts: np.ndarray) -> np.ndarray:
    """The tree as one array: node i has the children 2 i and 2 i + 1, the root is 1, leaves come last."""
    width = 1 << max(0, int(len(counts) - 1).bit_length())
    tree = np.zeros(2 * width, dtype=np.int64)
    tree[width : width + len(counts)] = counts
    while width > 1:
        width //= 2
        tree[width : 2 * width] = tree[2 * width : 4 * width : 2] + tree[2 * width + 1 : 4 * width : 2]
    return tree


def set_leaf(tree: np.ndarray, leaf: int, count: int) -> None:
    at = len(tree) // 2 + leaf
    tree[at] = count
    while at > 1:
        at //= 2
        tree[at] = tree[2 * at] + tree[2 * at + 1]


def plant(encoder, text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Leaf ends and tree of a text."""
    data = utf8(text)
    ends = leaves(data)
    begins = np.concatenate([[0], ends[:-1]])
    return ends, grown(np.asarray([len(ids_of(encoder, data[a:b].tobytes().decode())) for a, b in zip(begins, ends, strict=True)]))


def accepted(edits: list[Edit], length: int) -> list[Edit]:
    """The edits that take effect, in order and cut to the text's length in code points."""
    out: list[Edit] = []
    for start, end, put in sorted({e for e in edits if e[0] is not None and e[1] is not None}, key=lambda e: (e[0], e[1], e[2] or "")):
        start, end = min(start, length), min(end, length)
        if 0 <= start <= end and (not out or start >= out[-1][1] and (start, end) != out[-1][:2]):
            out.append((start, end, put or ""))
    return out


def edited(encoder, text: str | None, ends: np.ndarray, tree: np.ndarray, edits: list[Edit]) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Leaf ends (of the new text) and tree after the edits, the edits taken, and the bytes that were re-encoded."""
    data = utf8(text)
    tree, old = tree.copy(), ends
    begins = np.concatenate([[0], old[:-1]])
    place = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    taken = [(int(place[a]), int(place[b]), put.encode()) for a, b, put in accepted(edits, len(place) - 1)]
    # Ranges of leaves that touch an edit or share a border with it; ranges with a leaf in common are one.
    ranges: list[list] = []
    for start, end, put in taken:
        first, last = int(np.searchsorted(old, start, side="left")), int(np.searchsorted(begins, end, side="right")) - 1
        last = max(first, last)
        if ranges and first <= ranges[-1][1]:
            ranges[-1][1] = max(ranges[-1][1], last)
            ranges[-1][2].append((start, end, put))
        else:
            ranges.append([first, last, [(start, end, put)]])
    sizes = np.diff(np.concatenate([[0], old]))
    work = 0
    for first, last, own in ranges:
        parts, at = [], int(begins[first])
        for start, end, put in own:
            parts += [data[at:start].tobytes(), put]
            at = end
        stretch = b"".join([*parts, data[at : int(old[last])].tobytes()])
        set_leaf(tree, first, len(ids_of(encoder, stretch.decode())))
        sizes[first] = len(stretch)
        for leaf in range(first + 1, last + 1):
            set_leaf(tree, leaf, 0)
            sizes[leaf] = 0
        work += len(stretch)
    return np.cumsum(sizes), tree, len(taken), work


_TREE = "doc string, body long, ends array<long>, tree array<long>"


def trees(texts: DataFrame, vocabulary) -> DataFrame:
    """doc, body, ends, tree for rows of doc, body, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or load(vocabulary.value)
            found = [plant(encoder, t.as_py()) for t in batch.column("text")]
            lists = [pa.array([f[i] for f in found], pa.list_(pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("body"), *lists], ["doc", "body", "ends", "tree"])

    return texts.select("doc", "body", "text").mapInArrow(run, _TREE)


def updated(work: DataFrame, vocabulary) -> DataFrame:
    """New ends and tree for rows of doc, body, text, ends, tree, edits; also n_edits and reencoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or load(vocabulary.value)
            found = []
            for text, ends, tree, edits in zip(*(batch.column(c) for c in ("text", "ends", "tree", "edits")), strict=True):
                asked = [(e["start"], e["end"], e["replacement"]) for e in edits.as_py()]
                found.append(edited(encoder, text.as_py(), np.asarray(ends.values), np.asarray(tree.values), asked))
            lists = [pa.array([f[i] for f in found], pa.list_(pa.int64())) for i in (0, 1)]
            numbers = [pa.array([f[i] for f in found], pa.int64()) for i in (2, 3)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("body"), *lists, *numbers], ["doc", "body", "ends", "tree", "n_edits", "reencoded"])

    return work.mapInArrow(run, f"{_TREE}, n_edits long, reencoded long")


def recount(docs: DataFrame, edits: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, body, n_tokens, n_leaves, n_edits, n_tokens_after and reencoded (bytes) for every document.

    edits: doc_id, start, end, replacement, and body (the hash of the text they are for) where ids may repeat with
    other texts; without it they are for every row of their id.
    """
    vocabulary = _vocabulary(docs.sparkSession, path)
    kind = docs.schema[doc_id].dataType
    texts = docs.select(F.col(doc_id).cast("string").alias("doc"), F.xxhash64(F.col(text)).alias("body"), F.col(text).alias("text"))
    before = saved(trees(texts, vocabulary))
    by_text = "body" in edits.columns
    own = [F.col("body").cast("long").alias("of")] if by_text else []
    asked = edits.select(F.col(doc_id).cast("string").alias("who"), *own, *[F.col(c).cast("long").alias(c) for c in ("start", "end")], F.col("replacement").cast("string").alias("replacement"))
    lists = saved(asked.groupBy("who", *(["of"] if by_text else [])).agg(F.collect_set(F.struct("start", "end", "replacement")).alias("edits"), F.count("*").alias("n")))
    bounds = lists.agg(F.count("*"), F.sum("n"), F.sum(F.expr("aggregate(edits, 0L, (a, e) -> a + coalesce(length(e.replacement), 0))"))).first()
    few = fits((bounds[0] or 0) * 64 + (bounds[1] or 0) * 64 + 4 * (bounds[2] or 0), 1)
    lists = lists.drop("n")
    near = F.broadcast(lists) if few else lists
    touched = texts.join(near, same(texts, near, [("doc", "who"), *([("body", "of")] if by_text else [])])).select("doc", "body", "text", "edits")
    work = touched.join(before.dropDuplicates(["doc", "body"]).withColumnsRenamed({"doc": "d", "body": "b"}), F.expr("doc <=> d and body = b"))
    after = updated(work.select("doc", "body", "text", "ends", "tree", "edits"), vocabulary).dropDuplicates(["doc", "body"])
    after = after.select(F.col("doc").alias("d"), F.col("body").alias("b"), F.get("tree", F.lit(1)).alias("after"), "n_edits", "reencoded")
    total = F.get("tree", F.lit(1))
    joined = before.select("doc", "body", total.alias("n_tokens"), F.size("ends").cast("long").alias("n_leaves")).join(after, F.expr("doc <=> d and body = b"), "left")
    return joined.select(
        F.col("doc").cast(kind).alias("doc_id"), "body", "n_tokens", "n_leaves",
        F.coalesce("n_edits", F.lit(0)).cast("long").alias("n_edits"),
        F.coalesce("after", "n_tokens").alias("n_tokens_after"),
        F.coalesce("reencoded", F.lit(0)).cast("long").alias("reencoded"),
    )


#: Numbers of this many digits are masked by `cleaning_edits`.
LONG_NUMBER = 6


def cleaning(text: str) -> list[Edit]:
    """Edits that drop lines equal to an earlier line of the text and mask long numbers elsewhere."""
    out, seen, at = [], set(), 0
    for line in text.split("\n"):
        if line.strip() and line in seen:
            out.append((at - 1, at + len(line), ""))
        else:
            seen.add(line)
            out += [(at + m.start(), at + m.end(), "0") for m in re.finditer(f"[0-9]{{{LONG_NUMBER},}}", line)]
        at += len(line) + 1
    return out


def cleaning_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, body, start, end, replacement of the edits of `cleaning`, for the text that they are made for."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("body"), F.col(text).alias("text")).where(F.col("text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, found = [], []
            for row, body in enumerate(batch.column(2)):
                own = cleaning(body.as_py())
                which += [row] * len(own)
                found += own
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string()))]
            keys = [batch.column(i).take(pa.array(which, pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*keys, *columns], ["doc_id", "body", "start", "end", "replacement"])

    kinds = rows.select("doc_id").schema.add("body", "long").add("start", "long").add("end", "long").add("replacement", "string")
    return rows.mapInArrow(run, kinds)
