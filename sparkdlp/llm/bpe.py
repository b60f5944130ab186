"""Byte-level BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the bytes cuts every text into chunks; cuts follow the content, so equal passages give equal
chunks wherever they stand. What of a chunk lies between its first and last safe boundary is its body. A safe
boundary is a blank or line break right after a visible ASCII character: no pre-token reaches across it, so a
body is encoded the same in any text. Bodies that occur more than once are encoded once, in one of their texts,
and joined back by hash. Bitmaps of bounded size tell where these bodies are and which texts have any, so only such
texts are shuffled; what a bitmap takes for one of them by chance is encoded like any other. The joins between chunks (everything outside shared bodies, from safe boundary to safe
boundary) are repaired by re-encoding; both ends lie on safe boundaries, so the ids agree exactly with those of
the whole text.

Defined cases: null is encoded as the empty text. Texts without a safe boundary are encoded whole. The strings of
special tokens become their ids. Rows that repeat an id are told apart by their texts; repeated rows give
repeated results. An empty table gives an empty result. Other columns than those named are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdlp.llm.common import mix, same, saved, utf8

#: Fixed value: how byte-level BPE cuts a text into pre-tokens.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Mean chunk length is about 2 ** CHUNK_BITS bytes over MIN_CHUNK; bodies below MIN_BODY are not worth sharing.
CHUNK_BITS = 10
MIN_CHUNK = 256
MIN_BODY = 96

#: Bits of a bitmap, 16 MB at most; a smaller one has 16 for each member. Beyond some millions of members more others pass.
MARK_BITS = 1 << 27
_ROW_BITS = 1 << 15  # of one row of Spark's bitmap functions


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: bytes that print stand for themselves, others follow from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    table = {chr(b): b for b in own}
    for at, b in enumerate(b for b in range(256) if b not in own):
        table[chr(256 + at)] = b
    return table


def load(vocabulary: bytes) -> tiktoken.Encoding:
    """An encoder from the bytes of a tokenizer JSON file whose ids follow the order of its merges."""
    parsed = json.loads(vocabulary)
    model, letters = parsed["model"], byte_letters()
    special = {t["content"]: t["id"] for t in parsed.get("added_tokens", [])}
    ranks = {bytes(letters[c] for c in token): number for token, number in model["vocab"].items() if token not in special}
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged != sorted(merged):
        raise ValueError("the vocabulary's ids do not follow its merges")
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def ids_of(encoder: tiktoken.Encoding, text: str) -> np.ndarray:
    return np.asarray(encoder.encode(text, allowed_special="all"), dtype=np.uint32)


_GEAR = mix(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)


def cuts(data: np.ndarray, bits: int = CHUNK_BITS, least: int = MIN_CHUNK) -> list[int]:
    """Chunk borders from a rolling hash of the last 32 bytes, none closer than `least`."""
    if len(data) <= least:
        return [0, len(data)]
    rolling = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        later = rolling[step:] + (rolling[:-step] << np.uint32(step))
        rolling = np.concatenate([rolling[:step], later])
    spots = np.flatnonzero((rolling >> np.uint32(32 - bits)) == 0) + 1
    out = [0]
    for spot in spots.tolist():
        if spot - out[-1] >= least and spot < len(data):
            out.append(spot)
    return [*out, len(data)]


def safe_boundaries(data: np.ndarray) -> np.ndarray:
    """Places of a blank or line break right after a visible ASCII character."""
    if len(data) < 2:
        return np.zeros(0, dtype=np.int64)
    after = (data[:-1] > 32) & (data[:-1] < 127)
    return np.flatnonzero(after & ((data[1:] == 32) | (data[1:] == 10))) + 1


def bodies(data: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each chunk's body."""
    safe, edges = safe_boundaries(data), cuts(data)
    out = []
    if len(safe):
        first = np.searchsorted(safe, edges[:-1], side="right")
        last = np.searchsorted(safe, edges[1:], side="left") - 1
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            if b > a and safe[b] - safe[a] >= MIN_BODY:
                out.append((int(safe[a]), int(safe[b])))
    return out


def hashed_bodies(data: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Start, end and the two halves of the hash of each body."""
    for a, b in bodies(data):
        digest = xxhash.xxh3_128_digest(data[a:b].data)
        yield a, b, int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        which, start, end, one, two = [], [], [], [], []
        for row, text in enumerate(batch.column("text")):
            for a, b, h1, h2 in hashed_bodies(utf8(text.as_py())):
                which.append(row)
                start.append(a)
                end.append(b)
                one.append(h1)
                two.append(h2)
        at = pa.array(which, pa.int64())
        arrays = [batch.column("doc").take(at), batch.column("body").take(at), *(pa.array(x, pa.int64()) for x in (start, end, one, two))]
        yield pa.RecordBatch.from_arrays(arrays, ["doc", "body", "start", "end", "h1", "h2"])


def _width(encoder: tiktoken.Encoding) -> type:
    """How the ids of bodies are kept between the stages."""
    return np.uint16 if encoder.max_token_value < 1 << 16 else np.uint32


def _encode_owned(vocabulary, marks) -> Callable:
    """h1, h2 and ids of the bodies whose place is in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder, bits = encoder or load(vocabulary.value), marks.value
            one, two, found = [], [], []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
                data, done = utf8(text.as_py()), set()
                for a, b, h1, h2 in hashed_bodies(data):
                    slot = (key ^ h1) & (8 * len(bits) - 1)
                    if bits[slot >> 3] >> (slot & 7) & 1 and (h1, h2) not in done:
                        done.add((h1, h2))
                        one.append(h1)
                        two.append(h2)
                        found.append(ids_of(encoder, data[a:b].tobytes().decode()).astype(_width(encoder)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(found, pa.binary())], ["h1", "h2", "ids"])

    return run


def repaired(encoder: tiktoken.Encoding, text: str, shared: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
    """The ids of the whole text from the ids of some bodies (start, end, ids): what lies between is encoded anew."""
    if not shared:
        return ids_of(encoder, text)
    data, out, at = utf8(text), [], 0
    for start, end, ids in sorted(shared, key=lambda s: s[0]):
        if start > at:
            out.append(ids_of(encoder, data[at:start].tobytes().decode()))
        out.append(ids)
        at = end
    if at < len(data):
        out.append(ids_of(encoder, data[at:].tobytes().decode()))
    return np.concatenate(out).astype(np.uint32)


def _assemble(vocabulary, finish: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or load(vocabulary.value)
            counts, values, coded, decoded = [], [], [], []
            spans = batch.column("shared") if "shared" in batch.schema.names else [None] * batch.num_rows
            for text, shared in zip(batch.column("text"), spans, strict=True):
                # A text without shared bodies has a null here, whose Arrow scalar has no truth value.
                known = {s["start"]: (s["start"], s["end"], np.frombuffer(s["ids"], dtype=_width(encoder))) for s in (None if shared is None else shared.as_py()) or []}
                ids = repaired(encoder, text.as_py() or "", list(known.values()))
                counts.append(len(ids))
                if finish == "ids":
                    values.append(ids.astype(np.int32))
                else:
                    coded.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    decoded.append(hashlib.sha256(decode_ids(encoder, ids).encode()).hexdigest())
            made = [pa.array(counts, pa.int64())]
            if finish == "ids":
                made += [pa.array(values, pa.list_(pa.int32()))]
            else:
                made += [pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
            names = ["n_tokens", "ids"] if finish == "ids" else ["n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("body"), *made], ["doc", "body", *names])

    return run


def decode_ids(encoder: tiktoken.Encoding, ids: np.ndarray) -> str:
    return encoder.decode_bytes(ids.tolist()).decode("utf-8", errors="replace")


def _vocabulary(spark: SparkSession, path: str | None):
    with open(os.fspath(path or default_path()), "rb") as file:
        return spark.sparkContext.broadcast(file.read())  # one vocabulary file, whatever the corpus


def shared_bodies(texts: DataFrame) -> DataFrame:
    """All places of bodies that occur at least twice: doc, body, start, end, h1, h2, owner (one place of each)."""
    places = saved(texts.select("doc", "body", "text").mapInArrow(_chunk_rows, "doc string, body long, start long, end long, h1 long, h2 long"))
    counted = places.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("doc", "body", "start")).alias("first"))
    again = saved(counted.where("n > 1").drop("n"))  # as rows of its own, so that a join with hot bodies can be split
    owner = F.struct("doc", "body", "start").eqNullSafe(F.col("first"))
    return places.join(again, ["h1", "h2"]).select("doc", "body", "start", "end", "h1", "h2", owner.alias("owner"))


def marked(rows: DataFrame, key: str) -> tuple[DataFrame, int]:
    """A bitmap of the key's values (long) in saved rows (n, the first is 1, and bits), and how many bits it has."""
    size = max(_ROW_BITS, min(MARK_BITS, 1 << (16 * rows.count()).bit_length()))
    slots = rows.select(F.expr(f"pmod({key}, {size}L) + 1").alias("slot"))
    return saved(slots.groupBy(F.expr("bitmap_bucket_number(slot)").alias("n")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits"))), size


def in_bitmap(rows: DataFrame, key: str, marks: tuple[DataFrame, int]) -> DataFrame:
    """The rows with hit: whether the key is in the bitmap, which is broadcast."""
    bitmap, size = marks
    keyed = rows.withColumn("slot", F.expr(f"pmod({key}, {size}L)"))
    met = keyed.join(F.broadcast(bitmap), F.expr(f"slot div {_ROW_BITS} + 1") == F.col("n"), "left")
    byte = f"conv(hex(substring(bits, int(slot % {_ROW_BITS}) div 8 + 1, 1)), 16, 10)"
    return met.withColumn("hit", F.expr(f"coalesce((shiftright(int({byte}), int(slot % 8)) & 1) = 1, false)")).drop("slot", "n", "bits")


def _gathered(marks: tuple[DataFrame, int]) -> bytes:
    """The bitmap as one value, MARK_BITS / 8 bytes at most."""
    bitmap, size = marks
    out = bytearray(size // 8)
    for r in bitmap.toLocalIterator():
        out[(r["n"] - 1) * _ROW_BITS // 8 : r["n"] * _ROW_BITS // 8] = r["bits"]
    return bytes(out)


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, finish: str = "ids") -> DataFrame:
    """One row per document: doc_id, body (hash of the text), n_tokens, and ids as array<int>.

    With finish="digest" the ids are decoded again and ids_sha256 and decoded_sha256 stand in their place.
    """
    spark, vocabulary = docs.sparkSession, _vocabulary(docs.sparkSession, path)
    kind, key = docs.schema[doc_id].dataType, "xxhash64(doc, body)"
    texts = docs.select(F.col(doc_id).cast("string").alias("doc"), F.xxhash64(F.col(text)).alias("body"), F.col(text).alias("text"))
    places = saved(shared_bodies(texts))
    owned = spark.sparkContext.broadcast(_gathered(marked(places.where("owner"), f"({key} ^ h1)")))
    coded = texts.select(F.expr(key).alias("key"), "text").mapInArrow(_encode_owned(vocabulary, owned), "h1 long, h2 long, ids binary")
    once = saved(coded.dropDuplicates(["h1", "h2"]))
    filled = places.join(once, ["h1", "h2"]).groupBy("doc", "body").agg(F.collect_list(F.struct("start", "end", "ids")).alias("shared"))
    # Without a shuffle: nearly all texts without a shared body are told, and encoded where they are.
    told = in_bitmap(texts, key, marked(places.select("doc", "body").distinct(), key))
    mixed = told.where("hit").drop("hit")
    met = mixed.join(filled, same(mixed, filled, [("doc", "doc"), ("body", "body")]), "left")
    parts = [told.where("not hit").drop("hit"), met.select(mixed["doc"], mixed["body"], mixed["text"], "shared")]
    made = {"ids": "ids array<int>", "digest": "ids_sha256 string, decoded_sha256 string"}[finish]
    out = [t.mapInArrow(_assemble(vocabulary, finish), f"doc string, body long, n_tokens long, {made}") for t in parts]
    both = reduce(DataFrame.unionByName, out)
    return both.select(F.col("doc").cast(kind).alias("doc_id"), *[c for c in both.columns if c != "doc"])


def decode(encoded: DataFrame, ids: str = "ids", to: str = "text", path: str | None = None) -> DataFrame:
    """The rows with the text of their ids; null ids give null."""
    vocabulary = _vocabulary(encoded.sparkSession, path)
    kinds = encoded.drop(to).schema.add(to, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or load(vocabulary.value)
            texts = [None if x is None else decode_ids(encoder, np.asarray(x, dtype=np.uint32)) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, to])

    return encoded.drop(to).mapInArrow(run, kinds)
