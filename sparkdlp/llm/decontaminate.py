"""Benchmark decontamination by spaced seeds.

Words are lower-cased runs of letters and digits of any script; where words are not spaced (Han, Kana) each sign is
one. A seed looks at eight of the words under it: two blocks of
four with a fixed gap of 0, 4, 8, 12 or 16 ignored words. Seed hashes of benchmark items and documents are
joined; around each hit the document is held against the item word by word, so substituted words are tolerated.

A document overlaps an item if some alignment has a window of WINDOW words of the item in which at most
ALLOWED words differ. Four differing words touch at most four of the six blocks of such a window, and any two
untouched blocks are one of the five seeds, so no overlap is missed. Items with fewer words are compared in one
window of all their words, in which len // 4 - 2 words may differ, for the same reason. An item of four to seven
words has one seed without ignored words, all of it, and matches where it stands word for word. Items of fewer words
are everyday phrases and match nothing.

The documents' seeds first pass a bit table of fixed size made from the benchmark's seeds; what passes is joined
by hash. A benchmark of any size gives the same result, as the table only thins out the join.

Defined cases: null and empty texts overlap nothing. Repeated rows give repeated results, repeated items too.
Only the id and text columns are read, so other columns may have any names. Ids keep their type; null ids are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdlp.llm.common import mix, saved, small, span_hashes, utf8

BLOCK = 4
GAPS = (0, 4, 8, 12, 16)
WINDOW = 24
ALLOWED = 4
#: Bits of the table that thins out the documents' seeds, and where in a seed's hash its three places are read.
TABLE_BITS = 1 << 23
SHIFTS = (0, 20, 40)


_BETWEEN = re.compile(r"[^\w\x00-\x7f]+")
_SIGNS = re.compile("([\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")


def words(text: str | None) -> np.ndarray:
    """64-bit codes of the lower-cased words of letters and digits, in order."""
    text = (text or "").lower()
    if not text.isascii():
        text = _SIGNS.sub(r" \1 ", _BETWEEN.sub(" ", text))
    data = utf8(text)
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57)) | (data >= 128)
    step = np.diff(inside)
    return span_hashes(data, np.flatnonzero(step == 1), np.flatnonzero(step == -1))


def seeds(codes: np.ndarray, short: tuple[int, ...] = ()) -> list[tuple[np.ndarray, int]]:
    """For each mask the hash at every place where it fits, and the mask's length; ``short`` are lengths of whole items."""
    out = []
    n = len(codes)
    with np.errstate(over="ignore"):
        for length in short:
            if length <= n:
                whole = np.zeros(n - length + 1, dtype=np.uint64)
                for i in range(length):
                    whole = whole * np.uint64(0x9E3779B97F4A7C15) + codes[i : n - length + 1 + i]
                out.append((mix(mix(whole) + np.uint64(100 + length)), length))
        if n < 2 * BLOCK:
            return out
        block = np.zeros(n - BLOCK + 1, dtype=np.uint64)
        for i in range(BLOCK):
            block = block * np.uint64(0x9E3779B97F4A7C15) + codes[i : n - BLOCK + 1 + i]
        block = mix(block)
        for number, gap in enumerate(GAPS):
            length = 2 * BLOCK + gap
            if length <= n:
                fit = n - length + 1
                out.append((mix(block[:fit] * np.uint64(0xBF58476D1CE4E5B9) + block[BLOCK + gap : BLOCK + gap + fit] + np.uint64(number)), length))
    return out


def tolerance(n: int) -> tuple[int, int]:
    """Window and number of words that may differ for an item of n words; window 0: the item cannot match."""
    if n < 2 * BLOCK:
        return (n, 0) if n >= BLOCK else (0, 0)
    return (WINDOW, ALLOWED) if n >= WINDOW else (n, n // BLOCK - 2)


def overlap(item: np.ndarray, doc: np.ndarray, shift: int) -> int:
    """Most equal words in a qualifying window when item[0] lies on doc[shift]; 0 if no window qualifies."""
    window, allowed = tolerance(len(item))
    first, last = max(0, -shift), min(len(item), len(doc) - shift)
    if not window or last - first < window:
        return 0
    equal = np.zeros(last - first + 1, dtype=np.int64)
    np.cumsum(item[first:last] == doc[first + shift : last + shift], out=equal[1:])
    best = int((equal[window:] - equal[:-window]).max())
    return best if best >= window - allowed else 0


def _rows(columns: dict[str, list], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], kinds[k]) for k in kinds], list(kinds))


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"item": pa.string(), "code": pa.list_(pa.int64()), "hash": pa.list_(pa.int64()), "place": pa.list_(pa.int32())}
    for batch in batches:
        out: dict[str, list] = {k: [] for k in kinds}
        for item, text in zip(batch.column(0), batch.column(1), strict=True):
            codes = words(text.as_py())
            found = seeds(codes, (len(codes),) if BLOCK <= len(codes) < 2 * BLOCK else ())
            if found:
                out["item"].append(item.as_py())
                out["code"].append(codes.view(np.int64))
                out["hash"].append(np.concatenate([h for h, _ in found]).view(np.int64))
                out["place"].append(np.concatenate([np.arange(len(h), dtype=np.int32) for h, _ in found]))
        yield _rows(out, kinds)


def _thin(table: np.ndarray, bits: int, short: tuple[int, ...]):
    """Stretches of documents around seeds that the bit table lets through."""
    kinds = {"doc": pa.string(), "body": pa.int64(), "start": pa.int64(), "code": pa.list_(pa.int64()), "hash": pa.list_(pa.int64()), "place": pa.list_(pa.int32())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in kinds}
            for doc, body, text in zip(*batch.columns, strict=True):
                codes = words(text.as_py())
                places, hashes, ends = [], [], []
                for values, length in seeds(codes, short):
                    hit = np.arange(len(values))
                    for shift in SHIFTS:
                        low = (values[hit] >> np.uint64(shift)) % np.uint64(bits)
                        hit = hit[((table[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1)) == 1]
                    places.append(hit)
                    hashes.append(values[hit])
                    ends.append(hit + length)
                if not places or not sum(map(len, places)):
                    continue
                place, hashed, end = (np.concatenate(x) for x in (places, hashes, ends))
                order = np.argsort(place, kind="stable")
                place, hashed, end = place[order], hashed[order], end[order]
                # A window that holds the seed reaches at most WINDOW words beyond either end of it.
                low, high = np.maximum(0, place - WINDOW), np.minimum(len(codes), end + WINDOW)
                reach = np.maximum.accumulate(high)
                cuts = np.flatnonzero(low[1:] > reach[:-1]) + 1
                for a, b in zip([0, *cuts], [*cuts, len(place)], strict=True):
                    start = int(low[a:b].min())
                    out["doc"].append(doc.as_py())
                    out["body"].append(body.as_py())
                    out["start"].append(start)
                    out["code"].append(codes[start : int(high[a:b].max())].view(np.int64))
                    out["hash"].append(hashed[a:b].view(np.int64))
                    out["place"].append((place[a:b] - start).astype(np.int32))
            yield _rows(out, kinds)

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        best = []
        for item, doc, shifts in zip(batch.column("item_code"), batch.column("code"), batch.column("shifts"), strict=True):
            item, doc = (np.asarray(x.values, dtype=np.int64) for x in (item, doc))
            best.append(max(overlap(item, doc, shift) for shift in shifts.as_py()))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc", "body", "item", "n_words")), pa.array(best, pa.int32())], ["doc", "body", "item", "n_words", "matched"])


def overlaps(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
             bits: int = TABLE_BITS) -> DataFrame:
    """One row per document text and item that overlap: doc_id, body (hash of the text), item_id, matched, n_words.

    matched: most equal words in a window; n_words: words of the item.
    """
    rows = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text"))
    tests = saved(rows.mapInArrow(_item_seeds, "item string, code array<long>, hash array<long>, place array<int>"))
    tests = tests.withColumn("key", F.xxhash64("item", "code"))
    seeded = tests.select("key", F.explode(F.arrays_zip("hash", "place")).alias("s")).select("key", F.col("s.hash").alias("hash"), F.col("s.place").alias("at"))
    low = f"pmod(part, {bits}L)"
    parts = seeded.select(F.explode(F.array(*[F.shiftrightunsigned("hash", s) for s in SHIFTS])).alias("part"))
    packed = parts.groupBy(F.expr(f"{low} div 64").alias("cell")).agg(F.expr(f"bit_or(shiftleft(1L, cast({low} % 64 as int)))").alias("mask"))
    table = np.zeros(bits // 64, dtype=np.uint64)
    for cell, mask in packed.collect():  # at most bits / 64 rows
        table[cell] = np.uint64(mask & 0xFFFFFFFFFFFFFFFF)

    # Lengths of the short items, four at most; documents look for these alone.
    size = F.size("code")
    short = tuple(sorted(r[0] for r in tests.where(size < 2 * BLOCK).select(size).distinct().collect()))
    texts = docs.select(F.col(doc_id).cast("string").alias("doc"), F.xxhash64(F.col(text)).alias("body"), F.col(text).alias("text"))
    texts = texts.where(F.col("text").isNotNull())
    stretches = texts.mapInArrow(_thin(table, bits, short), "doc string, body long, start long, code array<long>, hash array<long>, place array<int>")
    stretches = saved(stretches.withColumn("piece", F.xxhash64("doc", "body", "start")))
    hits = stretches.select("piece", F.explode(F.arrays_zip("hash", "place")).alias("s")).select("piece", F.col("s.hash").alias("hash"), F.col("s.place").alias("place"))
    # Copies of a text meet here as one piece each; the shifts of a piece and an item are at most its words.
    pairs = hits.join(seeded, "hash").groupBy("piece", "key").agg(F.collect_set(F.col("place") - F.col("at")).alias("shifts"))
    whole = stretches.select("piece", "doc", "body", "code").dropDuplicates(["piece"])
    parts = tests.select("key", "item", F.col("code").alias("item_code"), F.size("code").alias("n_words")).dropDuplicates(["key"])
    found = pairs.join(whole, "piece").join(parts, "key")
    checked = found.select("doc", "body", "item", "n_words", "code", "item_code", "shifts").mapInArrow(_verify, "doc string, body long, item string, n_words int, matched int")
    best = checked.where("matched > 0").groupBy("doc", "body", "item", "n_words").agg(F.max("matched").alias("matched"))
    return best.select(F.col("doc").cast(docs.schema[doc_id].dataType).alias("doc_id"), "body", F.col("item").cast(items.schema[item_id].dataType).alias("item_id"), F.col("matched").cast("long").alias("matched"), F.col("n_words").cast("long").alias("n_words"))


def keep_clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", **names) -> DataFrame:
    """The documents that overlap no item; columns as they came."""
    text = names.get("text", "text")
    found = overlaps(docs, items, doc_id, **names)
    bad = saved(found.select(F.col("doc_id").alias("bad_id"), F.col("body").alias("bad_body")).distinct())
    bad = small(bad, 64)
    return docs.join(bad, docs[doc_id].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs[text]) == bad["bad_body"]), "left_anti")
