"""Language identification by rank-order profiles.

A profile is a language's most frequent letter n-grams (one to three code points, word ends marked) in order
of frequency. A document's own n-grams are ranked the same way; the language whose profile has the smallest
sum of out-of-place distances is the prediction.

Defined cases: a null text, an empty text and a text without a letter give ``und`` with score 0. Ties in
frequency are ordered by the n-gram, ties between languages by name. Repeated rows give repeated results. An
empty table gives an empty result; without any training row every text is ``und``. Only the named columns are
read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkdlp.llm.common import fresh

#: n-grams in a language profile, and n-grams of a document that are compared.
PROFILE_SIZE = 400
DOC_SIZE = 300
#: Labelled rows per language that a profile is fitted on; a documented bound, chosen by hash of the id.
TRAIN_ROWS = 20_000
#: Below this score no profile is near enough to call the text that language.
MIN_SCORE = 0.3
UNKNOWN = "und"

_FLUSH = 400_000


@cache
def letter_table() -> np.ndarray:
    """For each code point: 0 if it is no letter, else its lower-case form (first code point)."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            table[point] = ord(char.lower()[0])
    return table


def grams(text: str, table: np.ndarray) -> np.ndarray:
    """All n-grams of the words, as integers of 21 bits per code point; a 1 stands for a word's end."""
    points = table[np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)]
    if not points.any():
        return np.zeros(0, dtype=np.int64)
    marked = np.ones(len(points) + 2, dtype=np.int64)
    marked[1:-1] = np.where(points == 0, 1, points)
    keep = np.ones(len(marked), dtype=bool)
    keep[1:] = (marked[1:] != 1) | (marked[:-1] != 1)
    s = marked[keep]
    one = s[s != 1]
    two = (s[:-1] << 21) | s[1:]
    three = ((s[:-2] << 42) | (s[1:-1] << 21) | s[2:])[s[1:-1] != 1]
    return np.concatenate([one, two, three])


def ranked(codes: np.ndarray, top: int) -> np.ndarray:
    """The most frequent codes, most frequent first, equal counts by code."""
    values, counts = np.unique(codes, return_counts=True)
    return values[np.lexsort((values, -counts))[:top]]


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", top: int = PROFILE_SIZE,
        train_rows: int = TRAIN_ROWS) -> dict[str, list[int]]:
    """Profiles by language, from rows with both text and lang.

    At most about ``train_rows`` rows per language take part, chosen by the hash of the key. What comes to the
    driver is ``top`` n-grams per language.
    """
    rows = labelled.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN))
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return {}
    share = F.lit(1.0)
    for name, n in totals.items():
        if n > train_rows:
            share = F.when(F.col("lang") == name, train_rows / n).otherwise(share)
    draw = F.pmod(F.xxhash64(F.col("key"), F.lit(8)), F.lit(1_000_000)) / 1_000_000
    rows = rows.where(draw < share).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, size = letter_table(), {}, 0

        def out() -> Iterator[pa.RecordBatch]:
            for name, parts in held.items():
                values, at = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
                n = np.bincount(at, weights=np.concatenate([c for _, c in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(values), pa.string()), pa.array(values), pa.array(n)], ["lang", "gram", "n"])

        for batch in batches:
            for name, body in zip(batch.column(0), batch.column(1), strict=True):
                values, counts = np.unique(grams(body.as_py(), table), return_counts=True)
                held.setdefault(name.as_py(), []).append((values, counts))
                size += len(values)
            if size > _FLUSH:
                yield from out()
                held, size = {}, 0
        yield from out()

    counted = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", "gram", "rank")
    profiles: dict[str, list[int]] = {name: [] for name in sorted(totals)}
    for row in sorted(best.collect(), key=lambda r: (r["lang"], r["rank"])):
        profiles[row["lang"]].append(row["gram"])
    return {name: found for name, found in profiles.items() if found}


def distances(doc: np.ndarray, known: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """Mean out-of-place distance to each language, 0 to 1; places[l, i] is the rank of known[i], or size."""
    at = np.minimum(np.searchsorted(known, doc), len(known) - 1)
    place = np.where(known[at] == doc, places[:, at], size)
    off = np.where(place == size, size, np.minimum(np.abs(place - np.arange(len(doc))), size))
    return off.mean(axis=1) / size


def _recogniser(profiles: dict[str, list[int]], doc_size: int = DOC_SIZE):
    """A column function from texts to structs of lang_pred and score (1 minus the mean distance).

    Only the texts go to the workers, and only the verdicts come back.
    """
    names = list(profiles)
    size = max((len(p) for p in profiles.values()), default=1)
    known = np.unique(np.concatenate([np.asarray(p, dtype=np.int64) for p in profiles.values()])) if names else np.zeros(1, dtype=np.int64)
    places = np.full((max(1, len(names)), len(known)), size, dtype=np.int64)
    for i, name in enumerate(names):
        places[i, np.searchsorted(known, np.asarray(profiles[name], dtype=np.int64))] = np.arange(len(profiles[name]))

    def judge(texts: pa.Array) -> pa.Array:
        table = letter_table()
        said, scores = [], []
        for body in texts:
            doc = ranked(grams(body.as_py() or "", table), doc_size)
            if not len(doc) or not names:
                said.append(UNKNOWN)
                scores.append(0.0)
                continue
            far = distances(doc, known, places, size)
            said.append(names[int(np.argmin(far))])
            scores.append(float(1 - far.min()))
        return pa.StructArray.from_arrays([pa.array(said, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return F.arrow_udf(judge, "lang_pred string, score double")


def predict(docs: DataFrame, profiles: dict[str, list[int]], keys: list[str], text: str = "text", doc_size: int = DOC_SIZE) -> DataFrame:
    """keys plus lang_pred and score (1 minus the mean distance) for every row; texts are read whole."""
    verdict = fresh("verdict", keys)
    found = docs.select(*keys, _recogniser(profiles, doc_size)(F.col(text)).alias(verdict))
    return found.select(
        *keys, F.col(verdict)["lang_pred"].alias(fresh("lang_pred", keys)), F.col(verdict)["score"].alias(fresh("score", keys))
    )


def held_out(doc_id: str = "doc_id") -> Column:
    """The quarter of the documents that training never sees: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, **options) -> DataFrame:
    """Fits on the labelled rows that are not held out and predicts every row: doc_id, held_out, lang_pred, score."""
    trained = fit(docs.where(~held_out() & F.col("doc_id").isNotNull()), **options)
    marked = docs.select("doc_id", "text", held_out().alias("held_out"))
    return predict(marked, trained, ["doc_id", "held_out"])


def keep_known(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", least: float = MIN_SCORE) -> DataFrame:
    """The documents whose language is recognised with at least this score; columns as they came."""
    trained = fit(docs.where(~held_out(key) & F.col(key).isNotNull()), text, lang, key)
    found = predict(docs, trained, docs.columns, text)
    said, score = found.columns[-2:]
    return found.where((F.col(said) != UNKNOWN) & (F.col(score) >= least)).select(*docs.columns)
