"""Quality rules with a trained model.

Counts of words, symbols, repeated lines and repeated eight-word windows form the base rules. A logistic
regression on hashed words, word pairs and character runs is trained on labelled rows, calibrated on labelled
rows it has not seen, and scores every whole text in Arrow batches against a fixed threshold.

Defined cases: a null text has no words and fails the base. Labels of null quality or for unknown documents are
not used; contradicting labels of a document count by their mean. A labelled id that is repeated counts once,
with one of its texts. Without labels of both kinds every probability is one half and only the base decides. Repeated
rows give repeated results; an empty table gives an empty one.
Columns other than id, text and the label are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkdlp.llm import linear
from sparkdlp.llm.common import mix, span_hashes, utf8, word_spans

#: Labelled rows that the model is fitted and calibrated on, always whole texts (one row in four for calibration), and
#: features that these rows may have together; documented bounds.
TRAIN_ROWS = 4000
TRAIN_FEATURES = 1 << 24
KEEP = 0.5
WINDOW = 8
FEW_WORDS = 20
REPEAT_PERCENT = 30
SYMBOLS = b"#*$%&|<>"

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True


def counts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of UTF-8 bytes and their word spans."""
    points = int(((data[: len(data)] & 0xC0) != 0x80).sum())
    blanks = len(data) - int((ends - starts).sum())
    seen: set[bytes] = set()
    twice = 0
    for line in data.tobytes().split(b"\n"):
        if line.strip(b" \t\r\x0b\x0c"):
            twice += line in seen
            seen.add(line)
    repeated = 0
    if len(starts) > WINDOW:
        words = span_hashes(data, starts, ends)
        with np.errstate(over="ignore"):
            windows = np.zeros(len(words) - WINDOW + 1, dtype=np.uint64)
            for i in range(WINDOW):
                windows = windows * np.uint64(0x9E3779B97F4A7C15) + words[i : i + len(windows)]
        _, at, found = np.unique(mix(windows), return_inverse=True, return_counts=True)
        begins = np.flatnonzero(found[at] > 1)
        cover = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(cover, begins, 1)
        np.add.at(cover, begins + WINDOW, -1)
        repeated = int((np.cumsum(cover[:-1]) > 0).sum())
    return len(starts), points - blanks, int(_SYMBOL[data].sum()), twice, repeated


def bounded(rows: DataFrame, order: list, most: int, features: int = TRAIN_FEATURES) -> DataFrame:
    """The first `most` rows in that order whose texts (of column "bytes" bytes) cannot have more features in all.

    A text has at most a feature for each byte, each word and each pair of words, and SLOTS in all.
    """
    cost = F.least(F.lit(linear.SLOTS), F.coalesce("bytes", F.lit(0)) * 2 + 2)
    so_far = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # `most` rows at most
    return rows.orderBy(*order).limit(most).withColumn("so_far", F.sum(cost).over(so_far)).where(F.col("so_far") <= features).drop("so_far", "bytes")


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, doc_id: str = "doc_id", text: str = "text", parts: tuple[str, ...] = ()) -> DataFrame:
    """At most `rows` labelled rows of docs with "truth" (0 or 1), by hash of the id.

    An id counts once, with its row of the lowest hash of text and `parts`, however often it is repeated.
    """
    told = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("told_id"))
    told = told.agg((F.avg(label) >= 0.5).cast("int").alias("truth")).orderBy(F.xxhash64("told_id", F.lit(2)), "told_id").limit(rows)
    body = F.xxhash64(text, *parts)
    keys = docs.select(F.col(doc_id).alias("told_id"), body.alias("told_body"), F.octet_length(F.col(text)).alias("bytes"))
    keys = keys.join(F.broadcast(told), "told_id").groupBy("told_id", "truth").agg(F.min(F.struct("told_body", "bytes")).alias("one"))
    drawn = bounded(keys.select("told_id", "truth", "one.*"), [F.xxhash64("told_id", F.lit(2)), "told_id"], rows)
    found = docs.join(F.broadcast(drawn), (docs[doc_id] == drawn["told_id"]) & (body == drawn["told_body"]))  # `rows` keys at most
    return found.dropDuplicates(["told_id"])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
          rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Model and calibration weights. What comes to the driver are the features of `rows` rows, TRAIN_FEATURES in all."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [linear.features_of(t.as_py()) for t in batch.column(2)]
            lists = [pa.array([f[i] for f in found], pa.list_(kind)) for i, kind in enumerate((pa.int32(), pa.float32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *lists], ["id", "truth", "at", "value"])

    rows_of = sample(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), labels.select(F.col(doc_id).alias("id"), label), label, rows, "id")
    rows_of = rows_of.select(F.xxhash64("id").alias("id"), "truth", "text")
    found = rows_of.mapInArrow(extract, "id long, truth int, at array<int>, value array<float>").toArrow()
    order = np.argsort(found["id"].to_numpy(), kind="stable")
    at, value = ([np.asarray(x.values) for x in found[c]] for c in ("at", "value"))
    sparse = [(at[i], value[i]) for i in order]
    truth = found["truth"].to_numpy()[order]
    held = np.arange(len(truth)) % 4 == 3
    model = linear.fit([r for r, h in zip(sparse, held, strict=True) if not h], truth[~held]) if len(truth) else np.zeros(linear.SLOTS + 1)
    scores = np.asarray([linear.raw_score(model, *r) for r, h in zip(sparse, held, strict=True) if h])
    return model, linear.calibrate(scores, truth[held]) if len(scores) and model.any() else np.zeros(2)


def judge(docs: DataFrame, model: np.ndarray, weights: np.ndarray, doc_id: str = "doc_id", text: str = "text", keep: float = KEEP) -> DataFrame:
    """doc_id, the base counts, base_failed, probability (of good quality) and kept for every row."""
    small = model.astype(np.float32)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kinds = rows.select("doc_id").schema
    for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"):
        kinds = kinds.add(name, "long")
    kinds = kinds.add("base_failed", "boolean").add("probability", "double").add("kept", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, chance = [], []
            for body in batch.column(1):
                data = utf8(body.as_py())
                spans = word_spans(data)
                base.append(counts(data, *spans))
                chance.append(float(linear.calibrated(weights, linear.raw_score(small, *linear.text_features(data, *spans)))))
            table = np.asarray(base, dtype=np.int64).reshape(len(base), 5)
            failed = (table[:, 0] < FEW_WORDS) | (100 * table[:, 4] > REPEAT_PERCENT * table[:, 0])
            odds = np.asarray(chance, dtype=np.float64)
            columns = [batch.column(0), *(pa.array(c) for c in table.T), pa.array(failed), pa.array(odds), pa.array(~failed & (odds >= keep))]
            yield pa.RecordBatch.from_arrays(columns, kinds.names)

    return rows.mapInArrow(run, kinds)
