"""Quality classification by co-training two views.

The content view sees hashed words, word pairs and character runs. The metadata view sees the page's columns
(source, language) and layout figures (lengths, lines, shares of capitals, digits and marks), never a word. Both
are trained on labelled rows. In each of a few rounds both score every unlabelled document on Spark; each view labels
the documents that it is most sure of, of each class and of different texts, and hands them to the other. Only these
(a bounded number) come to the driver for the next fit. In the end the views are calibrated on labelled rows that
neither has seen, the calibrated views are combined there, and every document is scored.

Defined cases: a null text has no words and zero layout figures. Labels of null quality are not used;
contradicting labels count by their mean. A labelled id that is repeated counts once, with one of its rows; of equal
unlabelled texts the one with the lowest id can be handed over. Without labels of both kinds every probability is one
half. Repeated rows give repeated results; an empty table gives an empty result. Null metadata is a value of its own. Other
columns than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdlp.llm import linear
from sparkdlp.llm.common import saved, utf8, word_spans
from sparkdlp.llm.quality_rules import bounded, sample

#: Labelled rows of the fit, always whole texts (one in four is kept for calibration), and documents that a view hands
#: over in a round, by class in the proportion of the labelled rows; documented bounds. The rows of a fit and those
#: handed over in a round have TRAIN_FEATURES and PSEUDO_FEATURES features at most (see quality_rules.bounded).
TRAIN_ROWS = 3000
PSEUDO_ROWS = 300
PSEUDO_FEATURES = 1 << 21
ROUNDS = 2
#: A view labels only rows it is at least this sure of.
SURE = 0.9
KEEP = 0.5
META_SLOTS = 1 << 12


def layout(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict[str, float]:
    """Figures of a page's layout, each from 0 to about 1."""
    n = max(1, len(data))
    found = np.bincount(data, minlength=256)
    lines, capitals, digits = 1 + int(found[10]), int(found[65:91].sum()), int(found[48:58].sum())
    letters = capitals + int(found[97:123].sum()) + int(found[128:].sum())
    marks = int(found[33:127].sum()) - capitals - int(found[97:123].sum()) - digits
    lengths = ends - starts
    return {
        "bytes": np.log1p(len(data)) / 20,
        "words": np.log1p(len(starts)) / 16,
        "lines": np.log1p(lines) / 12,
        "line": np.log1p(len(data) / lines) / 14,
        "word": min(1.0, float(lengths.mean()) / 20) if len(lengths) else 0.0,
        "capitals": capitals / max(1, letters),
        "digits": digits / n,
        "marks": marks / n,
    }


@lru_cache(maxsize=4096)
def _slot(name: str) -> int:
    return xxhash.xxh64_intdigest(name) % META_SLOTS


def meta_features(values: list, figures: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """One slot for each column's value; each figure as twenty steps of which the neighbouring two are on."""
    names, weights = [], []
    for at, value in enumerate(values):
        names.append(f"c{at}={value}")
        weights.append(1.0)
    for name, figure in figures.items():
        place = min(max(float(figure), 0.0), 1.0) * 20
        low = min(19, int(place))
        names += [f"{name}:{low}", f"{name}:{low + 1}"]
        weights += [1.0 - (place - low), place - low]
    at = np.asarray([_slot(n) for n in names])
    order, inverse = np.unique(at, return_inverse=True)
    summed = np.bincount(inverse, weights=weights)
    return order.astype(np.int32), (summed / np.sqrt(len(names))).astype(np.float32)


def views(values: list, text: str | None):
    data = utf8(text)
    spans = word_spans(data)
    return linear.text_features(data, *spans), meta_features(values, layout(data, *spans))


def _lists(batch: pa.RecordBatch, n_meta: int) -> Iterator[tuple]:
    """Both views of each row of a batch that ends in the columns of the page and the text."""
    *about, bodies = batch.columns[-1 - n_meta :]
    for i, body in enumerate(bodies):
        yield views([c[i].as_py() for c in about], body.as_py())


def _gathered(rows: DataFrame, n_meta: int) -> tuple[np.ndarray, np.ndarray, linear.Rows, linear.Rows]:
    """truth, view (see `handed`) and both views' features of a bounded number of rows, in the order of id and body."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in range(4)]
            for content, meta in _lists(batch, n_meta):
                for held, part in zip(out, (*content, *meta), strict=True):
                    held.append(part)
            lists = [pa.array(x, pa.list_(kind)) for x, kind in zip(out, (pa.int32(), pa.float32()) * 2, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *lists], ["id", "body", "truth", "view", "ca", "cv", "ma", "mv"])

    kinds = "id long, body long, truth int, view int, ca array<int>, cv array<float>, ma array<int>, mv array<float>"
    table = rows.mapInArrow(extract, kinds).toArrow()
    ids, bodies, truth, view = (table[c].to_numpy() for c in ("id", "body", "truth", "view"))
    order = np.lexsort((view, bodies, ids))
    columns = [[np.asarray(x.values) for x in table[c]] for c in ("ca", "cv", "ma", "mv")]
    return truth[order], view[order], [(columns[0][i], columns[1][i]) for i in order], [(columns[2][i], columns[3][i]) for i in order]


def log_odds(rows: DataFrame, models: list[np.ndarray], n_meta: int) -> DataFrame:
    """id, body, words (hash of the text), bytes and both views' log odds of every row of id, body, words, bytes, meta, text."""
    content_model, meta_model = (m.astype(np.float32) for m in models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(linear.raw_score(content_model, *content), linear.raw_score(meta_model, *meta)) for content, meta in _lists(batch, n_meta)]
            odds = np.asarray(found, dtype=np.float64).reshape(len(found), 2).T.copy()
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array(x) for x in odds)], kinds.names)

    kinds = rows.select("id", "body", "words", "bytes").schema.add("odds0", "double").add("odds1", "double")
    return rows.mapInArrow(run, kinds)


def handed(scored: DataFrame, before: DataFrame | None, good: float, most: int = PSEUDO_ROWS) -> DataFrame:
    """id, body, truth and view: the rows that each view is most sure of, labelled for the fit of the other view ("view").

    scored: one row for each different text. What a view was handed before is not handed to it again.
    """
    out = None
    for giver in (0, 1):
        left = scored
        if before is not None:
            left = left.join(F.broadcast(before.where(F.col("view") == 1 - giver).select("words")), "words", "left_anti")  # PSEUDO_ROWS a round
        for label, share in ((1, good), (0, 1 - good)):
            odds = F.col(f"odds{giver}") * (1 if label else -1)
            sure = left.where(odds >= float(np.log(SURE / (1 - SURE)))).withColumn("sure", odds)
            order = [F.desc("sure"), F.xxhash64("words"), "words"]
            part = bounded(sure, order, max(1, round(share * most)), PSEUDO_FEATURES // 4)
            part = part.select("id", "body", "words", F.lit(label).alias("truth"), F.lit(1 - giver).alias("view"))
            out = part if out is None else out.unionByName(part)
    return out


def train(docs: DataFrame, labels: DataFrame, meta: tuple[str, ...] = ("source", "lang"), doc_id: str = "doc_id", text: str = "text",
          label: str = "quality", train_rows: int = TRAIN_ROWS, rounds: int = ROUNDS, pseudo_rows: int = PSEUDO_ROWS):
    """Both models and their calibrations: content, metadata, and of the two calibrated views together."""
    about = [f"m{i}" for i in range(len(meta))]
    rows = docs.select(F.col(doc_id).alias("id"), *[F.col(c).cast("string").alias(m) for c, m in zip(meta, about, strict=True)], F.col(text).alias("text"))
    facts = labels.select(F.col(doc_id).alias("id"), label)
    drawn = sample(rows, facts, label, train_rows, "id", parts=tuple(about))
    truth, _, *sides = _gathered(drawn.select(F.xxhash64("id").alias("id"), F.col("told_body").alias("body"), "truth", F.lit(0).alias("view"), *about, "text"), len(meta))
    held, slots = np.arange(len(truth)) % 4 == 3, (linear.SLOTS, META_SLOTS)
    told = [[r for r, h in zip(side, held, strict=True) if not h] for side in sides]
    said = [list(truth[~held]), list(truth[~held])]
    models = [linear.fit(side, np.asarray(said[0]), n) for side, n in zip(told, slots, strict=True)]
    keyed = rows.select("id", F.xxhash64("text", *about).alias("body"), F.xxhash64("text").alias("words"), F.octet_length("text").alias("bytes"), *about, "text")
    labelled, before = facts.where(F.col(label).isNotNull()).select("id").distinct(), None
    for _ in range(rounds if all(m.any() for m in models) else 0):
        # Every document is scored; the few numbers of each, not its text, meet the labelled ids and its copies.
        unknown = log_odds(keyed, models, len(meta)).where(F.col("id").isNotNull()).join(labelled, "id", "left_anti")
        one = F.min(F.struct("id", "body", "bytes", "odds0", "odds1")).alias("one")
        picked = saved(handed(saved(unknown.groupBy("words").agg(one).select("words", "one.*")), before, float(truth[~held].mean()), pseudo_rows))
        near = F.broadcast(picked.drop("words"))  # 2 * PSEUDO_ROWS + 2 rows at most
        found = keyed.drop("words", "bytes").join(near, ["id", "body"]).dropDuplicates(["id", "body", "view"])
        pseudo, view, *more = _gathered(found.select(F.xxhash64("id").alias("id"), "body", "truth", "view", *about, "text"), len(meta))
        for own in (0, 1):
            told[own] += [r for r, v in zip(more[own], view, strict=True) if v == own]
            said[own] += list(pseudo[view == own])
        models = [linear.fit(side, np.asarray(own), n) for side, own, n in zip(told, said, slots, strict=True)]
        before = picked if before is None else before.union(picked)
    if not held.any() or not all(m.any() for m in models):
        return models, (np.zeros(2), np.zeros(2), np.zeros(3))
    scores = [np.asarray([linear.raw_score(m, *r) for r, h in zip(side, held, strict=True) if h]) for m, side in zip(models, sides, strict=True)]
    single = [linear.calibrate(s, truth[held]) for s in scores]
    both = linear.calibrate(np.column_stack([w[0] * s + w[1] for w, s in zip(single, scores, strict=True)]), truth[held])
    return models, (*single, both)


def score(docs: DataFrame, trained, meta: tuple[str, ...] = ("source", "lang"), doc_id: str = "doc_id", text: str = "text", keep: float = KEEP) -> DataFrame:
    """doc_id, content_prob, meta_prob, quality_prob (both views together) and kept for every row."""
    models, (by_content, by_meta, by_both) = trained
    content_model, meta_model = (m.astype(np.float32) for m in models)
    rows = docs.select(F.col(doc_id).alias("doc_id"), *[F.col(c).cast("string").alias(f"m{i}") for i, c in enumerate(meta)], F.col(text).alias("text"))
    kinds = rows.select("doc_id").schema.add("content_prob", "double").add("meta_prob", "double").add("quality_prob", "double").add("kept", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros((batch.num_rows, 3))
            for i, (content, about) in enumerate(_lists(batch, len(meta))):
                a = by_content[0] * linear.raw_score(content_model, *content) + by_content[1]
                b = by_meta[0] * linear.raw_score(meta_model, *about) + by_meta[1]
                found[i] = linear.sigmoid(a), linear.sigmoid(b), linear.calibrated(by_both, a, b)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in found.T.copy()), pa.array(found[:, 2] >= keep)], kinds.names)

    return rows.mapInArrow(run, kinds)
