"""Ranked lexical search turned round: the items' terms are indexed, the documents stream through the index.

The items of a benchmark are few and the documents many, so the inverted index is built over the items' terms and
broadcast, its size checked; more items than fit are searched slice by slice. One pass over the whole texts leaves
each document's length and its counts of indexed terms, which also give the corpus statistics. A second pass over
these counts scores documents against all items at once in whole numbers and keeps a bounded heap per item in each
task; heaps are merged in two steps, so that no task sees more than a share of them.

Defined cases: an item is all rows of one id; texts that it repeats count once, different texts add their terms. A
null or termless text, of an item or of a document, has no terms: such an item has no rows in the result, such a
document is not counted. Each row of documents is a document, so repeated rows rank one after the other. Equal
scores are ordered by id, null ids last. An empty table on either side gives an empty result. Other columns are not
read, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from sparkdlp.llm.common import BROADCAST_BYTES, saved

TOP = 10
#: Bytes that a posting (item, term, occurrences) takes at most in a worker, besides the term's own.
POSTING_BYTES = 160
#: Heaps of a first step of merging come together by this many keys per item.
MERGE_KEYS = 64
#: Cells of the score table that a task holds at once.
CELLS = 1 << 21

_KEEP = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and everything beyond ASCII; only A to Z are made small."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_KEEP).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_factor(n, n_docs: int, n_terms: int, whole=int):
    """A document's length against the mean, in hundredths of which a quarter is fixed."""
    return 25 + (75 * whole(n) * n_docs) // n_terms


def postings(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """One row per item and term: item_id, term, n (occurrences)."""
    rows = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).distinct()
    at = rows.columns.index("text")
    kinds = rows.select("item_id").schema.add("term", "binary").add("n", "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, body in enumerate(batch.column(at)):
                found = Counter(terms(body.as_py()))
                ids = batch.column(1 - at).take(pa.array([place] * len(found), pa.int64()))
                columns = [ids, pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, kinds.names)

    return rows.mapInArrow(count, kinds).groupBy("item_id", "term").agg(F.sum("n").alias("n"))


def counted(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (all terms), ids and counts of the terms in the vocabulary, for every document with a term."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    kinds = rows.select("doc_id").schema.add("n", "long").add("ids", ArrayType(IntegerType())).add("counts", ArrayType(IntegerType()))
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = known.value.get
        for batch in batches:
            totals, starts, ids, numbers = [], [0], [], []
            for body in batch.column(1):
                found = terms(body.as_py())
                totals.append(len(found))
                held = Counter(map(find, found))
                held.pop(None, None)
                ids.extend(held)
                numbers.extend(held.values())
                starts.append(len(ids))
            lists = (pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(x, pa.int32())) for x in (ids, numbers))
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64()), *lists], kinds.names)
            yield out.filter(pc.greater(out.column(1), 0))

    return rows.mapInArrow(count, kinds)


class Index:
    """Postings by term in flat arrays: item and occurrences of each, and the terms' weights."""

    def __init__(self, rows: list[tuple[int, int, int]], weights: np.ndarray, n_items: int) -> None:
        table = np.array(sorted((term, item, n) for item, term, n in rows), dtype=np.int64).reshape(-1, 3)
        self.starts = np.searchsorted(table[:, 0], np.arange(len(weights) + 1))
        self.items, self.times, self.weights, self.n_items = table[:, 1], table[:, 2], weights, n_items

    def scores(self, sizes: np.ndarray, ids: np.ndarray, counts: np.ndarray, factors: np.ndarray) -> np.ndarray:
        """Documents by items. sizes: indexed terms of each document, whose ids and counts follow one another."""
        doc = np.repeat(np.arange(len(sizes)), sizes)
        gains = self.weights[ids] * ((1_000_000_000 * counts) // (1000 * counts + 8 * factors[doc]))
        found = self.starts[ids + 1] - self.starts[ids]
        ends = np.cumsum(found)
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - found, found) + np.repeat(self.starts[ids], found)
        cell = np.repeat(doc, found) * self.n_items + self.items[at]
        gained = np.repeat(gains, found) * self.times[at]
        # Sums of doubles are exact below 2 ** 53: the halves of each gain are added apart.
        size = len(sizes) * self.n_items
        high, low = (np.bincount(cell, x, size).astype(np.int64) for x in (gained >> 26, gained & ((1 << 26) - 1)))
        return ((high << 26) + low).reshape(len(sizes), self.n_items)


class Heaps:
    """The best documents of each item so far: highest score, then lowest id."""

    def __init__(self, n_items: int, top: int, kind: pa.DataType) -> None:
        self.top, self.least = top, np.ones(n_items, dtype=np.int64)
        self.schema = pa.schema([("item", pa.int64()), ("score", pa.int64()), ("doc_id", kind)])
        self.rows = self.schema.empty_table()

    def offer(self, scores: np.ndarray, ids: pa.Array) -> None:
        """Scores of documents (rows) for items (columns)."""
        doc, item = np.nonzero(scores >= self.least)
        if not len(doc):
            return
        new = pa.table([pa.array(item, pa.int64()), pa.array(scores[doc, item]), ids.take(pa.array(doc, pa.int64()))], schema=self.schema)
        order = [("item", "ascending"), ("score", "descending"), ("doc_id", "ascending")]
        both = pa.concat_tables([self.rows, new])
        both = both.take(pc.sort_indices(both, sort_keys=order, null_placement="at_end"))
        items = both.column("item").to_numpy()
        rank = np.arange(len(items)) - np.searchsorted(items, items)
        self.rows = both.filter(pa.array(rank < self.top)).combine_chunks()
        full = both.filter(pa.array(rank == self.top - 1))
        self.least[full.column("item").to_numpy()] = full.column("score").to_numpy()


def _slice(docs: DataFrame, found: DataFrame, top: int) -> DataFrame:
    """The ranks for items whose postings fit into a broadcast."""
    spark = docs.sparkSession
    listed = found.toArrow()
    names = pc.unique(listed.column("item_id"))
    item_of = {name: i for i, name in enumerate(names.to_pylist())}
    vocabulary = {term: i for i, term in enumerate(sorted(set(listed.column("term").to_pylist())))}
    rows = [
        (item_of[item], vocabulary[term], n)
        for item, term, n in zip(listed.column("item_id").to_pylist(), listed.column("term").to_pylist(), listed.column("n").to_pylist(), strict=True)
    ]
    texts = saved(counted(docs, vocabulary))
    totals = texts.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = totals["docs"], totals["terms"] or 1
    per_term = texts.select(F.explode("ids").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weights = np.zeros(len(vocabulary), dtype=np.int64)
    for row in per_term.collect():  # at most the vocabulary
        weights[row["term"]] = weight(n_docs, row["df"])
    index = spark.sparkContext.broadcast(Index(rows, weights, max(1, len(names))))
    kinds = texts.select("doc_id").schema.add("item", "long").add("score", "long")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, heaps = index.value, None
        step = max(1, CELLS // held.n_items)
        for batch in batches:
            heaps = heaps or Heaps(held.n_items, top, batch.schema.field(0).type)
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids, counts = part.column(2), part.column(3)
                sizes = np.diff(ids.offsets.to_numpy())
                factors = length_factor(part.column(1).to_numpy(), n_docs, n_terms, np.int64)
                heaps.offer(held.scores(sizes, *(x.flatten().to_numpy().astype(np.int64) for x in (ids, counts)), factors), part.column(0))
        if heaps:
            for out in heaps.rows.to_batches():
                yield pa.RecordBatch.from_arrays([out.column(2), out.column(0), out.column(1)], kinds.names)

    best = texts.where(F.size("ids") > 0).mapInArrow(rank, kinds)
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    # Most heaps meet only others of the same key first; the merged ones meet in a second step.
    best = best.withColumn("key", F.spark_partition_id() % MERGE_KEYS)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("item", "key").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
    named = spark.createDataFrame(pa.table({"item": pa.array(range(len(names)), pa.int64()), "item_id": names}))
    return best.join(F.broadcast(named), "item").select(F.col("item_id").cast(found.schema["item_id"].dataType), "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text", budget: int = BROADCAST_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score of each item's best documents.

    ``budget`` bounds the index in bytes. An item's postings stay together, so one item alone must fit.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = saved(postings(items, item_id, item_text))
    cost = F.sum(F.octet_length("term") + POSTING_BYTES + F.octet_length(F.col("item_id").cast("string")))
    per_item = saved(found.groupBy("item_id").agg(cost.alias("bytes")))
    sizes = per_item.agg(F.sum("bytes").alias("all"), F.max("bytes").alias("most")).first()
    if (sizes["most"] or 0) > budget:
        raise ValueError("an item's terms alone are beyond the bound for a broadcast")
    slices = max(1, math.ceil((sizes["all"] or 0) / budget))
    out = None
    while out is None:
        key = F.pmod(F.xxhash64(F.col("item_id").cast("string")), F.lit(slices))
        if slices > 1 and per_item.groupBy(key).agg(F.sum("bytes").alias("b")).agg(F.max("b")).first()[0] > budget:
            slices *= 2
            continue
        for s in range(slices):
            ranked = _slice(docs, found.where(key == s), top)
            out = ranked if out is None else out.unionByName(ranked)
    return out


SQL = r"""
WITH terms AS (
  SELECT doc_id, row_number() OVER () AS doc,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS found
  FROM documents
), docs AS (
  SELECT doc, doc_id, len(found) AS n, found FROM terms WHERE len(found) > 0
), stats AS (
  SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM docs
), wanted AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM (SELECT DISTINCT item_id, text FROM benchmark))
  GROUP BY item_id, term
), hits AS (
  SELECT doc, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf
  FROM (SELECT doc, doc_id, n, unnest(found) AS term FROM docs)
  WHERE term IN (SELECT term FROM wanted) GROUP BY doc, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM hits CROSS JOIN stats GROUP BY term
), scored AS (
  SELECT item_id, doc, any_value(doc_id) AS doc_id,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM hits JOIN weights USING (term) JOIN wanted USING (term) CROSS JOIN stats
  GROUP BY item_id, doc
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, doc)::INTEGER AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 10
"""
