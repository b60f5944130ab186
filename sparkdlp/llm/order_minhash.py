"""Near-duplicate classes by order MinHash.

A document's words make five-word shingles, each labelled with its occurrence number, so that a document holds
a labelled shingle once. A sketch takes the three smallest labelled shingles under one hash function and keeps
them in text order; two documents agree on a sketch about as often as their texts can be aligned. Each of forty
sketches is a candidate bucket.

Candidates are verified by banded alignment of their words: labelled shingles that are common and in the same order
anchor it, and the words between two anchors are aligned by their longest common subsequence (together L), as long as
no more words are left over than a similar pair allows. The similarity is L / (n1 + n2 - L) with n1 and n2 words; a
pair is linked from 0.8 on, and classes are the connected components of the links.

No bucket is collected or paired with itself. Texts with the same words are one node first. Then every bucket
member is compared with the bucket's leader only (the member that meets most others), which settles groups of
copies in linear work; members that end in another class than their leader get a new leader. Buckets that still
hold several classes are compared in blocks, where only pairs go on that have enough words in common: counts of words
in 512 bins bound that number from above, so no link of a bucket is lost. First every member's most promising partner
goes on, then all pairs that are still in different classes.

Defined cases: texts of one to four words have one shingle of all of them; texts without a word, null included,
are linked to nothing. Classes carry the lowest document id as class_id. Rows that repeat an id are treated by
their texts. Only the id and text columns are read, so other columns may have any names. A node is known by 64
bits of its words: two different texts meet in one node about once in six billion texts.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType

from sparkdlp.llm.common import few, fits, fresh, mix, same, saved, small, span_hashes, utf8, word_spans

SHINGLE = 5
SIMILARITY = 0.8
SKETCH = 3
BANDS = 40
#: Rounds of comparing bucket members with leaders before the rest is compared in blocks.
STAR_ROUNDS = 2
#: Members in a block, bins of words, and the highest count of a bin; at that count a bin bounds nothing.
BLOCK = 256
BINS = 512
FULL = 65535
#: Words of texts that a verifying task keeps for the next pairs.
HELD_WORDS = 1 << 20
#: Rows that a sketching task answers at a time.
STEP = 1000
#: Rows of small tables, of sketches and of texts that are worth a task; fewer are put together once they are counted.
ROWS, SKETCHES, TEXTS = 50_000, 4000, 1000


def words_hash(text: str | None) -> int | None:
    """64 bits of the words without regard to the white space between them; null if there is no word."""
    words = utf8(text).tobytes().split()
    return int.from_bytes(xxhash.xxh3_64_digest(b" ".join(words)), "little", signed=True) if words else None


def word_codes(text: str | None) -> np.ndarray:
    """A 64-bit code of every word of a text in order."""
    data = utf8(text)
    return span_hashes(data, *word_spans(data))


def labelled(words: np.ndarray) -> np.ndarray:
    """Labelled shingles of a sequence of words in order, as 64-bit codes."""
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    size = min(SHINGLE, len(words))
    with np.errstate(over="ignore"):
        codes = np.zeros(len(words) - size + 1, dtype=np.uint64)
        for i in range(size):
            codes = codes * np.uint64(0x9E3779B97F4A7C15) + words[i : i + len(codes)]
        codes = mix(codes)
        order = np.argsort(codes, kind="stable")
        ranked = codes[order]
        new = np.ones(len(codes), dtype=bool)
        new[1:] = ranked[1:] != ranked[:-1]
        if not new.all():
            place = np.arange(len(codes))
            first = np.maximum.accumulate(np.where(new, place, 0))
            label = np.empty(len(codes), dtype=np.uint64)
            label[order] = (place - first).astype(np.uint64)
            codes = np.where(label == 0, codes, mix(codes + label * np.uint64(0xD1B54A32D192ED03)))
    return codes


def shingles(text: str | None) -> np.ndarray:
    """Labelled shingles of a text in order."""
    return labelled(word_codes(text))


def sketches(codes: np.ndarray, count: int = BANDS) -> np.ndarray:
    """For each hash function, a code of the smallest labelled shingles in text order."""
    seeds = mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = np.empty(count, dtype=np.uint64)
    step = max(1, 200_000 // len(codes))
    with np.errstate(over="ignore"):
        for at in range(0, count, step):
            own = seeds[at : at + step, None]
            values = (codes[None, :] ^ own) * (own | np.uint64(1))
            values ^= values >> np.uint64(29)
            lines, places = np.arange(len(values)), []
            for _ in range(min(SKETCH, len(codes))):
                places.append(values.argmin(axis=1))
                values[lines, places[-1]] = np.uint64(0xFFFFFFFFFFFFFFFF)
            code = np.zeros(len(values), dtype=np.uint64)
            for place in np.sort(np.stack(places, axis=1), axis=1).T:
                code = code * np.uint64(0xBF58476D1CE4E5B9) + codes[place]
            out[at : at + step] = mix(code)
    return out


def common(a: list, b: list) -> int:
    """Length of the longest common subsequence, a row of bits for each step."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for x in b:
        if hit := row & places.get(x, 0):
            row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def rising(to: np.ndarray) -> np.ndarray:
    """Places of a longest rising run."""
    if np.all(to[1:] > to[:-1]):
        return np.arange(len(to))
    tails: list[int] = []
    ends: list[int] = []
    before = np.full(len(to), -1)
    for at, x in enumerate(to.tolist()):
        i = bisect_left(tails, x)
        tails[i : i + 1] = [x]
        ends[i : i + 1] = [at]
        before[at] = ends[i - 1] if i else -1
    out, at = [], ends[-1]
    while at >= 0:
        out.append(at)
        at = before[at]
    return np.asarray(out[::-1])


def aligned(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Similarity of two sequences of words by banded alignment; 0 where it is below `least`."""
    if not len(a) or not len(b):
        return 0.0
    if (len(b), b.tobytes()) < (len(a), a.tobytes()):
        a, b = b, a  # the same anchors, whichever text comes first
    total = len(a) + len(b)
    band = total - 2 * least * total / (1 + least) + 1e-9  # words that may be left over
    if len(b) - len(a) > band:
        return 0.0
    one, other = (np.unique(x, return_counts=True) for x in (a, b))
    _, i, j = np.intersect1d(one[0], other[0], assume_unique=True, return_indices=True)
    if total - 2 * int(np.minimum(one[1][i], other[1][j]).sum()) > band:
        return 0.0
    at = to = np.zeros(0, dtype=np.int64)
    if len(a) >= SHINGLE:
        _, at, to = np.intersect1d(labelled(a), labelled(b), assume_unique=True, return_indices=True)
        order = np.argsort(at)
        at, to = at[order], to[order]
        inside = np.abs(at - to) <= band
        at, to = at[inside], to[inside]
        if len(at):
            run = rising(to)
            at, to = at[run], to[run]
    # The first words of common shingles are partners; what lies between two of them is aligned word by word.
    begin_a, end_a = np.append(0, at + 1), np.append(at, len(a))
    begin_b, end_b = np.append(0, to + 1), np.append(to, len(b))
    wide_a, wide_b = end_a - begin_a, end_b - begin_b
    spare = band - float(np.abs(wide_a - wide_b).sum())
    if spare < 0:
        return 0.0
    for x in np.flatnonzero((wide_a > 0) & (wide_b > 0)):
        left, right = a[begin_a[x] : end_a[x]].tolist(), b[begin_b[x] : end_b[x]].tolist()
        spare -= 2 * (min(len(left), len(right)) - common(left, right))
        if spare < 0:
            return 0.0
    run = round((total - band + spare) / 2)
    return run / (total - run)


def bin_counts(words: np.ndarray) -> np.ndarray:
    """How many words fall into each of BINS bins, FULL at most."""
    return np.minimum(np.bincount((words % np.uint64(BINS)).astype(np.int64), minlength=BINS), FULL).astype(np.uint16)


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nothing = np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        for batch in (whole.slice(at, STEP) for whole in batches for at in range(0, whole.num_rows, STEP)):
            nodes, sizes, bands, marks = [], [], [], []
            for body in batch.column("text"):
                text = body.as_py()
                nodes.append(words_hash(text))
                words = word_codes(text)
                sizes.append(len(words))
                if not len(words):
                    bands.append(nothing)
                    marks.append(b"")
                    continue
                code = mix(sketches(labelled(words)) * np.uint64(0x9E3779B97F4A7C15) + np.arange(BANDS, dtype=np.uint64))
                bands.append(code.view(np.int64))
                marks.append(code.astype(np.uint32).tobytes() + bin_counts(words).tobytes())
            arrays = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(bands, pa.list_(pa.int64())), pa.array(marks, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("body"), *arrays], ["id", "body", "node", "n", "bands", "marks"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, as they travel once per pair."""
    for batch in batches:
        packed = [zlib.compress((t.as_py() or "").encode("utf-8", "surrogatepass"), 1) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(packed, pa.binary())], ["node", "packed"])


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}

        def codes(node: int, packed: pa.BinaryScalar) -> np.ndarray:
            if node not in seen:
                words = word_codes(zlib.decompress(packed.as_py()).decode("utf-8", "surrogatepass"))
                while seen and len(words) + sum(map(len, seen.values())) > HELD_WORDS or len(seen) >= 32:
                    seen.pop(next(iter(seen)))
                seen[node] = words
            return seen[node]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = [aligned(codes(x, s), codes(y, t), least) for x, y, s, t in zip(a, b, batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], ["a", "b", "similarity"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Those saved pairs (a, b: nodes) whose texts align. texts: id, body, text; nodes: node and the id, body of a text."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = saved(nodes.join(ends, "node").select("node", "id", "body"))
    count = wanted.count()
    wanted = F.broadcast(wanted) if fits(count, 48) else wanted
    own = texts.join(wanted, same(texts, wanted, [("id", "id"), ("body", "body")])).select("node", "text").dropDuplicates(["node"])
    # Saved, so that the texts are packed once and the tasks that verify run one Python worker each.
    own = saved(few(own, count, TEXTS).mapInArrow(_packed, "node long, packed binary"))
    both = pairs.join(own.select(F.col("node").alias("a"), F.col("packed").alias("packed_a")), "a")
    both = both.join(own.select(F.col("node").alias("b"), F.col("packed").alias("packed_b")), "b")
    checked = both.select("a", "b", "packed_a", "packed_b").mapInArrow(_verify(least), "a long, b long, similarity double")
    return saved(checked.where(F.col("similarity") > 0))


def components(edges: DataFrame) -> DataFrame:
    """node, label of every node with an edge: the smallest of its component. Min-label rounds with pointer jumps."""
    most = 2 * edges.count()
    both = saved(few(edges.select("a", "b").union(edges.select("b", "a")).distinct(), most, ROWS))
    linked = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node")
    linked = saved(few(linked, most, ROWS))
    while True:
        known = linked.select(F.col("node").alias("b"), F.col("label").alias("far"))
        near = both.join(known, "b").groupBy(F.col("a").alias("node")).agg(F.min("far").alias("far"))
        step = linked.join(near, "node").select("node", "label", F.least("label", "far").alias("next"))
        jump = linked.select(F.col("node").alias("next"), F.col("label").alias("beyond"))
        step = step.join(jump, "next", "left").select("node", "label", F.least("next", F.coalesce("beyond", "next")).alias("next"))
        step = saved(few(step, most, ROWS))
        changed = step.where(F.col("next") != F.col("label")).limit(1).count()
        linked = step.select("node", F.col("next").alias("label"))
        if not changed:
            return linked


def merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The labels of all nodes after more edges. Only edges between different labels count, each label being one node."""
    ends = edges.select("a", "b").join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a")
    ends = ends.join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b").where("la != lb")
    ends = ends.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()
    ends = saved(few(ends, edges.count(), ROWS))
    if not ends.limit(1).count():
        return labels
    found = components(ends).select(F.col("node").alias("label"), F.col("label").alias("low"))
    return saved(labels.join(found, "label", "left").select("node", F.coalesce("low", "label").alias("label")))


def _possible(best: bool):
    """Pairs of one block pair that are in different classes and may be similar; each in its first common bucket only.

    With ``best`` only the most promising partner of each row.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        marks = np.frombuffer(b"".join(rows["marks"]), dtype=np.uint8).reshape(len(rows), -1)
        bands, bins = np.ascontiguousarray(marks[:, : 4 * BANDS]).view(np.uint32), np.ascontiguousarray(marks[:, 4 * BANDS :]).view(np.uint16)
        node, label, n, part = (rows[c].to_numpy() for c in ("node", "label", "n", "part"))
        band, apart = rows["band"].iat[0], rows["i"].iat[0] != rows["j"].iat[0]
        a, b = [], []
        for x in range(len(rows)):
            rest = slice(x + 1, None)
            fit = label[rest] != label[x]
            fit &= np.minimum(n[rest], n[x]) >= SIMILARITY * np.maximum(n[rest], n[x])
            if apart:
                fit &= part[rest] != part[x]
            near = np.flatnonzero(fit) + x + 1
            near = near[(bands[near] == bands[x]).argmax(axis=1) == band]
            if len(near):
                # The counts of a bin bound how many of its words both texts can have in common.
                least = np.minimum(bins[near], bins[x])
                share = least.sum(axis=1, dtype=np.int64) / (n[near].astype(np.int64) + n[x])
                share[(least == FULL).any(axis=1)] = 1.0
                hope = share >= SIMILARITY / (1 + SIMILARITY) - 1e-9
                near, share = near[hope], share[hope]
                if best and len(near):
                    near = near[share.argmax()][None]
            a += [node[x]] * len(near)
            b += node[near].tolist()
        a, b = np.asarray(a, dtype=np.int64), np.asarray(b, dtype=np.int64)
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def links(texts: DataFrame, sketched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verified links and the label of every node. texts: id, body, text; sketched: rows of _sketch_rows with a node."""
    own = sketched.groupBy("node").agg(F.first(F.struct("id", "body", "n", "bands", "marks")).alias("one"))
    count = sketched.count()
    own = saved(few(own.select("node", "one.*"), count, SKETCHES))
    buckets = own.select("node", "n", F.posexplode("bands").alias("band", "bucket"))
    crowded = buckets.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    # Members of buckets that more than one node is in, and how often they meet another.
    members = saved(few(buckets.join(crowded, "bucket").select("bucket", "band", "node", "n", "members"), BANDS * count, ROWS))
    most = members.count()
    met = members.groupBy("node").agg(F.sum("members").alias("met"))
    rest = members.join(met, "node").select("bucket", "node", "met", "n")
    nodes, edges, tried = own.select("node", "id", "body"), None, None
    labels = own.select("node", F.col("node").alias("label"))

    def settle(pairs: DataFrame, most: int | None = None) -> DataFrame:
        """Verifies the pairs, `most` at most, that were not tried yet and gives the labels that follow."""
        nonlocal edges, tried
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = saved(few(pairs, most, ROWS) if most is not None else pairs)
        tried = pairs if tried is None else saved(tried.union(pairs))
        more = verified(pairs, texts, nodes)
        edges = more if edges is None else saved(edges.union(more))
        return merged(labels, more)

    for _ in range(STAR_ROUNDS):
        rest = saved(few(rest, most, ROWS))
        first = rest.groupBy("bucket").agg(F.max(F.struct("met", "node", "n")).alias("first"))
        first = first.select("bucket", F.col("first.node").alias("leader"), F.col("first.n").alias("n_leader"))
        led = saved(few(rest.join(first, "bucket"), most, ROWS))
        fit = F.least("n", "n_leader") >= SIMILARITY * F.greatest("n", "n_leader")
        pairs = led.where((F.col("node") != F.col("leader")) & fit).select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))
        labels = settle(pairs.distinct(), most)
        led = led.join(labels, "node").join(labels.select(F.col("node").alias("leader"), F.col("label").alias("led")), "leader")
        rest = led.where(F.col("label") != F.col("led")).select("bucket", "node", "met", "n")
    for best in (True, False):
        # Buckets whose members are still in several classes are compared in blocks.
        named = members.join(labels, "node")
        several = named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high")
        several = saved(few(several.select("bucket"), most, ROWS))
        if not several.limit(1).count():
            break
        mixed = named.join(several, "bucket").join(own.select("node", "marks"), "node")
        mixed = mixed.withColumn("parts", F.ceil(F.col("members") / BLOCK).cast("int")).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        mixed = mixed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        mixed = mixed.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other"))
        labels = settle(mixed.groupBy("bucket", "i", "j").applyInPandas(_possible(best), "a long, b long").distinct())
    return edges, labels


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row doc_id, body (hash of the text), class_id, class_size, n_links and label.

    n_links counts the links that were verified for its text; pairs within a settled class need none. The label tells classes apart even where ids repeat; it is null without words.
    """
    texts = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("body"), F.col(text).alias("text"))
    kinds = texts.select("id", "body").schema
    kinds = kinds.add("node", LongType()).add("n", IntegerType()).add("bands", ArrayType(LongType())).add("marks", BinaryType())
    sketched = saved(texts.mapInArrow(_sketch_rows, kinds))
    edges, labels = links(texts, sketched.where(F.col("node").isNotNull()))
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    placed = sketched.select(F.col("id").alias("doc_id"), "body", "node").join(labels.join(ends, "node", "left"), "node", "left")
    placed = saved(placed)
    totals = placed.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    out = placed.join(totals, "label", "left")
    return out.select(
        "doc_id", "body",
        F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        "label",
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, that of its lowest id; rows without words all stay. Columns as they came."""
    found = saved(classes(docs, doc_id, text))
    body = fresh("dedup_body", docs.columns)
    rows = found.groupBy("label", "doc_id", "body").agg(F.count("*").alias("copies"))
    heads = rows.where(F.col("label").isNotNull()).groupBy("label").agg(F.min(F.struct("doc_id", "body", "copies")).alias("head"))
    heads = heads.select("head.*").unionByName(rows.where(F.col("label").isNull()).select("doc_id", "body", F.lit(1).alias("copies")))
    heads = saved(heads.select(F.col("doc_id").alias("head_id"), F.col("body").alias("head_body"), "copies"))
    keyed, near = docs.withColumn(body, F.xxhash64(F.col(text))), small(heads.drop("copies"), 32)
    kept = keyed.join(near, same(keyed, near, [(doc_id, "head_id"), (body, "head_body")]), "left_semi")
    many = heads.where("copies > 1").select("head_id", "head_body")
    if many.limit(1).count():
        # Rows with the id and the text of a head: one of them stays.
        alike = same(kept, many, [(doc_id, "head_id"), (body, "head_body")])
        kept = kept.join(many, alike, "left_semi").dropDuplicates([doc_id, body]).unionByName(kept.join(many, alike, "left_anti"))
    return kept.select(*docs.columns)
