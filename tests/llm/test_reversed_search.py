import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from sparkdlp.llm import catalog, reversed_search
from tests.conftest import SF
from tests.llm.conftest import awkward_rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def by_hand(docs, items, top=10):
    """All scores of all pairs, one by one."""
    held = [(doc_id, Counter(terms(text))) for doc_id, text in docs]
    held = [(doc_id, found) for doc_id, found in held if found]
    n_docs, n_terms = len(held), sum(sum(f.values()) for _, f in held)
    df = Counter(t for _, f in held for t in f)
    wanted = {}
    for item_id, text in dict.fromkeys(items):
        wanted.setdefault(item_id, Counter()).update(terms(text))
    out = []
    for item_id, want in wanted.items():
        ranked = []
        for doc_id, found in held:
            m = 100 - 75 + (75 * sum(found.values()) * n_docs) // n_terms
            score = sum(
                times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * found[t]) // (1000 * found[t] + 8 * m))
                for t, times in want.items() if t in found
            )
            if score > 0:
                ranked.append((-score, doc_id is None, doc_id or 0, score))
        out += [(item_id, at + 1, None if none else doc_id, score) for at, (_, none, doc_id, score) in enumerate(sorted(ranked)[:top])]
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


ITEMS = [
    (1, "the old grey house"), (2, None), (3, ""), (4, "!!"), (5, "cat cat cat mat"), (5, "cat cat cat mat"), (5, "rain"),
    (None, "green hills3"), (6, "ünïcödé STRASSE straße"), (7, "x" * 200_000), (8, "one One ONE"),
]


@pytest.mark.parametrize("budget", [1 << 24, 1 << 19])
def test_awkward(spark, awkward, empty, budget):
    items = spark.createDataFrame([(i, t, "clash", 1) for i, t in ITEMS], "item_id long, text string, doc_id string, score long")
    want = by_hand([r[:2] for r in awkward_rows()], ITEMS)
    assert got(reversed_search.search(awkward, items, budget=budget)) == want
    assert reversed_search.search(empty, items).count() == 0
    assert reversed_search.search(awkward, items.limit(0)).count() == 0
    ids = lambda df: df.withColumn("doc_id", df.doc_id.cast("string"))
    named = got(reversed_search.search(ids(awkward), items.withColumn("item_id", items.item_id.cast("string"))))
    assert sorted(str((a, b, d)) for a, b, _, d in named) == sorted(str((None if a is None else str(a), b, d)) for a, b, _, d in want)


def test_slices_give_the_same(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    assert got(reversed_search.search(docs, items, budget=40_000)) == got(reversed_search.search(docs, items))
    with pytest.raises(ValueError):
        reversed_search.search(docs, items, budget=1000)


def test_ties_go_to_low_ids(spark):
    rows = [(i, "apple pie") for i in range(500)] + [(900 + i, "other words") for i in range(500)] + [(None, "apple pie")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    items = spark.createDataFrame([(1, "apple")], "item_id long, text string")
    assert [r.doc_id for r in reversed_search.search(docs, items).orderBy("rank").collect()] == list(range(10))
    assert [r.doc_id for r in reversed_search.search(docs.where("doc_id < 3 or doc_id is null or doc_id >= 900"), items).orderBy("rank").collect()] == [0, 1, 2, None]


def test_sums_are_exact():
    index = reversed_search.Index([(0, 0, 10**6), (0, 1, 7)], np.array([25_000, 3], dtype=np.int64), 1)
    got = index.scores(np.array([2]), np.array([0, 1]), np.array([5, 1]), np.array([100]))
    assert got.tolist() == [[10**6 * 25_000 * (5 * 10**9 // 5800) + 7 * 3 * (10**9 // 1800)]]


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    df, want = catalog.op13_reversed_search(spark, SF), con.sql(catalog.ORACLES["op13_reversed_search"])
    assert df.columns == want.columns
    assert got(df) == sorted(want.fetchall(), key=str)
    docs, items = (con.sql(f"SELECT {k}, text FROM {t}").fetchall() for k, t in (("doc_id", "documents"), ("item_id", "benchmark")))
    assert got(df) == by_hand(docs, items)
