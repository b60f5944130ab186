import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkdlp.llm import catalog, merkle
from tests.conftest import SF
from tests.llm.conftest import SCHEMA, awkward_rows, row


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(r, text):
    return sha(*map(field, (r[0], r[3], r[2], r[4], text)))


def climb(nodes, at):
    """All siblings of a place, level by level, and the node that is left."""
    path = []
    while len(nodes) > 1:
        start = at - at % 8
        path.append(("".join(nodes[start:at]), "".join(nodes[at + 1 : start + 8])))
        nodes, at = [sha(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)], at // 8
    return path, nodes[0]


def by_hand(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((leaf(r, r[1]), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for name in names:
        groups[name].sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
    trees = {name: [x for x, _ in groups[name]] for name in names}
    subroots = [climb(trees[name], 0)[1] for name in names]
    out = []
    for place, name in enumerate(names):
        top, root = climb(subroots, place)
        for at, (own, r) in enumerate(groups[name]):
            path = climb(trees[name], at)[0] + top
            text = r[1]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = leaf(r, text)
            for left, right in path:
                folded = sha(left, folded, right)
            out.append((r[0], own, subroots[place], root, sha(*(a + b for a, b in path)), folded, folded == root))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_awkward(spark, awkward, empty):
    assert got(merkle.manifest(awkward)) == by_hand(awkward_rows())
    assert merkle.manifest(empty).count() == 0


@pytest.mark.parametrize("sizes", [[1], [1, 1], [9], [513, 8, 1, 64, 65], [1] * 70 + [520]])
def test_trees_of_many_shapes(spark, sizes):
    rows = [row(i * 10_000 + j, f"Text {i} {j}", f"l{i}" if i else None) for i, n in enumerate(sizes) for j in range(n)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(merkle.manifest(docs)) == by_hand(rows)


def test_one_id_may_hold_most_rows(spark):
    rows = [row(7, f"Same {i % 3}") for i in range(600)] + [row(i, "other") for i in range(20)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(merkle.manifest(docs)) == by_hand(rows)


def test_places_are_gapless_and_in_order(spark):
    docs = spark.createDataFrame([(i * 7919 % 4001, f"g{i % 3}") for i in range(4001)], "id long, g string").repartition(7)
    rows = merkle.numbered(docs, "g", ["id"]).orderBy("g", "id").collect()
    want = {}
    for r in rows:
        assert r.pos == want.setdefault(r.g, 0)
        want[r.g] += 1
    assert all(r.n == want[r.g] for r in rows)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df, want = catalog.op12_merkle_manifest(spark, SF), con.sql(catalog.ORACLES["op12_merkle_manifest"])
    assert df.columns == want.columns
    assert got(df) == sorted(want.fetchall(), key=str)
    changed = df.join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").where(merkle.drawn(F.col("doc_id")))
    assert changed.where(F.col("verified") == F.col("text").rlike("[A-Z]")).count() == 0 < changed.count()


def test_only_every_third_level_is_stored(spark):
    leaves = spark.createDataFrame([("t", 1000, i, sha(str(i))) for i in range(1000)], "tree string, n long, pos long, digest string")
    levels = merkle.stored_levels(leaves)
    assert [level.count() for level in levels] == [2, 1]
    assert levels[-1].first().digest == climb([sha(str(i)) for i in range(1000)], 0)[1]
