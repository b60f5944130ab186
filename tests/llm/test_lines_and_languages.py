import duckdb
import pytest

from sparkdlp.llm import catalog, lang_id, line_dedup
from tests.conftest import SF


def test_line_dedup_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = catalog.op1_line_dedup(spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(catalog.ORACLES["op1_line_dedup"]).fetchall())


def test_boilerplate_goes_from_all_but_the_first(spark):
    rows = [(i, f"own {i}\nshared\n\n shared \nrare", f"s{i % 4}") for i in range(8)] + [(90, "rare", None), (91, "few", "s0"), (92, "few", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in line_dedup.remove(docs, min_sites=4).collect()}
    assert got[0] == rows[0][1]
    assert got[3] == "own 3\n"
    assert got[90] == "" and got[91] == "few"
    assert {r.doc_id: r.text for r in line_dedup.remove(docs, min_sites=5).collect()} == {r[0]: r[1] for r in rows}


def test_sketch_and_exact_agree_at_every_threshold(spark):
    rows = [(i * 100 + j, f"line {i}", f"s{j}") for i in range(1, 40) for j in range(i)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for least in (2, 10, 25):
        assert line_dedup.boilerplate(docs, min_sites=least, k=5).count() == 40 - least


def test_line_dedup_awkward(awkward, empty):
    got = line_dedup.cleaned(awkward)
    assert got.columns == awkward.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, awkward.collect()))
    assert line_dedup.cleaned(empty).count() == 0
    with_counts = line_dedup.remove(awkward).where("doc_id = 13").first()
    assert (with_counts.n_lines, with_counts.n_removed) == (5, 0)


def test_profiles_by_hand():
    table = lang_id.letter_table()
    codes = lang_id.grams("aab", table)
    point = lambda s: [ord(c) for c in s]
    a, b, edge = *point("ab"), 1
    two = lambda x, y: (x << 21) | y
    three = lambda x, y, z: (x << 42) | (y << 21) | z
    assert sorted(codes.tolist()) == sorted(
        [a, a, b, two(edge, a), two(a, a), two(a, b), two(b, edge), three(edge, a, a), three(a, a, b), three(a, b, edge)]
    )
    assert lang_id.grams("12 !?", table).size == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = lang_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id")
    held = found.where("held_out")
    assert held.where("lang = lang_pred").count() >= 0.97 * held.count() > 0
    assert found.where("score < 0 or score > 1").count() == 0


def test_distance_is_out_of_place(spark):
    import numpy as np

    known = np.array([10, 20, 30])
    places = np.array([[0, 1, 2], [2, 1, 0]])
    far = lang_id.distances(np.array([10, 20, 99]), known, places, 3)
    assert far.tolist() == pytest.approx([(0 + 0 + 3) / 9, (2 + 0 + 3) / 9])


def test_languages_awkward(awkward, empty):
    got = lang_id.identify(awkward).collect()
    assert len(got) == awkward.count()
    said = {}
    for r in got:
        said.setdefault(r.doc_id, set()).add(r.lang_pred)
    assert said[5] == said[6] == said[7] == said[10] == {"und"}
    assert said[1] == {"en"}
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    assert lang_id.identify(empty).count() == 0
    kept = lang_id.keep_known(awkward, least=0.0)
    assert kept.columns == awkward.columns
    assert {5, 6, 7, 10}.isdisjoint({r.doc_id for r in kept.collect()})
    from pyspark.sql import functions as F

    assert {r.lang_pred for r in lang_id.identify(awkward.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
