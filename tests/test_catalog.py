"""Every registered query against its SQL twin, and plan checks."""

import duckdb
import pytest

import __spark_entry__ as entry
from checks import catalog
from checks.compare import rows_of
from sparkdlp.operators import inject, score
from tests.conftest import SF

TABLES = "events documents embeddings pages conversations labels".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def test_every_query_has_a_twin():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    assert len(catalog.QUERIES) >= 58
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(catalog.ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    twin = con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(twin.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(twin.columns, twin.fetchall())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_are_narrow_and_pruned(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = plan_of(inject.scan_text(docs.where("lang = 'en'").select("doc_id", "text")))
    assert "Exchange" not in plan
    assert "EqualTo(lang,en)" in plan
    read = plan.split("ReadSchema: ")[1].split(">")[0]
    assert "source" not in read and "n_chars" not in read


def test_threshold_filter_does_not_repeat_the_score(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    plan = plan_of(score.heuristic_score(docs).where("score >= 0.7"))
    assert plan.count("jailbreak(?:s|ing|ed)") == 1
