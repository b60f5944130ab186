from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from sparkdlp.llm import bpe, catalog, common, decontaminate, lang_id, order_minhash
from tests.conftest import SF
from tests.llm.conftest import prose


def test_registered():
    names = entry.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and set(catalog.ORACLES) <= set(names)


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, columns = docs, docs.columns
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, SF).write.parquet(str(tmp_path / str(at)))
        after = spark.read.parquet(str(tmp_path / str(at)))
        if at < 4:
            assert after.columns == columns
        rows_before = {r.doc_id: r for r in before.collect()}
        rows_after = {r.doc_id: r for r in after.collect()}
        assert set(rows_after) <= set(rows_before)
        if name == "language_id":
            assert len(rows_after) > 0.95 * len(rows_before)
        if name == "line_dedup":
            assert set(rows_after) == set(rows_before)
            assert all(r.n_chars == len(r.text) or r.text == rows_before[d].text for d, r in rows_after.items())
        if name == "minhash_near_dedup":
            codes = {d: order_minhash.word_codes(r.text) for d, r in rows_after.items()}
            ids = sorted(codes)
            assert not [1 for i in ids for j in ids if i < j and len(codes[i]) and order_minhash.aligned(codes[i], codes[j]) > 0]
        if name == "decontamination":
            bad = {r.doc_id for r in decontaminate.overlaps(before, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            assert bad and set(rows_after) == set(rows_before) - bad
        if name == "bpe_encoding":
            with open(bpe.default_path(), "rb") as file:
                encoder = bpe.load(file.read())
            assert set(rows_after) == set(rows_before)
            assert all(r.ids == bpe.ids_of(encoder, rows_before[d].text).tolist() for d, r in rows_after.items())
        before = after


def test_run_equals_the_stages(spark, monkeypatch):
    passes, tables = [], lambda: set(Path(urlparse(spark.sparkContext.getCheckpointDir()).path).glob("table-*"))
    common.shared_folder(spark)
    real, before = lang_id.keep_known, tables()
    seen = spark.sparkContext.accumulator(0)

    def counted(docs, **options):
        passes.append(1)

        def see(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return real(docs, **options).mapInArrow(see, docs.schema)

    monkeypatch.setattr(lang_id, "keep_known", counted)
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids"] and corpus_pipeline.ORACLE_SQL is None
    monkeypatch.undo()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    # One pass over the documents, and no table left but the result.
    assert len(passes) == 1 and seen.value == real(docs).count()
    assert len(tables() - before) == 1
    for _, stage in corpus_pipeline.STAGES:
        docs = common.saved(stage(spark, docs, SF))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, docs.collect()))


def test_workers_are_given_small_batches(spark, monkeypatch):
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen, large = spark.conf.get(setting), spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def see(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            large.add(int(batch.nbytes > 5 << 20))
            yield batch

    monkeypatch.setattr(lang_id, "keep_known", lambda docs: docs.mapInArrow(see, docs.schema))
    try:
        spark.conf.unset(setting)
        docs = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat('some words ', 600) AS text")  # 20 MB in one partition
        for name, stage in corpus_pipeline.STAGES[:1]:
            assert name == "language_id"
            stage(spark, docs, SF).write.format("noop").mode("overwrite").save()
        assert seen.value == 3000 and large.value == 0
        # After a whole run the session has its own bound again.
        monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[:1])
        spark.conf.set(setting, "7m")
        assert corpus_pipeline.run(spark, SF).count() and spark.conf.get(setting) == "7m"
    finally:
        spark.conf.set(setting, before)


def test_awkward_documents_pass_through(spark, awkward):
    docs = awkward.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert {r.doc_id for r in docs.collect()} >= {1, 4, 11, 20, 21}


@pytest.mark.parametrize("n", [1, 4, 5, 6, 200])
def test_sketches_of_short_texts(n):
    codes = order_minhash.shingles(prose(n, 3))
    assert len(codes) == max(1, n - 4)
    assert order_minhash.sketches(codes).shape == (order_minhash.BANDS,) and len(np.unique(codes)) == len(codes)
