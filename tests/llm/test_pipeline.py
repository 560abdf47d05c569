"""The pipeline's stages on the small tables."""

import duckdb
import pytest

from tests.conftest import SMALL

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_keep_columns_and_only_remove(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before, name
        before = docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert last.count() == before


def test_run_drops_leaks_and_bad_documents(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    kept = {r["doc_id"] for r in rows}
    assert len(kept) == len(rows)
    bad = {k for k, q in duckdb.sql(f"select doc_id, quality from '{SMALL}/labels.parquet'").fetchall() if not q}
    assert len(bad & kept) <= 0.2 * len(bad)
    items = [t for (t,) in duckdb.sql(f"select text from '{SMALL}/benchmark.parquet'").fetchall()]
    texts = dict(duckdb.sql(f"select doc_id, text from '{SMALL}/documents.parquet'").fetchall())
    assert not any(i in texts[k] for k in kept for i in items)
