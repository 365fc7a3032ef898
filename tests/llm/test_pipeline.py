import importlib.util

import pytest

if not importlib.util.find_spec("corpus_pipeline"):
    pytest.skip("no pipeline here", allow_module_level=True)
import corpus_pipeline


def test_stages_on_small_documents(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, sf)
        assert out.columns == columns, name
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert pieces.selectExpr("sum(length)").first()[0] > 0 and n > 0


def test_run_is_packed_pieces(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    full = out.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 2048").count()
    assert full == 0 and out.count() > 0
