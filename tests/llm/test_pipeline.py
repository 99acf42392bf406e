"""The corpus pipeline: every stage on its own input, and all of them."""

import importlib.util

import pytest
from pyspark.sql import functions as F

import __spark_entry__

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="there is no pipeline")


def test_stages(spark):
    import corpus_pipeline as pipeline

    docs = source = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.text for r in source.select("text").collect()}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == source.columns and out.count() > 0, name
        assert {r.text for r in out.select("text").collect()} <= texts
        if name == "near_dedup":
            assert out.select("text").distinct().count() == out.count() < docs.count()
        docs = out
    last = pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count() and last.select(F.max("shard")).first()[0] <= 7


def test_run_and_registration(spark):
    import corpus_pipeline as pipeline

    assert [name for name, _ in pipeline.STAGES] == ["language", "near_dedup", "decontaminate", "mix", "shard"]
    assert {"pipeline", *(f"op{n}" for n in range(1, 11))} <= {name.split("_")[0] for name in __spark_entry__.queries()}
    assert pipeline.run(spark, SF).count() > 0


def test_stages_take_columns_of_any_name(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"a.b": F.lit("x"), "c0": F.col("doc_id"), "size": F.lit(1), "text.": F.lit(None).cast("string")})
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = out.select("doc_id", "c0", "`a.b`", "text").collect()
        assert rows and all(r.doc_id == r.c0 and r["a.b"] == "x" for r in rows), name
    assert pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
