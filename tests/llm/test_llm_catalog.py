"""The operators' registered queries against their DuckDB text, and the pipeline against its parts."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
import oracle
from kontor.llm import catalog, quality, simhash

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, name):
    assert oracle.compare(catalog.QUERIES[name](spark, SF), catalog.ORACLES[name], oracle.connect(SF)) == []


def test_names():
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in quality.quality(docs).where("kept").collect()}
    stage = docs
    for name, run in corpus_pipeline.STAGES[:3]:
        stage = run(spark, stage, SF)
        assert stage.columns == docs.columns, name
        stage = spark.createDataFrame(stage.toPandas(), docs.schema)
        if name == "quality rules":
            assert {r.doc_id for r in stage.collect()} == kept
    groups = simhash.near_duplicates(stage)
    assert groups.select("component_id").distinct().count() == stage.count()
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} <= {r.doc_id for r in stage.collect()} and all(r.taken <= 2 * r.size for r in rows)
