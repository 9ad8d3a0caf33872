"""The corpus pipeline on the smallest tables, stage by stage."""

import os

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test data")
def test_stages(spark):
    import corpus_pipeline
    from medlattice.llm import ngram_join

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, n = docs.columns, docs.count()
    labels = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = spark.createDataFrame(stage(spark, docs, DATA).collect(), docs.schema)
        after = [r.doc_id for r in docs.select("doc_id").collect()]
        assert docs.columns == columns and set(after) <= before and after
        if name == "quality":
            good = [i for i, r in labels.items() if r.quality == 1]
            assert sum(i in set(after) for i in good) >= 0.95 * len(good)
        elif name == "near_duplicates":
            rest = ngram_join.components(docs).collect()
            assert len(set(after)) == len(after) and all(r.component_id == r.doc_id for r in rest)
        elif name == "mixed":
            assert max(after.count(i) for i in set(after)) <= 2
    out = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert len(out) == docs.count() and len({(r.shard, r.slot) for r in out}) == len(out) <= 2 * n
