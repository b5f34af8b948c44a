"""The pipeline's stages against their operators."""

from conftest import SMALL

import corpus_pipeline
from wayfare.llm.common import cut


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, SMALL))
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before
        assert docs.filter("length(text) <> n_chars").count() == 0
        before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert packed.select("doc_id").distinct().count() == before


def test_run_is_the_last_stage(spark):
    assert {"doc_id", "sequence_id", "offset"} <= set(corpus_pipeline.run(spark, SMALL).columns)
