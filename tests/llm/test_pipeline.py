"""Every stage judged on its own input, and the whole run."""

import corpus_pipeline
from engram.llm import queries
from engram.session import materialise, table

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = materialise(stage(spark, docs, DATA), "test")
        if k < 4:
            assert docs.columns == names, name
            assert docs.join(before.select("doc_id"), "doc_id", "left_anti").count() == 0
        if k == 0:
            assert docs.count() >= 0.7 * before.count()
        if k == 1:
            assert docs.count() == before.count()
    # the mix takes as many words as its input has, and no document more than three times
    assert 0 <= before.count() and docs.count() > 0
    total = docs.groupBy().sum("taken").first()[0]
    size = sum(len((r["text"] or "").split()) for r in before.collect())
    assert abs(total - size) <= 25


def test_empty(spark):
    docs = table(spark, DATA, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, DATA), "empty")
        assert docs.count() == 0


def test_registered():
    names = list(queries.queries())
    assert [n for n in names if n.startswith("op")] == sorted((n for n in names if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0])) and len(names) == 11
    assert set(queries.oracle_sql()) <= set(names)
