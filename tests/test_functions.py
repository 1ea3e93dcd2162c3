import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.errors import EngineError
from engram.functions import filters, lexical, vector
from engram.functions.embedding import create_embedder, embed_text, embed_texts, fnv1a, ngram_embed, ngram_space


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_distances(spark):
    a, b = vector.vector([1, 0, 2]), vector.vector([0, 1, 2])
    assert value(spark, vector.dot(a, b)) == 4
    assert value(spark, vector.distance("euclidean", a, b)) == pytest.approx(math.sqrt(2))
    assert value(spark, vector.distance("manhattan", a, b)) == 2
    assert value(spark, vector.distance("dotProduct", a, b)) == -4
    assert value(spark, vector.cosine_distance(a, b)) == pytest.approx(1 - 4 / 5)
    assert value(spark, vector.cosine_distance(a, vector.vector([0, 0, 0]))) == 1
    assert value(spark, vector.normalize(vector.vector([0, 0]))) == [0, 0]
    assert value(spark, vector.similarity("euclidean", F.lit(1.0))) == 0.5
    with pytest.raises(EngineError):
        vector.distance("chebyshev", a, b)


def test_filters(spark):
    rows = spark.createDataFrame([("fact", 5.0, ["a", "b"], "hello", None)], "kind string, n double, tags array<string>, s string, gone string")
    held = lambda where: rows.where(filters.compile_filter(where, rows.schema)).count() == 1
    for where in ({"kind": "fact"}, {"tags": "a"}, {"n": {"$gt": 4, "$lte": 5}}, {"kind": {"$in": ["x", "fact"]}, "s": {"$prefix": "he"}}, {"tags": {"$all": ["a", "b"]}, "missing": {"$exists": False}}, {"n": {"$ne": 4}}, {"gone": {"$ne": "x"}}, {"tags": {"$all": []}}, {"nothing": {"$nin": [1]}}, {}):
        assert held(where), where
    for where in ({"tags": {"$contains": "z"}}, {"n": {"$ne": 5}}, {"n": {"$gt": "4"}}, {"kind": {"$in": []}}, {"tags": {"$eq": "a"}}, {"missing": {"$eq": 1}}, {"kind": 5}):
        assert not held(where), where
    with pytest.raises(EngineError, match="UNSUPPORTED"):
        filters.compile_filter({"kind": {"$like": "x"}}, rows.schema)


def test_capabilities(spark):
    for held, seen in ((None, False), (6, True), (2, False)):
        assert value(spark, filters.capability_gate(F.lit(4), held)) is seen
    assert value(spark, filters.capability_gate(F.lit(None).cast("long"), None)) is True


def test_tokens_and_bm25(spark):
    assert value(spark, lexical.tokenize(F.lit("The Soil/pH test_kit, (manual)."))) == ["soil/ph", "soil", "ph", "test_kit", "test", "kit", "manual"]
    rows = spark.createDataFrame([(1, "tomatoes grow well on raised beds"), (2, "the gardener stores dry seeds until spring"), (3, "soil/ph test_kit manual"), (4, None)], "id int, text string")
    for asked, found in (("raised beds", 1), ("test_kit", 3), ("ph", 3)):
        assert lexical.bm25(rows, asked, 1).first()["id"] == found
    assert lexical.bm25(rows, "the of").count() == 0
    assert lexical.bm25(rows, "gardener", 5, F.col("id") != 2).count() == 0


def test_ngram_embedding(spark):
    assert fnv1a("") == 0x811C9DC5 and fnv1a("a") == 0xE40C292C
    v = embed_text("Hello  World", 64)
    assert np.isclose((v * v).sum(), 1) and np.allclose(v, embed_text(" hello world ", 64))
    rows = spark.createDataFrame([(1, "hello world"), (2, None)], "id int, text string")
    out = {r["id"]: r["v"] for r in rows.select("id", ngram_embed(F.col("text"), 64).alias("v")).collect()}
    assert np.allclose(out[1], v) and len(out[2]) == 64
    ngram_space(64).check(ngram_space(64))
    with pytest.raises(EngineError, match="EMBEDDING_SPACE"):
        ngram_space(64).check(ngram_space(32))
    with pytest.raises(EngineError, match="EMBEDDER_UNAVAILABLE"):
        create_embedder("onnx:some-model")


def test_ngram_embedding_by_hand():
    texts = ["", "a", "Some  words, some_words \U0001f600!", "\ud83d x", "tab\there"]
    for text, got in zip(texts, embed_texts(texts, 32), strict=True):
        t = " ".join(text.lower().split())
        padded = f" {t} ".encode("utf-16-le", "surrogatepass")
        units = [padded[i : i + 6].decode("utf-16-le", "surrogatepass") for i in range(0, len(padded) - 5, 2)]
        v = np.zeros(32)
        for f in ["w:" + w for w in re.split(r"[\W_]+", t) if w] + ["g:" + u for u in units]:
            v[fnv1a(f) % 32] += -1 if fnv1a(f) >> 31 else 1
        assert np.allclose(got, v / (np.sqrt((v * v).sum()) or 1))
