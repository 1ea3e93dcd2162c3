import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from engram.errors import EngineError
from engram.operators.search import Search, batch_above, batch_knn, mmr, report, search


@pytest.fixture(scope="module")
def records(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, x[i].astype("float32").tolist(), "fact" if i % 4 == 0 else "note", f"document {i} zebra" if i % 9 == 0 else f"document {i} apple", 1_000_000_000_000 - i * 60_000, [f"t{i % 5}"], i % 50, 4 if i == 7 else None) for i in range(400)]
    return x, spark.createDataFrame(rows, "id int, vector array<float>, kind string, text string, created_ms long, tags array<string>, grp int, caps long").cache()


def test_exact_against_brute_force(records):
    x, df = records
    got = [r["id"] for r in search(df, Search(x[5].tolist())).collect()]
    assert got == np.argsort(1 - x @ x[5], kind="stable")[:10].tolist()


def test_k_counts_matching_rows(records):
    x, df = records
    assert {r["grp"] for r in search(df, Search(x[0].tolist(), 8, where={"grp": 7})).collect()} == {7}
    assert search(df, Search(x[0].tolist(), 8, where={"grp": 7})).count() == 8
    assert report(df, Search(x[0].tolist(), where={"grp": 7})) == {"fetched": 400, "matched": 8, "complete": True, "strategy": "exact-filtered"}


def test_capability_gate(records):
    x, df = records
    seen = lambda held: 7 in [r["id"] for r in search(df, Search(x[7].tolist(), 3, gate="caps", capabilities=held)).collect()]
    assert [seen(None), seen(6), seen(2)] == [False, True, False]


def test_hybrid_finds_words(records):
    x, df = records
    assert 243 in [r["id"] for r in search(df, Search(x[0].tolist(), lexical="document 243", alpha=0.3)).collect()]
    one = search(df, Search(x[0].tolist(), 5, lexical="zebra", method="rsf"))
    assert one.count() == 5


def test_decay_coherence_mmr(records):
    x, df = records
    out = search(df, Search(x[0].tolist(), 5, decay={"half_life_days": 0.001, "now_ms": 1_000_000_000_000})).collect()
    assert all(r["decay"] <= 1 for r in out) and [r["rank"] for r in out] == [1, 2, 3, 4, 5]
    assert search(df, Search(x[0].tolist(), 5, coherence={"weight": 1, "threshold": 0.1})).count() == 5
    assert search(df, Search(x[0].tolist(), 5, diversity=0.5)).count() == 5


def test_mmr_against_plain_loop(records, spark):
    x, df = records
    items = search(df, Search(x[0].tolist(), 30))
    got = [r["id"] for r in mmr(items, 0.6, 6).orderBy("pick").collect()]
    rows = sorted(((r["final"], r["id"]) for r in items.collect()), key=lambda t: (-t[0], t[1]))
    high, low = rows[0][0], rows[-1][0]
    v = {r["id"]: np.array(r["vector"], dtype=float) for r in items.collect()}
    picked = [rows[0][1]]
    while len(picked) < 6:
        left = [(f, i) for f, i in rows if i not in picked]
        picked.append(max(left, key=lambda t: 0.4 * (t[0] - low) / (high - low) - 0.6 * max(0, max(v[t[1]] @ v[p] for p in picked)))[1])
    assert got == picked


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dotProduct", "manhattan"])
def test_batch_against_brute_force(records, metric):
    x, df = records
    asked = df.where("id % 40 = 0").selectExpr("id AS query_id", "vector")
    x = x.astype("float32").astype(float)
    d = {"cosine": lambda q: np.maximum(0, 1 - x @ q), "dotProduct": lambda q: -(x @ q), "euclidean": lambda q: np.sqrt(((x - q) ** 2).sum(1)), "manhattan": lambda q: np.abs(x - q).sum(1)}[metric]
    got = {}
    for r in batch_knn(df, asked, 4, metric).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
    assert len(got) == 10
    for q, found in got.items():
        assert [i for _, i in sorted(found)] == sorted(range(400), key=lambda i, q=q: (round(d(x[q])[i], 12), i))[:4]


def test_queries_in_blocks(records):
    x, df = records
    asked = df.where("id % 10 = 0").selectExpr("id AS query_id", "vector")
    whole, dealt = (sorted(map(tuple, batch_knn(df, asked, 3, block_bytes=b).select("query_id", "rank", "id").collect())) for b in (1 << 20, 500))
    assert whole == dealt and len(whole) == 120
    x = x.astype("float32").astype(float)
    above = {(q, int(i)) for q in range(0, 400, 10) for i in np.flatnonzero(x @ x[q] >= 0.7)}
    for b in (1 << 20, 500):
        assert {(r["query_id"], r["id"]) for r in batch_above(df, asked, 0.7, block_bytes=b).collect()} == above
    assert batch_knn(df, asked.limit(0), 3).count() == 0 and batch_above(df.limit(0), asked, 0.7).count() == 0


def test_arguments():
    for bad, code in ((dict(k=0), "INVALID"), (dict(metric="x"), "INVALID"), (dict(diversity=2.0), "INVALID"), (dict(lexical="x" * 40_000), "LIMIT")):
        with pytest.raises(EngineError, match=code):
            Search([1.0], **bad).check()
    with pytest.raises(EngineError, match="DIMENSION"):
        Search([1.0]).check(2)


@pytest.mark.parametrize("n, width", [(1000, 8), (20000, 64)])
def test_batch_knn_memory_of_a_task(spark, monkeypatch, n, width):
    """What a task holds beside the queries and their nearest rows doesn't grow with either table."""
    held = []
    monkeypatch.setattr("engram.operators.search._by_blocks", lambda r, q, kernel, *rest: held.append(kernel) or spark.createDataFrame([], "query_id long, id long, distance double"))
    df = spark.createDataFrame([], "id long, vector array<float>")
    batch_knn(df, df.withColumnRenamed("id", "query_id"), 5)
    rng = np.random.default_rng(n)
    q, x = rng.standard_normal((n, width)), rng.standard_normal((3000, width)).astype(np.float32)
    batch = pa.record_batch([pa.array(np.arange(3000)), pa.ListArray.from_arrays(pa.array(np.arange(3001, dtype=np.int32) * width), pa.array(x.ravel()))], ["id", "vector"])
    run = held[0](SimpleNamespace(value=(pa.array(np.arange(n)), q)))
    tracemalloc.start()
    try:
        near = sum(b.num_rows for b in run(iter([batch, batch.slice(0, 0)])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert near == 5 * n and peak < (100 << 20) + 5 * n * 100


def test_batch_knn_ties_and_names(spark):
    """Many equal distances, names of text, fewer rows than ``k`` in a batch: as sorting all pairs by distance and name."""
    rng = np.random.default_rng(3)
    vectors = [[float(v) for v in rng.integers(0, 2, 3)] for _ in range(90)]
    df = spark.createDataFrame([(f"n{i:02d}", v) for i, v in enumerate(vectors)], "id string, vector array<double>").repartition(3)
    asked = spark.createDataFrame([(f"q{i}", v) for i, v in enumerate(vectors[:12])], "query_id string, vector array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        found = batch_knn(df, asked, 4, "manhattan").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    told = {(r["query_id"], r["rank"]): r["id"] for r in found}
    for i, v in enumerate(vectors[:12]):
        order = sorted(range(90), key=lambda j, v=v: (sum(abs(a - b) for a, b in zip(v, vectors[j], strict=True)), j))
        assert [told[f"q{i}", n] for n in range(1, 5)] == [f"n{j:02d}" for j in order[:4]]
