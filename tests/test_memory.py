import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.errors import EngineError
from engram.functions import vector
from engram.operators import lifecycle, memory
from engram.operators.search import Search, search
from engram.sources.collection import Collection


def test_budget_skips_and_stops(spark):
    hits = spark.createDataFrame([(1, 50), (2, 80), (3, 40), (4, 5), (5, 5)], "rank int, tokens int")
    assert [r["rank"] for r in memory.pack_budget(hits, 100, 3).orderBy("rank").collect()] == [1, 3, 4]


def test_as_of_and_supersede(spark):
    rows = spark.createDataFrame([(1, "a", 10), (2, "a", 20), (3, "b", 5)], "id int, key string, at long")
    versions = memory.supersede(rows, "key", "at")
    assert {r["id"] for r in memory.as_of(versions, 15).collect()} == {1, 3}
    assert {r["id"] for r in memory.as_of(versions, 20).collect()} == {2, 3}


def test_novelty_and_recall(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], "red apple", "fact", ["x"], 1000, 10**15), (2, [0.0, 1.0], "blue sky", "note", ["x", "y"], 2000, 10**15), (3, [0.7, 0.7], "old news", "fact", ["y"], 3000, 5)], "id int, vector array<float>, text string, kind string, tags array<string>, created_ms long, valid_to long")
    new = spark.createDataFrame([(9, [1.0, 0.0], 0.5)], "id int, vector array<float>, given double")
    out = memory.novelty(rows, new, "given").first()
    assert out["novelty"] == 0 and out["importance"] == pytest.approx(0.3) and out["similar"] == 1
    assert {r["id"] for r in memory.recall(rows, [1.0, 0.0], 4000, k=5).collect()} == {1, 2}
    assert {r["id"] for r in memory.recall(rows, [1.0, 0.0], 4000, k=5, superseded=True, kinds=["FACT"]).collect()} == {1, 3}
    assert {r["id"] for r in memory.recall(rows, [1.0, 0.0], 4000, "sky", k=5, tags=["x", "y"]).collect()} == {2}
    assert {r["id"] for r in memory.recall(rows, [1.0, 0.0], 4000, k=5, min_similarity=0.5).collect()} == {1}


def test_learning_matches_plain_folds(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "s", "a" if i % 2 else "b", float(rng.uniform(-1, 1))) for i in range(90)]
    out = {r["action"]: (r["value"], r["n"]) for r in memory.routing(spark.createDataFrame(rows, "ord int, state string, action string, reward double")).collect()}
    for action in ("a", "b"):
        value, n = 0.0, 0
        for _, _, a, reward in rows:
            if a == action:
                n += 1
                value += (reward - value) / min(n, 20)
        assert out[action] == (pytest.approx(value), n)
    best = memory.recommend(spark.createDataFrame([("s", k, v) for k, (v, _) in out.items()], "state string, action string, value double")).first()["action"]
    assert best == max(out, key=lambda k: out[k][0])
    hits = spark.createDataFrame([(1, i, i % 3) for i in range(12)], "id int, ord int, confirmed int").withColumn("confirmed", (F.col("confirmed") > 0).cast("int"))
    c = 0.5
    for i in range(12):
        c += 0.2 * ((i % 3 > 0) - c)
    assert memory.folded_confidence(hits).first()["confidence"] == pytest.approx(c)
    shown = spark.createDataFrame([("x", 1.0, True), ("y", 1.0, False), ("z", -1.0, False)], "id string, reward double, chosen boolean")
    assert {r["id"]: r["feedback"] for r in memory.feedback(shown).collect()} == {"x": 1.0, "y": -0.25, "z": 0.0}


def test_sessions_slide(spark):
    rows = spark.createDataFrame([("u", 0), ("u", 100 * 60_000), ("u", 300 * 60_000), ("u", 700 * 60_000)], "key string, at long")
    out = memory.sliding_sessions(rows, "key", "at").orderBy("session").collect()
    assert [(r["n_turns"], r["expires_ms"] // 60_000) for r in out] == [(3, 540), (1, 940)]


def test_consolidation(spark):
    rows = [(i, [1.0, 0.01 * i], i, f"t{i}", i != 2) for i in range(4)] + [(9, [0.0, 1.0], 9, "far", True)]
    df = spark.createDataFrame(rows, "id int, vector array<double>, created_ms long, text string, success boolean").withColumn("vector", vector.normalize(F.col("vector")))
    out = memory.consolidate(df).collect()
    assert len(out) == 1 and out[0]["size"] == 4 and out[0]["success_rate"] == 0.75 and out[0]["eligible"]


def test_compaction(spark):
    rows = [(i, "a" if i < 90 else "b", ["x" if i < 90 else "y"], i == 0, None if i % 7 else i, i % 5) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, kind string, tags array<string>, pinned boolean, last_ms long, count long").withColumn("created_ms", F.col("id").cast("long"))
    gone = {r["id"]: r["score"] for r in lifecycle.evictions(df, 10, lifecycle.policy_score("lfu", 100), 3).collect()}
    left = [r for r in rows if r[0] not in gone]
    assert len(left) == 10 and 0 not in gone and sum(r[1] == "b" for r in left) >= 3
    sizes, walk, remaining = {"a": 89, "b": 10}, [], 100  # one is pinned
    for r in sorted((r for r in rows if not r[3]), key=lambda r: (r[5], r[0])):
        if remaining > 10 and sizes[r[1]] > 3:
            sizes[r[1]] -= 1
            remaining -= 1
            walk.append(r[0])
    assert set(walk) == set(gone)
    assert lifecycle.auto_target(20, 30) == 16 and lifecycle.auto_target(0, 30) is None


def test_witness(spark):
    rows = spark.createDataFrame([("l", i, "insert", f"r{i}", f"t{i}", "me", "p") for i in range(4)], "log string, ord int, operation string, record_id string, timestamp string, actor string, payload string")
    log = lifecycle.append(rows).cache()
    assert lifecycle.verify(log).first()["ok"]
    more = lifecycle.append(rows, lifecycle.head(log))
    assert lifecycle.verify(log.union(more)).first()["entries"] == 8 and lifecycle.verify(log.union(more)).first()["ok"]
    forged = log.withColumn("record_id", F.when(F.col("seq") == 2, "zzz").otherwise(F.col("record_id")))
    assert lifecycle.verify(forged).first()["first_break"] == 2
    assert lifecycle.verify(log.where("seq <> 3")).first()["first_break"] == 4


def test_branch(spark):
    parent = spark.createDataFrame([(1, "p"), (2, "p"), (3, "p")], "id int, v string")
    b = lifecycle.Branch(parent, spark.createDataFrame([(2, "b"), (4, "b")], "id int, v string"), spark.createDataFrame([(3,)], "id int"), 10)
    assert {tuple(r) for r in b.view().collect()} == {(1, "p"), (2, "b"), (4, "b")}
    generations = spark.createDataFrame([(2, 11), (3, 4)], "id int, generation int")
    with pytest.raises(EngineError):
        b.merge(generations)
    assert b.merge(generations, force=True).count() == 3


def test_collection(spark, tmp_path):
    c = Collection.create(spark, str(tmp_path / "c"), 2)
    schema = "id string, vector array<double>, metadata map<string,string>"
    c.insert(spark.createDataFrame([("a", [3.0, 4.0], {"kind": "fact", "n": "1"}), ("b", [0.0, 1.0], {"kind": "note"})], schema))
    with pytest.raises(EngineError, match="ALREADY_EXISTS"):
        c.insert(spark.createDataFrame([("a", [1.0, 0.0], None)], schema))
    with pytest.raises(EngineError, match="DIMENSION"):
        c.upsert(spark.createDataFrame([("x", [1.0], None)], schema))
    with pytest.raises(EngineError, match="ALREADY_EXISTS"):
        Collection.create(spark, str(tmp_path / "c"), 2)
    c.update_metadata("a", {"n": None, "m": "2"})
    assert c.get("a").first()["metadata"] == {"kind": "fact", "m": "2"}
    assert np.allclose(c.get("a").first()["vector"], [0.6, 0.8])
    c.delete(spark.createDataFrame([("b",)], "id string"))
    assert (c.count(), c.has("b"), c.generation) == (1, False, 3)
    assert c.checkpoint() == 3 and c.count() == 1
    c.upsert(spark.createDataFrame([("d", [1.0, 0.0], {"kind": "fact"})], schema))
    page, total = c.list({"kind": "fact"}, 1, 1, {"kind": "string"})
    assert total == 2 and [r["id"] for r in page.collect()] == ["d"]
    assert [r["id"] for r in search(c.with_fields(kind="string"), Search([1.0, 0.0], 1)).collect()] == ["d"]
    c.snapshot(str(tmp_path / "s"))
    assert Collection.restore(spark, str(tmp_path / "s"), str(tmp_path / "r")).count() == 2
    spark.createDataFrame([("zz", [0.0, 1.0], "{}")], "id string, vector array<float>, metadata string").write.mode("append").parquet(str(tmp_path / "s/rows"))
    with pytest.raises(EngineError, match="CORRUPT"):
        Collection.restore(spark, str(tmp_path / "s"), str(tmp_path / "r2"))
    with pytest.raises(EngineError, match="READ_ONLY"):
        Collection.open(spark, str(tmp_path / "c"), read_only=True).delete(spark.createDataFrame([("a",)], "id string"))
    with pytest.raises(EngineError, match="NOT_FOUND"):
        Collection.open(spark, str(tmp_path / "none"))


def test_checksum_tells_fields_apart(spark):
    value = lambda *rows: lifecycle.checksum(spark.createDataFrame(rows, "a string, b string")).first()["checksum"]
    assert len({value(("x|y", "z")), value(("x", "y|z")), value((None, "z")), value(("", "z")), value(("1:x", "z"))}) == 5
    assert value(("p", "q"), ("r", None)) == value(("r", None), ("p", "q"))


def test_lowest_of_many(spark):
    rows = spark.createDataFrame([(i, (i * 7) % 5) for i in range(500)], "id int, score int")
    by_hand = sorted((s, i) for i, s in ((i, (i * 7) % 5) for i in range(500)))
    for n in (0, 1, 100, 333, 499, 500, 600):
        assert sorted((r["score"], r["id"]) for r in lifecycle.lowest(rows, n, "score", "id").collect()) == by_hand[:n]
    assert lifecycle.lowest(rows.limit(0), 3, "score", "id").count() == 0


def test_witness_takes_nulls(spark):
    entries = spark.createDataFrame([("l", 1, "op", None, None, "t", None), ("l", 2, None, "r", "p", None, "a")], "log string, ord long, operation string, record_id string, payload string, timestamp string, actor string")
    assert lifecycle.verify(lifecycle.append(entries)).first()["ok"] is True


def test_witness_logs_are_streamed(spark):
    """Entries come a few at a time, a log's from several batches and several logs' in one, and chain as one by one."""
    entries = [(f"u{i % 7}" if i % 7 else None, i * 31 % 997, "op", f"r{i}", "t", None, f"p{i % 5}") for i in range(500)]
    schema = "log string, ord int, operation string, record_id string, timestamp string, actor string, payload string"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        log = lifecycle.append(spark.createDataFrame(entries, schema)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    heads, expected = {}, set()
    for name, _, operation, record, at, actor, payload in sorted(entries, key=lambda e: e[1]):
        seq, previous = heads.get(name, (0, lifecycle.GENESIS))
        heads[name] = seq + 1, lifecycle.entry_hash(previous, seq + 1, operation, record, hashlib.sha256(payload.encode()).hexdigest(), at, actor)
        expected.add((name, seq + 1, previous, heads[name][1], record))
    assert {(r["log"], r["seq"], r["prev_hash"], r["hash"], r["record_id"]) for r in log} == expected
    out = lifecycle.verify(spark.createDataFrame(log, lifecycle._ENTRY))
    assert {r["log"]: (r["entries"], r["ok"]) for r in out.collect()} == {n: (seq, True) for n, (seq, _) in heads.items()}


def test_witness_plan_has_each_entry_once(spark):
    """Entries are chained once, by no task a log, and verified without a join to themselves."""
    entries = spark.createDataFrame([("l", 1, "op", "r", "t", "a", "p")], "log string, ord int, operation string, record_id string, timestamp string, actor string, payload string")
    plan = lifecycle.verify(lifecycle.append(entries))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "FlatMapGroups" not in plan and plan.count("MapInArrow") == 1


def test_witness_with_a_repeated_number(spark):
    """An entry behind two of one number fits at most one of them; both count as entries once."""
    rows = spark.createDataFrame([("l", i, "insert", f"r{i}", f"t{i}", "me", "p") for i in range(5)], "log string, ord int, operation string, record_id string, timestamp string, actor string, payload string")
    log = lifecycle.append(rows).cache()
    head = log.where("seq = 2").select("log", "seq", "hash")
    other = lifecycle.append(rows.where("ord = 0"), head)
    assert tuple(lifecycle.verify(log.union(other)).select("entries", "first_break").first()) == (6, 4)
