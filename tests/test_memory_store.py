import pytest
from pyspark.sql import functions as F

from engram.errors import EngineError
from engram.functions.embedding import embed_text, ngram_embed
from engram.sources.memory_store import MemoryStore

NOW = 1_700_000_000_000


@pytest.fixture
def store(spark, tmp_path):
    return MemoryStore.open(spark, str(tmp_path / "m"), 64, lambda c: ngram_embed(c, 64))


def ask(text):
    return embed_text(text, 64).tolist()


def test_remember_update_forget(spark, store):
    rows = spark.createDataFrame([("a", "the boiler was serviced in march", ["house", "house"], 0.9), ("b", "bread needs two hours to rise", None, None)], "id string, text string, tags array<string>, importance double")
    out = {r["id"]: r for r in store.remember(rows, NOW).collect()}
    assert out["a"]["novelty"] == 1 and out["a"]["importance"] == pytest.approx(0.94) and out["b"]["importance"] == pytest.approx(0.75)
    again = store.remember(spark.createDataFrame([("c", "the boiler was serviced in march", "NOTE", "a")], "id string, text string, kind string, supersedes string"), NOW + 10).first()
    assert again["novelty"] == pytest.approx(0, abs=1e-3) and again["similar"] == 1 and again["kind"] == "note"
    old = store.get("a").first()
    assert old["tags"] == ["house"] and old["valid_to"] == NOW + 10 and old["superseded_by"] == "c" and old["created_ms"] == NOW
    assert [r["id"] for r in store.list(NOW + 20)[0].collect()] == ["b", "c"] and store.list(NOW, superseded=True)[1] == 3
    assert store.list(NOW, {"kind": "note"})[1] == 1
    store.relate(spark.createDataFrame([("b", "kitchen", "ABOUT", 0.5)], "src string, dst string, type string, confidence double"))
    assert {tuple(r)[:3] for r in store.relations().collect()} == {("c", "a", "SUPERSEDES"), ("b", "kitchen", "ABOUT")}
    assert {tuple(r) for r in store.related(store.get("a")).collect()} == {("a", "c", "SUPERSEDES", "in")}
    changed = store.update("b", NOW + 30, text="rye bread rises slowly", pinned=True, tags=["food"], source=None).first()
    assert changed["text"] == "rye bread rises slowly" and changed["pinned"] and changed["tags"] == ["food"] and changed["updated_ms"] == NOW + 30
    assert changed["vector"] == pytest.approx(ask("rye bread rises slowly"), abs=1e-6)
    assert store.forget(spark.createDataFrame([("a",), ("zz",)], "id string")) == 1
    assert [tuple(r)[:3] for r in store.relations().collect()] == [("b", "kitchen", "ABOUT")]
    store.remember(spark.createDataFrame([("a", "back again")], "id string, text string"), NOW + 40)
    assert store.relations().count() == 1 and store.get("a").first()["valid_to"] > NOW + 40
    one = lambda **v: spark.createDataFrame([tuple(v.values())], list(v))
    for bad, code in ((one(text=" "), "INVALID"), (one(text="x", kind="9"), "INVALID"), (one(text="x", importance=2.0), "INVALID"), (one(text="x", valid_to=5), "INVALID"), (one(text="x", supersedes="none"), "NOT_FOUND")):
        with pytest.raises(EngineError, match=code):
            store.remember(bad, NOW)
    for call in (lambda: store.get("zz"), lambda: store.update("zz", NOW, text="x"), lambda: store.record_outcome("zz", 1.0, NOW)):
        with pytest.raises(EngineError, match="NOT_FOUND"):
            call()


def test_recalls_are_learned_from(spark, store):
    store.remember(spark.createDataFrame([(f"r{i}", f"note {i} on {w}", "note") for i, w in enumerate(("tea", "coffee", "juice", "water"))], "id string, text string, kind string"), NOW)
    first, hits = store.recall(ask("note on coffee"), NOW + 5, k=3)
    assert hits.count() == 3 and hits.where("rank = 1").first()["id"] == "r1"
    shown = [r["id"] for r in hits.orderBy("rank").collect()]
    assert store.record_outcome(first, 1.0, NOW + 6, chosen=shown[1:2]) == 3
    moved = {r["id"]: r["feedback"] for r in store.feedback().collect()}
    assert moved == {shown[0]: -0.25, shown[1]: 1.0, shown[2]: -0.25}
    assert store.recall(ask("note on coffee"), NOW + 7, k=3, learn=True)[1].count() == 3
    used = {r["id"]: (r["count"], r["last_ms"]) for r in store.access().collect()}
    assert used[shown[0]] == (2, NOW + 7)
    assert store.compact(2, NOW + 8, "lfu", per_cluster=1) == 2 and store.collection.count() == 2
    assert store.frame().where(F.col("id").isin(shown)).count() == 2


def test_sessions(spark, store):
    minute = 60_000
    s = store.start_session(NOW, "s", ttl_minutes=10)
    with pytest.raises(EngineError, match="ALREADY_EXISTS"):
        store.start_session(NOW + 1, "s")
    store.append_turn(s, "user", "hello there", NOW + 8 * minute, remember=True)
    store.append_turn(s, "assistant", "good day", NOW + 16 * minute)
    assert [tuple(r) for r in store.sessions(NOW + 20 * minute).collect()] == [("s", NOW, NOW + 26 * minute, 2)]
    assert [r["content"] for r in store.turns(s, NOW + 20 * minute).collect()] == ["hello there", "good day"]
    assert [r["content"] for r in store.turns(s, NOW + 20 * minute, last=1).collect()] == ["good day"]
    assert store.frame().where("kind = 'turn'").first()["text"] == "user: hello there"
    with pytest.raises(EngineError, match="NOT_FOUND"):
        store.append_turn(s, "user", "too late", NOW + 26 * minute)
    assert store.end_session(s, NOW + 20 * minute, "they greeted") == 1 and store.sessions(NOW + 20 * minute).count() == 0
    assert [r["kind"] for r in store.frame().collect()] == ["episode"]
    store.start_session(NOW + 30 * minute, "s", ttl_minutes=1)
    assert store.turns("s", NOW + 30 * minute).count() == 0
    store.append_turn("s", "user", "again", NOW + 30 * minute, remember=True)
    assert store.expire(NOW + 40 * minute) == 1 and store.expire(NOW + 40 * minute) == 0
