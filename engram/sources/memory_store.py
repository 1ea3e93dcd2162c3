"""A memory on disk: records in a collection, with relations, recalls, outcomes and sessions as append-only tables beside it.

Everything is written in batches of rows. A batch of records and what it supersedes is one generation of the collection, so
it is there whole or not at all. Derived state (access counts, feedback, live sessions) is an aggregate over its table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram.errors import EngineError, invalid
from engram.functions import vector
from engram.functions.filters import compile_filter
from engram.operators import lifecycle, memory
from engram.session import materialise
from engram.sources.collection import Collection

#: metadata keys with the types of their columns; tags are kept as JSON
FIELDS = {
    "text": "string", "kind": "string", "tags": "string", "source": "string", "session_id": "string", "created_ms": "bigint", "updated_ms": "bigint", "valid_from": "bigint", "valid_to": "bigint",
    "expires_ms": "bigint", "importance": "double", "novelty": "double", "confidence": "double", "pinned": "boolean", "req_caps": "bigint", "supersedes": "string", "superseded_by": "string",
}
_TABLES = {
    "relations": "src string, dst string, type string, confidence double, generation long",
    "recalls": "query_id string, id string, rank int, at_ms long",
    "outcomes": "query_id string, id string, reward double, chosen boolean, at_ms long",
    "sessions": "session_id string, op string, at_ms long, ord long, ttl_ms long, turn_id string, role string, content string",
}
_FORGOTTEN = "(forgotten)"


@dataclass
class MemoryStore:
    collection: Collection
    embed: Callable[[Column], Column]

    @classmethod
    def open(cls, spark: SparkSession, path: str, dimension: int, embed: Callable[[Column], Column], metric: str = "cosine") -> MemoryStore:
        return cls(Collection.open_or_create(spark, f"{path}/records", dimension=dimension, metric=metric), embed)

    # tables beside the collection

    def _place(self, name: str) -> str:
        return f"{self.collection.path}-{name}"

    def table(self, name: str) -> DataFrame:
        spark = self.collection.spark
        fs, at = Collection._fs(spark, self._place(name))
        return spark.read.schema(_TABLES[name]).parquet(self._place(name)) if fs.exists(at(self._place(name))) else spark.createDataFrame([], _TABLES[name])

    def _add(self, name: str, rows: DataFrame | list[tuple]) -> None:
        if self.collection.read_only:
            raise EngineError("READ_ONLY", self.collection.path)
        df = self.collection.spark.createDataFrame(rows, _TABLES[name]) if isinstance(rows, list) else rows
        df.select(*[f.split()[0] for f in _TABLES[name].split(", ")]).write.mode("append").parquet(self._place(name))

    # records

    def frame(self) -> DataFrame:
        """Live records with their metadata as typed columns."""
        return self.collection.with_fields(**FIELDS).withColumn("tags", F.from_json("tags", "array<string>"))

    def remember(self, rows: DataFrame, now_ms: int) -> DataFrame:
        """Store ``rows`` (text and any of ``FIELDS``, id, vector); returns id, kind, novelty, importance and similar.

        A row without an id gets one, one without a vector is embedded. Novelty is against the records valid before the batch.
        A superseded record must exist; it ends now and names its successor (the largest id, if there are several).
        """
        names = rows.columns
        have = lambda c, default: F.coalesce(F.col(c), default) if c in names else default
        none = lambda t: F.lit(None).cast(t)
        batch = rows.select(
            have("id", F.expr("uuid()")).cast("string").alias("id"), F.col("text"), F.lower(have("kind", F.lit("fact"))).alias("kind"),
            F.array_distinct(have("tags", F.expr("CAST(array() AS array<string>)"))).alias("tags"),
            have("importance", none("double")).alias("given"), have("valid_from", F.lit(now_ms)).cast("long").alias("valid_from"), have("valid_to", F.lit(memory.OPEN_END)).cast("long").alias("valid_to"),
            have("expires_ms", F.lit(memory.OPEN_END)).cast("long").alias("expires_ms"),
            *[have(c, none(FIELDS[c])).cast(FIELDS[c]).alias(c) for c in ("source", "session_id", "confidence", "pinned", "req_caps", "supersedes")],
            (F.coalesce("vector", self.embed(F.col("text"))) if "vector" in names else self.embed(F.col("text"))).cast("array<float>").alias("vector"),
        )
        unit = vector.normalize(F.col("vector")) if self.collection.manifest["metric"] == "cosine" else F.col("vector")
        batch = materialise(batch.withColumn("vector", unit), "remember")
        out_of_range = lambda c: (F.col(c) < 0) | (F.col(c) > 1)
        bad = batch.agg(
            F.sum((F.trim(F.coalesce("text", F.lit(""))) == "").cast("int")).alias("text"), F.sum((~F.col("kind").rlike("^[a-z][a-z0-9_-]{0,31}$")).cast("int")).alias("kind"),
            F.sum(F.coalesce(out_of_range("given"), F.lit(False)).cast("int")).alias("importance"), F.sum(F.coalesce(out_of_range("confidence"), F.lit(False)).cast("int")).alias("confidence"),
            F.sum((F.col("valid_to") <= F.col("valid_from")).cast("int")).alias("valid_to"), (F.count("*") - F.countDistinct("id")).alias("id"),
            F.sum((F.size("vector") != self.collection.manifest["dimension"]).cast("int")).alias("vector"),
        ).first().asDict()
        if wrong := sorted(k for k, n in bad.items() if n):
            raise invalid(f"rows with an invalid {', '.join(wrong)}")
        told = memory.novelty(self.frame().where(F.col("valid_to") > now_ms).select("id", "vector"), batch, "given", metric=self.collection.manifest["metric"])
        told = materialise(told.withColumn("novelty", memory.round4(F.col("novelty"))).withColumn("importance", memory.round4(F.col("importance"))), "remembered")

        old = told.where("supersedes IS NOT NULL").groupBy(F.col("supersedes").alias("old")).agg(F.max("id").alias("heir"))
        live = self.collection.frame().select("id", "vector", "metadata")
        if not old.join(live, F.col("old") == F.col("id"), "left_anti").isEmpty():
            raise EngineError("NOT_FOUND", "what a row supersedes does not exist")
        ended = live.join(old, F.col("old") == F.col("id"))
        ended = ended.select("id", "vector", _patched(F.col("metadata"), {"superseded_by": F.col("heir"), "valid_to": F.lit(now_ms), "updated_ms": F.lit(now_ms)}).alias("metadata"))
        stamped = told.withColumn("created_ms", F.lit(now_ms)).withColumn("updated_ms", F.lit(now_ms)).withColumn("tags", F.to_json("tags")).withColumn("superseded_by", F.lit(None).cast("string"))
        new = stamped.select("id", "vector", _patched(F.create_map().cast("map<string,string>"), {c: F.col(c) for c in FIELDS}).alias("metadata"))
        # a row that replaces a superseded record's id wins over that record's end
        written = new.unionByName(ended.join(new.select("id"), "id", "left_anti"))
        generation = self.collection._append(written.withColumn("op", F.lit("upsert")))
        self._add("relations", told.where("supersedes IS NOT NULL").select(F.col("id").alias("src"), F.col("supersedes").alias("dst"), F.lit("SUPERSEDES").alias("type"), F.lit(1.0).alias("confidence"), F.lit(generation).cast("long").alias("generation")))
        return told.select("id", "kind", "novelty", "importance", "similar")

    def get(self, key: str) -> DataFrame:
        row = self.frame().where(F.col("id") == key)
        if row.isEmpty():
            raise EngineError("NOT_FOUND", key)
        return row

    def list(self, now_ms: int, where: Mapping | None = None, limit: int = 50, offset: int = 0, superseded: bool = False) -> tuple[DataFrame, int]:
        """(page in order of writing, number of all matching rows)."""
        rows = self.frame()
        rows = rows.where(compile_filter(where, rows.schema))
        rows = rows if superseded else rows.where(F.col("valid_to") > now_ms)
        return rows.orderBy("generation", "ord").offset(offset).limit(min(limit, 1000)), rows.count()

    def update(self, key: str, now_ms: int, **patch) -> DataFrame:
        """Change ``FIELDS`` of a record; a new text is embedded again. NOT_FOUND without the record."""
        if unknown := sorted(set(patch) - set(FIELDS)):
            raise invalid(f"unknown fields {unknown}")
        row = self.collection.get(key).select("id", "vector", "metadata")
        if "text" in patch:
            row = row.withColumn("vector", self.embed(F.lit(patch["text"])).cast("array<float>"))
            row = row.withColumn("vector", vector.normalize(F.col("vector"))) if self.collection.manifest["metric"] == "cosine" else row
        values = {k: F.to_json(F.array_distinct(F.array(*map(F.lit, v)))) if k == "tags" else F.lit(v) for k, v in patch.items()} | {"updated_ms": F.lit(now_ms)}
        self.collection._append(row.withColumn("metadata", _patched(F.col("metadata"), values)).withColumn("op", F.lit("upsert")))
        return self.get(key)

    def forget(self, ids: DataFrame) -> int:
        """Delete records (column id) with their relations; the number of those that there were."""
        gone = materialise(self.collection.frame().join(ids.select(F.col("id").cast("string").alias("id")).distinct(), "id", "left_semi").select("id"), "forget")
        n = gone.count()
        if n:
            generation = self.collection.delete(gone)
            self._add("relations", gone.select(F.col("id").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(_FORGOTTEN).alias("type"), F.lit(0.0).alias("confidence"), F.lit(generation).cast("long").alias("generation")))
        return n

    # relations

    def relate(self, rows: DataFrame) -> None:
        """Add relations (src, dst, type, confidence); the source must be a record, the target may be any name."""
        rows = rows.withColumn("generation", F.lit(self.collection.generation).cast("long"))
        if not rows.where("src IS NULL OR dst IS NULL OR type IS NULL OR type = '' OR confidence < 0 OR confidence > 1").isEmpty():
            raise invalid("a relation needs src, dst, type and a confidence between 0 and 1")
        if not rows.join(self.collection.frame().select(F.col("id").alias("src")), "src", "left_anti").isEmpty():
            raise EngineError("NOT_FOUND", "the source of a relation is no record")
        self._add("relations", rows)

    def relations(self) -> DataFrame:
        """src, dst, type and confidence of all relations neither of whose ends was forgotten since."""
        all_of = self.table("relations")
        gone = all_of.where(F.col("type") == _FORGOTTEN).groupBy(F.col("src").alias("_id")).agg(F.max("generation").alias("_g"))
        out = all_of.where(F.col("type") != _FORGOTTEN)
        for end in ("src", "dst"):
            out = out.join(gone, (F.col(end) == F.col("_id")) & (F.col("_g") > F.col("generation")), "left_anti")
        return out.select("src", "dst", "type", "confidence")

    def related(self, hits: DataFrame, limit: int = 50) -> DataFrame:
        """Up to ``limit`` relations of each hit: id, other, type, direction."""
        r, h = self.relations(), hits.select("id")
        out = h.join(r, F.col("id") == F.col("src")).select("id", F.col("dst").alias("other"), "type", F.lit("out").alias("direction"))
        into = h.join(r, F.col("id") == F.col("dst")).select("id", F.col("src").alias("other"), "type", F.lit("in").alias("direction"))
        place = F.row_number().over(W.partitionBy("id").orderBy("type", "other", "direction"))
        return out.union(into).withColumn("_p", place).where(F.col("_p") <= limit).drop("_p")

    # recalls and what came of them

    def recall(self, query: Sequence[float], now_ms: int, text: str | None = None, k: int = 10, learn: bool = False, **options) -> tuple[str, DataFrame]:
        """(query id, hits); the recall is logged, and with ``learn`` feedback moves the scores."""
        hits = materialise(memory.recall(self.frame(), query, now_ms, text, k, feedback=self.feedback() if learn else None, **options), "recall")
        query_id = uuid.uuid4().hex
        self._add("recalls", hits.select(F.lit(query_id).alias("query_id"), "id", F.col("rank").cast("int").alias("rank"), F.lit(now_ms).cast("long").alias("at_ms")))
        return query_id, hits

    def record_outcome(self, query_id: str, reward: float, now_ms: int, chosen: Sequence[str] = ()) -> int:
        """Reward the chosen results of a recall (all, if none is named); the number of results it had."""
        if not -1 <= reward <= 1:
            raise invalid("reward must be between -1 and 1")
        shown = self.table("recalls").where(F.col("query_id") == query_id)
        if (n := shown.count()) == 0:
            raise EngineError("NOT_FOUND", query_id)
        picked = F.col("id").isin([*chosen]) if chosen else F.lit(True)
        self._add("outcomes", shown.select("query_id", "id", F.lit(float(reward)).alias("reward"), picked.alias("chosen"), F.lit(now_ms).cast("long").alias("at_ms")))
        return n

    def feedback(self) -> DataFrame:
        return memory.feedback(self.table("outcomes"))

    def access(self) -> DataFrame:
        """(id, count, last_ms, feedback) of the records that were recalled."""
        used = self.table("recalls").groupBy("id").agg(F.count("*").alias("count"), F.max("at_ms").alias("last_ms"))
        return used.join(self.feedback(), "id", "left")

    def compact(self, target: int, now_ms: int, policy: str = "coherence", per_cluster: int = 2) -> int:
        """Forget the records that the policy scores lowest until ``target`` remain; the number of those forgotten."""
        rows = self.frame().join(self.access(), "id", "left")
        return self.forget(lifecycle.evictions(rows, target, lifecycle.policy_score(policy, now_ms, self.collection.manifest["metric"]), per_cluster))

    # sessions

    def sessions(self, now_ms: int) -> DataFrame:
        """Live sessions: session_id, started_ms, expires_ms, n_turns. Each turn keeps a session open for its time to live."""
        events = self._current()
        out = events.groupBy("session_id").agg(
            F.min("at_ms").alias("started_ms"), F.max("ttl_ms").alias("ttl_ms"), F.max(F.when(F.col("op") != "end", F.col("at_ms"))).alias("last_ms"),
            F.sum((F.col("op") == "turn").cast("long")).alias("n_turns"), F.max((F.col("op") == "end").cast("int")).alias("ended"),
        )
        out = out.withColumn("expires_ms", F.col("last_ms") + F.col("ttl_ms"))
        return out.where((F.col("ended") == 0) & (F.col("expires_ms") > now_ms)).select("session_id", "started_ms", "expires_ms", "n_turns")

    def _current(self) -> DataFrame:
        """Events of each session since it was last started; an id may be used again after its session is over."""
        events = self.table("sessions")
        begun = events.where("op = 'start'").groupBy("session_id").agg(F.max("ord").alias("_begun"))
        return events.join(begun, "session_id").where(F.col("ord") >= F.col("_begun")).drop("_begun")

    def _event(self, session: str, op: str, now_ms: int, ttl_ms: int | None = None, turn_id: str | None = None, role: str | None = None, content: str | None = None) -> None:
        last = self.table("sessions").agg(F.max("ord")).first()[0]
        self._add("sessions", [(session, op, now_ms, 0 if last is None else last + 1, ttl_ms, turn_id, role, content)])

    def start_session(self, now_ms: int, session: str | None = None, ttl_minutes: float = 240) -> str:
        if not ttl_minutes > 0:
            raise invalid("ttl_minutes must be positive")
        session = session or uuid.uuid4().hex
        if not self.sessions(now_ms).where(F.col("session_id") == session).isEmpty():
            raise EngineError("ALREADY_EXISTS", f"session {session}")
        self._event(session, "start", now_ms, max(1, round(ttl_minutes * 60_000)))
        return session

    def append_turn(self, session: str, role: str, content: str, now_ms: int, remember: bool = False) -> str:
        """Add a turn; ``remember`` stores it as a record that expires with the session as it stands now."""
        self._live(session, now_ms)
        turn = uuid.uuid4().hex
        self._event(session, "turn", now_ms, None, turn, role, content)
        if remember:
            expires = self._live(session, now_ms)["expires_ms"]
            row = (f"turn:{turn}", f"{role}: {content}", "turn", session, expires)
            self.remember(self.collection.spark.createDataFrame([row], "id string, text string, kind string, session_id string, expires_ms long"), now_ms)
        return turn

    def _live(self, session: str, now_ms: int):
        row = self.sessions(now_ms).where(F.col("session_id") == session).first()
        if row is None:
            raise EngineError("NOT_FOUND", f"session {session}")
        return row

    def turns(self, session: str, now_ms: int, last: int | None = None) -> DataFrame:
        """Turns of a live session in order, or only the last few."""
        self._live(session, now_ms)
        rows = self._current().where((F.col("session_id") == session) & (F.col("op") == "turn"))
        rows = rows if last is None else rows.orderBy(F.col("ord").desc()).limit(last)
        return rows.select("turn_id", "role", "content", "at_ms", "ord").orderBy("ord")

    def end_session(self, session: str, now_ms: int, summary: str | None = None) -> int:
        """End a session: its turn records go, a summary stays as an episode; the number of records dropped."""
        self._live(session, now_ms)
        self._event(session, "end", now_ms)
        dropped = self.forget(self.frame().where((F.col("kind") == "turn") & (F.col("session_id") == session)))
        if summary:
            text = f"Task: Session {session}\nCritique: {summary}"
            self.remember(self.collection.spark.createDataFrame([(text, "episode", session)], "text string, kind string, session_id string"), now_ms)
        return dropped

    def expire(self, now_ms: int) -> int:
        """Forget expired records and the turn records of sessions that are over; the number of those forgotten."""
        rows = self.frame()
        over = rows.where("kind = 'turn'").join(self.sessions(now_ms).select("session_id"), "session_id", "left_anti").select("id")
        return self.forget(rows.where(F.col("expires_ms") <= now_ms).select("id").union(over))


def _patched(metadata: Column, values: Mapping[str, Column]) -> Column:
    """The map with these keys replaced; a null value removes its key."""
    kept = F.map_filter(F.coalesce(metadata, F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin([*values]))
    new = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])
    return F.map_concat(kept, F.map_filter(new, lambda _, v: v.isNotNull()))
