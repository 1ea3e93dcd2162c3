"""Compaction, branches, purge, re-embedding, checksums and the hash-chained witness log."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram.errors import EngineError, invalid
from engram.functions import vector
from engram.session import materialise, shuffle_partitions, visible_to_workers

GENESIS = "0" * 64
MOST_RECENT = 32


# compaction


def policy_score(policy: str, now_ms: int, metric: str = "cosine", recent: Sequence[Sequence[float]] = ()) -> Column:
    """Score of a record by columns last_ms, count, feedback, importance and vector; the lowest is evicted first."""
    last = F.coalesce("last_ms", "created_ms", F.lit(0)).cast("double")
    count = F.coalesce("count", F.lit(0)).cast("double")
    if policy == "lru":
        return last / F.lit(float(now_ms))
    if policy == "lfu":
        return count
    if policy != "coherence":
        raise invalid(f"unknown policy {policy}")
    days = F.greatest(F.lit(0.0), F.lit(float(now_ms)) - last) / 86_400_000.0
    coherent = F.lit(0.5)
    if recent:
        alike = [vector.similarity(metric, vector.distance(metric, F.col("vector"), vector.vector(q))) for q in recent[-MOST_RECENT:]]
        best = F.greatest(*alike) if len(alike) > 1 else alike[0]
        coherent = F.greatest(F.lit(0.0), F.least(F.lit(1.0), best))
    frequency = 1 - 1 / (1 + count)
    return 0.25 * F.exp(-days / 30) + 0.35 * frequency + 0.4 * coherent + 0.2 * F.coalesce("importance", F.lit(0.5)) + 0.2 * F.tanh(F.coalesce("feedback", F.lit(0.0)) / 4)


def evictions(records: DataFrame, target: int, score: Column, per_cluster: int = 2) -> DataFrame:
    """(id, score, cluster) of the rows to evict until ``target`` remain.

    Pinned rows stay, and so do the ``per_cluster`` best of each cluster (kind and first tag); of the others the lowest go.
    That equals walking upwards by score and skipping clusters that are down to their minimum.
    """
    before = records.count()
    if before <= target:
        return records.select("id", F.lit(0.0).alias("score"), F.lit("").alias("cluster")).limit(0)
    cluster = F.concat(F.coalesce("kind", F.lit("")), F.lit("|"), F.coalesce(F.get("tags", F.lit(0)), F.lit("")))
    scored = records.where(~F.coalesce("pinned", F.lit(False))).select("id", score.alias("score"), cluster.alias("cluster"))
    scored = materialise(scored, "scores")
    # a rank filter is applied in each task before the shuffle, so a large cluster sends only its best
    place = F.row_number().over(W.partitionBy("cluster").orderBy(F.col("score").desc(), F.col("id").desc()))
    kept = scored.withColumn("_p", place).where(F.col("_p") <= per_cluster).select("id")
    return lowest(scored.join(kept, "id", "left_anti"), before - target, "score", "id")


def lowest(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The ``n`` first rows by ``order``, for large ``n``: rows are sorted in ranges, and only the range of the cut is ranked.

    Ranges are counted (a number for each reaches the driver); the whole ones below the cut are taken as they are.
    """
    parts = shuffle_partitions(rows.sparkSession)
    dealt = materialise(rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = sorted((r["_range"], r["count"]) for r in dealt.groupBy("_range").count().collect())
    below, left = -1, n
    for k, size in counts:
        if size > left:
            rest = dealt.where(F.col("_range") == k).orderBy(*order).limit(left)
            return dealt.where(F.col("_range") <= below).unionByName(rest).drop("_range")
        below, left = k, left - size
    return dealt.drop("_range")


def compact(records: DataFrame, target: int, score: Column, per_cluster: int = 2) -> DataFrame:
    return records.join(evictions(records, target, score, per_cluster).select("id"), "id", "left_anti")


def auto_target(capacity: int, live: int) -> int | None:
    return int(capacity * 0.8) if 0 < capacity < live else None


# log and branches


def replay(log: DataFrame) -> DataFrame:
    """The state behind a log (generation, id, op, ...): the last operation of each id, unless it is a delete."""
    fields = [c for c in log.columns if c not in ("id",)]
    last = log.groupBy("id").agg(F.max_by(F.struct(*fields), "generation").alias("_l"))
    return last.select("id", "_l.*").where("op <> 'delete'").drop("op")


def log_breaks(log: DataFrame) -> DataFrame:
    """Generations that don't follow their predecessor: a gap or a repeat."""
    before = log.select((F.col("generation") + 1).alias("generation")).distinct()
    first = log.agg(F.min("generation").alias("_first"))
    gaps = log.join(before, "generation", "left_anti").crossJoin(F.broadcast(first)).where("generation <> _first").select("generation")
    return gaps.union(log.groupBy("generation").count().where("count > 1").select("generation"))


@dataclass
class Branch:
    """A parent table, rows written on the branch, and ids deleted on it. Reads see the merged view."""

    parent: DataFrame
    overlay: DataFrame
    tombstones: DataFrame
    base_generation: int = 0

    def view(self) -> DataFrame:
        hidden = self.overlay.select("id").union(self.tombstones.select("id")).distinct()
        return self.parent.join(hidden, "id", "left_anti").unionByName(self.overlay)

    def conflicts(self, generations: DataFrame) -> DataFrame:
        """Ids that the branch touches and the parent changed after the branch began (id, generation)."""
        touched = self.overlay.select("id").union(self.tombstones.select("id")).distinct()
        return touched.join(generations, "id").where(F.col("generation") > self.base_generation)

    def merge(self, generations: DataFrame, force: bool = False) -> DataFrame:
        found = self.conflicts(generations)
        if not force and not found.isEmpty():
            raise EngineError("INVALID_ARGUMENT", "the parent changed rows of the branch", conflicts=[r["id"] for r in found.limit(100).collect()])
        return self.view()

    def discard(self) -> DataFrame:
        return self.parent


def purge(ids: DataFrame, **stores: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every store without the ids, and (store, removed) counts."""
    left, counts = {}, None
    for name, df in stores.items():
        left[name] = df.join(ids, "id", "left_anti")
        n = df.join(ids, "id", "left_semi").agg(F.lit(name).alias("store"), F.count("*").alias("removed"))
        counts = n if counts is None else counts.union(n)
    return left, counts


def reembed(records: DataFrame, embed: Callable[[Column], Column], text: str = "text") -> DataFrame:
    return records.withColumn("vector", embed(F.col(text)))


def checksum(df: DataFrame) -> DataFrame:
    """(rows, checksum): a sum over row digests, the same in any order of rows and on any number of tasks.

    Fields are written with their lengths in bytes and nulls with a mark of their own, so no two rows read alike; of each
    row's sha256, 60 bits are summed exactly.
    """
    fields = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (F.col(f"`{n}`").cast("string") for n in sorted(df.columns))]
    digest = F.sha2(F.concat_ws(",", *fields), 256)
    number = F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(number), F.lit(0)).cast("string").alias("checksum"))


# witness


def entry_hash(previous: str, seq: int, operation: str, record: str, payload_hash: str, timestamp: str, actor: str) -> str:
    return hashlib.sha256("|".join([previous, str(seq), *(x or "" for x in (operation, record, payload_hash, timestamp, actor))]).encode()).hexdigest()


_CHAINED = ("operation", "record_id", "payload_hash", "timestamp", "actor")
_ENTRY = "log string, seq long, prev_hash string, hash string, operation string, record_id string, timestamp string, actor string, payload_hash string"


def append(entries: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Chain new entries (log, ord, operation, record_id, timestamp, actor, payload) behind each log's head (log, seq, hash).

    A chain is sequential, so each log is read by one task; a task has its logs one behind the other, in order, and holds a batch
    of their rows at a time.
    """
    visible_to_workers(entries.sparkSession)
    rows = entries.withColumn("payload_hash", F.sha2(F.coalesce("payload", F.lit("")), 256)).drop("payload")
    begun = rows if heads is None else rows.join(heads.select("log", F.col("seq").alias("_s"), F.col("hash").alias("_h")), "log", "left")
    if heads is None:
        begun = begun.withColumn("_s", F.lit(None).cast("long")).withColumn("_h", F.lit(None).cast("string"))
    read = [F.col(c) for c in ("log", *_CHAINED, "_s", "_h")]
    return begun.repartition("log").sortWithinPartitions("log", F.col("ord").asc_nulls_last()).select(*read).mapInArrow(_chain, _ENTRY)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (log, what is hashed, the head's seq and hash), sorted by log and place, as entries."""
    log, previous, seq, begun = None, GENESIS, 0, False
    for batch in batches:
        if not batch.num_rows:
            continue
        logs, *told, heads, hashes = (c.to_pylist() for c in batch.columns)
        places, before, after = [], [], []
        for k, name in enumerate(logs):
            if not begun or name != log:
                log, begun = name, True
                previous, seq = (GENESIS, 0) if heads[k] is None else (hashes[k], heads[k])
            seq += 1
            places.append(seq)
            before.append(previous)
            previous = entry_hash(previous, seq, *(x[k] for x in told))
            after.append(previous)
        held = {n: batch.column(n) for n in ("log", *_CHAINED)} | {"seq": pa.array(places, pa.int64()), "prev_hash": pa.array(before, pa.string()), "hash": pa.array(after, pa.string())}
        names = [c.split()[0] for c in _ENTRY.split(", ")]
        yield pa.RecordBatch.from_arrays([held[n] for n in names], names)


def verify(log: DataFrame) -> DataFrame:
    """(log, entries, ok, first_break): each entry is checked against those of the sequence number before, in one pass in their order."""
    fields = [F.coalesce(F.col(c), F.lit("")) for c in _CHAINED]
    told = F.concat_ws("|", "prev_hash", F.col("seq").cast("string"), *fields)
    own = log.select("log", "seq", "prev_hash", "hash", F.col("hash").eqNullSafe(F.sha2(told, 256)).alias("_own"))  # all that is dealt by log
    before = W.partitionBy("log").orderBy("seq").rangeBetween(-1, -1)
    linked = own.withColumn("_low", F.min(F.struct("hash")).over(before)).withColumn("_high", F.max(F.struct("hash")).over(before))
    fits = [F.col("prev_hash").eqNullSafe(F.when(F.col("seq") == 1, F.lit(GENESIS)).otherwise(F.col(c)["hash"])) for c in ("_low", "_high")]
    broken = ~(F.col("_own") & fits[0] & fits[1])
    out = linked.groupBy("log").agg(F.count("*").alias("entries"), F.min(F.when(broken, F.col("seq"))).alias("first_break"))
    return out.withColumn("ok", F.col("first_break").isNull())


def head(log: DataFrame) -> DataFrame:
    return log.groupBy("log").agg(F.max("seq").alias("seq"), F.max_by("hash", "seq").alias("hash"))


def entries_after(log: DataFrame, seq: int) -> DataFrame:
    return log.where(F.col("seq") > seq)
