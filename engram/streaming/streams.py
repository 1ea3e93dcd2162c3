"""Streams: a write log applied generation by generation, sliding sessions, and a change feed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from engram.operators.lifecycle import replay
from engram.session import visible_to_workers


def apply_log(log: DataFrame, state_path: str, checkpoint: str) -> StreamingQuery:
    """Keep the last operation of each id under ``state_path``; each batch writes a version of its own, read by ``state``."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch if number == 0 else batch.unionByName(spark.read.parquet(f"{state_path}/v={number - 1}"))
        fields = [c for c in batch.columns if c != "id"]
        last = rows.groupBy("id").agg(F.max_by(F.struct(*fields), "generation").alias("l")).select("id", "l.*")
        last.select(*batch.columns).write.mode("overwrite").parquet(f"{state_path}/v={number}")

    return log.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state(spark, state_path: str, version: int) -> DataFrame:
    """The live rows after a batch; deletes are kept in the state so that a late older write stays hidden."""
    return replay(spark.read.parquet(f"{state_path}/v={version}"))


def changes(log: DataFrame, tell: Callable[[DataFrame, int], None], checkpoint: str, after: int = 0) -> StreamingQuery:
    """A feed of log entries behind a generation."""
    return log.where(F.col("generation") > after).writeStream.foreachBatch(tell).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(turns: DataFrame, ttl_minutes: int = 240) -> DataFrame:
    """Sliding sessions of a stream (key, at timestamp): a row for each session when it closes, by event time and watermark.

    A turn within the time to live keeps its session open; state is dropped when the session has expired.
    """
    visible_to_workers(turns.sparkSession)
    ttl = ttl_minutes * 60_000

    def update(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        closed = []
        if held.hasTimedOut:
            start, last, n = held.get
            closed.append((key[0], start, last, last + ttl, n))
            held.remove()
        else:
            times = sorted(int(t) for b in batches for t in b["at_ms"])
            start, last, n = held.get if held.exists else (times[0], times[0], 0)
            for t in times:
                if n and t - last > ttl:
                    closed.append((key[0], start, last, last + ttl, n))
                    start, n = t, 0
                last, n = max(last, t) if n else t, n + 1
            held.update((start, last, n))
            held.setTimeoutTimestamp(max(last + ttl, held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(closed, columns=["key", "started_ms", "last_ms", "expires_ms", "n_turns"])

    marked = turns.withWatermark("at", "0 seconds").withColumn("at_ms", F.unix_millis("at"))
    return marked.groupBy("key").applyInPandasWithState(update, "key long, started_ms long, last_ms long, expires_ms long, n_turns long", "started long, last long, n long", "append", GroupStateTimeout.EventTimeTimeout)
