"""The typed memory layer: remember, recall, time travel, budgets, skills, causes, sessions, learning and consolidation."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram.errors import EngineError, invalid
from engram.functions import vector
from engram.operators.search import Search, batch_knn, search
from engram.session import visible_to_workers

OPEN_END = 8_640_000_000_000_000
DAY_MS = 86_400_000


def round4(x: Column) -> Column:
    """Four decimals, halves upwards."""
    return F.floor(x * 10_000 + 0.5) / 10_000


def approx_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("int")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def capitalize(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


# remember


def novelty(existing: DataFrame, new: DataFrame, explicit: str | None = None, near: float = 0.8, metric: str = "cosine") -> DataFrame:
    """``new`` (id, vector, ...) with novelty, importance and the number of near duplicates among its five neighbours."""
    found = batch_knn(existing, new.select(F.col("id").alias("query_id"), "vector"), 5, metric)
    alike = vector.similarity(metric, F.col("distance"))
    best = found.groupBy("query_id").agg(F.max(alike).alias("best"), F.sum((alike >= near).cast("long")).alias("similar"))
    out = new.join(best, new["id"] == best["query_id"], "left").drop("query_id")
    fresh = clamp(1 - F.coalesce("best", F.lit(0.0)))
    out = out.withColumn("novelty", fresh).withColumn("similar", F.coalesce("similar", F.lit(0).cast("long"))).drop("best")
    given = F.col(explicit) if explicit else F.lit(None).cast("double")
    return out.withColumn("importance", F.when(given.isNotNull(), 0.6 * given + 0.4 * F.col("novelty")).otherwise(0.5 * F.col("novelty") + 0.25))


def supersede(versions: DataFrame, key: str, start: str, order: Sequence[str] = ()) -> DataFrame:
    """Close each version where the next one of its key begins: valid_from, valid_to (open: ``OPEN_END``), superseded."""
    following = F.lead(start).over(W.partitionBy(key).orderBy(start, *order))
    out = versions.withColumn("valid_from", F.col(start)).withColumn("valid_to", F.coalesce(following, F.lit(OPEN_END)))
    return out.withColumn("superseded", F.col("valid_to") < OPEN_END)


def as_of(versions: DataFrame, at_ms: int) -> DataFrame:
    """Rows valid at a time: valid_from <= t < valid_to."""
    return versions.where((F.col("valid_from") <= at_ms) & (F.col("valid_to") > at_ms))


# recall


def recall_filter(now_ms: int, kinds: Sequence[str] = (), tags: Sequence[str] = (), session: str | None = None, since_ms: int | None = None, until_ms: int | None = None, at_ms: int | None = None, superseded: bool = False, extra: Mapping | None = None, columns: Iterable[str] = ()) -> dict:
    """The filter of a recall; its own keys override the caller's, and only columns that exist are tested."""
    where: dict = dict(extra or {})
    columns = set(columns)
    if kinds:
        where["kind"] = {"$in": [k.lower() for k in kinds]}
    if tags:
        where["tags"] = {"$all": list(tags)}
    if session is not None:
        where["session_id"] = session
    if since_ms is not None or until_ms is not None:
        where["created_ms"] = {op: v for op, v in (("$gte", since_ms), ("$lte", until_ms)) if v is not None}
    if at_ms is not None:
        where |= {"valid_from": {"$lte": at_ms}, "valid_to": {"$gt": at_ms}}
    elif not superseded and "valid_to" in columns:
        where["valid_to"] = {"$gt": now_ms}
    if "expires_ms" in columns:
        where["expires_ms"] = {"$gt": now_ms}
    return where


def pack_budget(hits: DataFrame, budget: int, k: int, tokens: str = "tokens", rank: str = "rank") -> DataFrame:
    """Hits in rank order while they fit the budget, skipping those that don't, up to ``k``; hits are a bounded list."""
    row = F.struct(F.col(rank).alias("_r"), F.col(tokens).cast("long").alias("_t"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.expr("CAST(array() AS array<int>)").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["used"] + x["_t"] <= budget) & (F.size(acc["kept"]) < k)
        return F.when(fits, F.struct((acc["used"] + x["_t"]).alias("used"), F.array_append(acc["kept"], x["_r"].cast("int")).alias("kept"))).otherwise(acc)

    chosen = hits.agg(F.aggregate(F.array_sort(F.collect_list(row)), start, step)["kept"].alias("kept")).select(F.explode("kept").alias(rank))
    return hits.join(F.broadcast(chosen), rank, "left_semi")


def recall(records: DataFrame, query: Sequence[float], now_ms: int, text: str | None = None, k: int = 10, half_life_days: float | None = None, min_similarity: float | None = None, feedback: DataFrame | None = None, budget_tokens: int | None = None, alpha: float = 0.6, gate: str | None = None, capabilities: int | None = None, **chosen) -> DataFrame:
    """Hybrid recall: filter, fuse, decay (only with a half-life), then similarity floor, learning boost and token budget."""
    where = recall_filter(now_ms, columns=records.columns, **chosen)
    fetch = min(3 * k, 1000) if budget_tokens else k
    s = Search(query, fetch, where=where, lexical=text, alpha=alpha, decay={"half_life_days": half_life_days, "now_ms": now_ms} if half_life_days else None, gate=gate, capabilities=capabilities)
    hits = search(records, s)
    if min_similarity is not None:
        hits = hits.where(F.col("similarity") >= min_similarity)
    if feedback is not None:
        boosted = hits.join(feedback.select("id", F.col("feedback").alias("_f")), "id", "left")
        hits = boosted.withColumn("final", F.col("final") * (1 + 0.15 * F.tanh(F.coalesce("_f", F.lit(0.0)) / 4))).drop("_f")
        hits = hits.withColumn("rank", F.row_number().over(W.orderBy(F.col("final").desc(), "rank")))
    if budget_tokens:
        hits = pack_budget(hits.withColumn("tokens", approx_tokens(F.col("text"))), budget_tokens, k)
    return hits


def expand(hits: DataFrame, graph, hops: int, limit: int = 50) -> DataFrame:
    """Up to ``limit`` graph neighbours of the hits, nearest first."""
    near = graph.k_hop(hits.select("id").distinct(), hops)
    return near.groupBy("id").agg(F.min("hops").alias("hops")).orderBy("hops", "id").limit(limit)


def shape(hits: DataFrame) -> DataFrame:
    """Hits as they are shown: text beside rounded scores."""
    return hits.select("id", "text", "kind", round4(F.col("similarity")).alias("similarity"), round4(F.col("final")).alias("score"))


# episodes, skills, causes


def episode_text(task: Column, critique: Column, outcome: Column) -> Column:
    lines = [F.when(c.isNotNull(), F.concat(F.lit(f"{n}: "), c)) for n, c in (("Task", task), ("Critique", critique), ("Outcome", outcome))]
    return F.concat_ws("\n", *lines)


def episode_importance(reward: Column) -> Column:
    return (reward + 1) / 2


def skill_counters(outcomes: DataFrame, skill: str = "skill", success: str = "success") -> DataFrame:
    wins = F.sum(F.col(success).cast("long"))
    return outcomes.groupBy(skill).agg(F.count("*").alias("usage_count"), wins.alias("successes"), (wins / F.count("*")).alias("success_rate"))


def causal_rank(hyperedges: DataFrame, query: Sequence[float], k: int) -> DataFrame:
    """The best of the 4k (at most 200) most similar causal edges by similarity times confidence."""
    s = 1 - vector.cosine_distance(F.col("embedding"), vector.vector(query))
    near = hyperedges.withColumn("similarity", s).orderBy(F.col("similarity").desc(), "id").limit(min(4 * k, 200))
    return near.withColumn("score", F.col("similarity") * F.col("confidence")).orderBy(F.col("score").desc(), "id").limit(k)


def folded_confidence(outcomes: DataFrame, initial: float = 0.5, rate: float = 0.2) -> DataFrame:
    """Confidence of each id after its confirmations in order: c += rate * (target - c), in closed form.

    The n-th last outcome weighs rate * (1 - rate) ** n, so no order-dependent fold is needed.
    """
    back = F.row_number().over(W.partitionBy("id").orderBy(F.col("ord").desc())) - 1
    weighed = outcomes.withColumn("_w", rate * F.pow(F.lit(1 - rate), back))
    return weighed.groupBy("id").agg((F.pow(F.lit(1 - rate), F.count("*")) * initial + F.sum(F.col("_w") * F.col("confirmed").cast("double"))).alias("confidence"))


# sessions


def ordered_turns(turns: DataFrame, session: str = "session", order: str = "turn", last: int | None = None) -> DataFrame:
    """Turns with their place from 1, or only the last few of each session."""
    if last is None:
        return turns.withColumn("place", F.row_number().over(W.partitionBy(session).orderBy(order)))
    back = F.row_number().over(W.partitionBy(session).orderBy(F.col(order).desc()))
    return turns.withColumn("back", back).where(F.col("back") <= last).drop("back")


def sliding_sessions(activity: DataFrame, key: str, at_ms: str, ttl_minutes: int = 240) -> DataFrame:
    """Sessions that every activity keeps open for another ``ttl_minutes``: started_ms, last_ms, expires_ms, n_turns."""
    ttl = ttl_minutes * 60_000
    order = W.partitionBy(key).orderBy(at_ms)
    gap = F.col(at_ms) - F.lag(at_ms).over(order)
    number = F.sum(F.when(gap.isNull() | (gap > ttl), 1).otherwise(0)).over(order.rangeBetween(W.unboundedPreceding, 0))
    out = activity.withColumn("session", number).groupBy(key, "session").agg(F.min(at_ms).alias("started_ms"), F.max(at_ms).alias("last_ms"), F.count("*").alias("n_turns"))
    return out.withColumn("expires_ms", F.col("last_ms") + ttl)


def expire(records: DataFrame, now_ms: int, column: str = "expires_ms") -> DataFrame:
    return records.where(F.col(column).isNull() | (F.col(column) > now_ms))


# learning


def feedback(outcomes: DataFrame) -> DataFrame:
    """(id, feedback) of shown results: chosen ones get the reward, others lose a quarter of a positive one."""
    value = F.when(F.col("chosen"), F.col("reward")).when(F.col("reward") > 0, -0.25 * F.col("reward")).otherwise(0.0)
    return outcomes.groupBy("id").agg(F.sum(value).alias("feedback"))


def routing(outcomes: DataFrame) -> DataFrame:
    """(state, action, value, n): running values with step 1/min(n, 20), in closed form.

    The first 20 rewards are averaged; each later one moves the value by a twentieth of the difference, so a reward that
    is m-th behind the 20th weighs (1/20) * (19/20) ** (number after it).
    """
    key = ("state", "action")
    at = F.row_number().over(W.partitionBy(*key).orderBy("ord"))
    total = F.count("*").over(W.partitionBy(*key))
    late = F.greatest(F.lit(0).cast("long"), F.col("_n") - 20)
    weight = F.when(F.col("_at") <= 20, F.pow(F.lit(0.95), late) / F.least(F.lit(20).cast("long"), F.col("_n"))).otherwise(0.05 * F.pow(F.lit(0.95), F.col("_n") - F.col("_at")))
    return outcomes.withColumn("_at", at).withColumn("_n", total).groupBy(*key).agg(F.sum(weight * F.col("reward")).alias("value"), F.count("*").alias("n"))


def recommend(table: DataFrame, candidates: Sequence[str] | None = None, epsilon: float = 0.0, seed: int = 0) -> DataFrame:
    """(state, action) of the largest value, ties by action; with ``epsilon`` a seeded share of states explores."""
    rows = table.where(F.col("action").isin(list(candidates))) if candidates else table
    best = rows.groupBy("state").agg(F.max("value").alias("_v"), F.array_sort(F.collect_set("action")).alias("all"))
    ties = rows.join(best.select("state", "_v"), "state").where(F.col("value") == F.col("_v")).groupBy("state").agg(F.min("action").alias("best"))
    out = best.join(ties, "state")
    draw = F.pmod(F.xxhash64("state", F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    other = F.element_at("all", (F.pmod(F.xxhash64("state", F.lit(seed + 1)), F.size("all")) + 1).cast("int"))
    return out.select("state", F.when(draw < epsilon, other).otherwise(F.col("best")).alias("action"))


# consolidation


def consolidate(records: DataFrame, group: Sequence[str] = (), threshold: float = 0.75, least: int = 3, min_success: float = 0.6, most_clusters: int = 20, most_rows: int = 20_000) -> DataFrame:
    """Leader clustering by running centroids in order of creation: a row per proposed cluster.

    The order decides the clusters, so each group (such as a namespace) is one task; a group must be bounded, and one
    beyond ``most_rows`` is refused. Columns id, vector, created_ms, text and optionally success (boolean or null).
    """
    visible_to_workers(records.sparkSession)
    group = list(group)
    rows = records if "success" in records.columns else records.withColumn("success", F.lit(True))
    rows = rows.select(*group, "id", "vector", "created_ms", "text", "success")

    def propose(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > most_rows:
            raise EngineError("LIMIT_EXCEEDED", "the group is too large to consolidate at once")
        pdf = pdf.sort_values(["created_ms", "id"], kind="stable").reset_index(drop=True)
        x = np.array(pdf["vector"].tolist(), dtype=np.float64)
        members: list[list[int]] = []
        centroids = np.zeros((0, x.shape[1]))
        for i, v in enumerate(x):
            alike = centroids @ v
            near = np.flatnonzero(alike >= threshold)
            if not len(near):
                members.append([i])
                centroids = np.vstack([centroids, v])
                continue
            best = near[np.flatnonzero(alike[near] == alike[near].max())[-1]]
            members[best].append(i)
            n = len(members[best])
            c = (centroids[best] * (n - 1) + v) / n
            centroids[best] = c / (np.sqrt((c * c).sum()) or 1.0)
        out = []
        for m in [m for m in members if len(m) >= least][:most_clusters]:
            rated = [bool(pdf["success"][i]) for i in m if pdf["success"][i] is not None and not pd.isna(pdf["success"][i])]
            rate = sum(rated) / len(rated) if rated else 1.0
            medoid = m[int(np.argmax((x[m] @ x[m].T).sum(axis=1)))]
            out.append((*key, int(pdf["id"][m[0]]) if pd.api.types.is_integer_dtype(pdf["id"]) else pdf["id"][m[0]], pdf["id"][medoid], len(m), float(np.floor(rate * 10_000 + 0.5) / 10_000), rate >= min_success, str(pdf["text"][medoid])))
        return pd.DataFrame(out, columns=[*group, "leader_id", "medoid_id", "size", "success_rate", "eligible", "medoid_text"])

    id_type = records.schema["id"].dataType.simpleString()
    keys = "".join(f"`{g}` {records.schema[g].dataType.simpleString()}, " for g in group)
    return rows.groupBy(*group).applyInPandas(propose, f"{keys}leader_id {id_type}, medoid_id {id_type}, size long, success_rate double, eligible boolean, medoid_text string")


def check_session(sessions: DataFrame, session: str, now_ms: int) -> None:
    row = sessions.where(F.col("session_id") == session).first()
    if row is None:
        raise EngineError("NOT_FOUND", f"no session {session}")
    if row["expires_ms"] <= now_ms:
        raise invalid(f"session {session} has expired")
