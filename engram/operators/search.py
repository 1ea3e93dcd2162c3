"""Vector and hybrid search: filter, exact top-k, re-ranking in the fixed order decay, coherence, fusion, sort, diversity.

A filter and the capability gate stand before the distance, so they reach the scan and ``k`` counts matching rows. Only the
over-fetched candidates are re-ranked; they are bounded by ``MAX_OVERFETCH``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from engram.errors import MAX_DIMENSION, MAX_K, MAX_OVERFETCH, MAX_QUERY_CHARS, EngineError, invalid
from engram.functions import lexical, vector
from engram.functions.filters import capability_gate, compile_filter
from engram.session import materialise, visible_to_workers

MOST_QUERY_BYTES = 16 << 20
STEP = 1024  # rows multiplied at a time
TILE = 1 << 20  # numbers of a product
COHERENT = 200


@dataclass
class Search:
    query: Sequence[float]
    k: int = 10
    metric: str = "cosine"
    where: Mapping = field(default_factory=dict)
    capabilities: int | None = None
    gate: str | None = None  # column of required capability bits
    decay: Mapping | None = None  # half_life_days or lambda_per_day, column, now_ms
    coherence: Mapping | None = None  # weight, threshold
    lexical: str | None = None
    method: str = "rrf"
    alpha: float = 0.5
    rrf_k: int = 60
    diversity: float | None = None

    def check(self, dimension: int | None = None) -> None:
        if not 1 <= self.k <= MAX_K:
            raise invalid("k must be between 1 and 1000", k=self.k)
        if self.metric not in vector.METRICS:
            raise invalid(f"unknown metric {self.metric}")
        if len(self.query) > MAX_DIMENSION:
            raise EngineError("LIMIT_EXCEEDED", "too many dimensions")
        if dimension is not None and len(self.query) != dimension:
            raise EngineError("DIMENSION_MISMATCH", f"the query has {len(self.query)} dimensions, the collection {dimension}")
        if self.lexical is not None and len(self.lexical) > MAX_QUERY_CHARS:
            raise EngineError("LIMIT_EXCEEDED", "query too long")
        if self.method not in ("rrf", "rsf"):
            raise invalid(f"unknown fusion {self.method}")
        if self.diversity is not None and not 0 <= self.diversity <= 1:
            raise invalid("diversity must be between 0 and 1")

    @property
    def reranks(self) -> bool:
        return bool(self.decay or self.coherence or self.lexical or self.diversity)


def visible(records: DataFrame, where: Mapping | None, capabilities: int | None = None, gate: str | None = None) -> DataFrame:
    out = records.where(compile_filter(where, records.schema))
    return out.where(capability_gate(F.col(gate), capabilities)) if gate else out


def with_distance(records: DataFrame, query: Sequence[float], metric: str, column: str = "vector") -> DataFrame:
    """Cosine collections hold unit vectors; the query is brought to unit length here."""
    q = np.asarray(query, dtype=np.float32)
    n = np.sqrt((q.astype(np.float64) ** 2).sum())
    if metric == "cosine" and n > 0 and abs(n - 1) > 1e-6:  # what is a unit vector in single precision stays as it is
        q = (q / n).astype(np.float32)
    return records.withColumn("distance", vector.distance(metric, F.col(column), vector.vector(q.tolist())))


def knn(records: DataFrame, query: Sequence[float], k: int, metric: str = "cosine", key: str = "id") -> DataFrame:
    """The ``k`` nearest rows; every partition keeps its own ``k`` before they meet."""
    near = with_distance(records, query, metric).withColumn("similarity", vector.similarity(metric, F.col("distance")))
    return near.orderBy("distance", key).limit(k)


def _distances(metric: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of each query (row) to each vector (column)."""
    if metric == "cosine":
        return np.maximum(0.0, 1 - q @ x.T)
    if metric == "dotProduct":
        return -(q @ x.T)
    if metric == "euclidean":
        return np.sqrt(((q[:, None] - x[None]) ** 2).sum(axis=2))
    return np.abs(q[:, None] - x[None]).sum(axis=2)


def _in_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(keys, vectors) of at most ``STEP`` rows at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, STEP):
            part = batch.slice(i, STEP)
            yield part.column(0), part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)


def _tiles(metric: str, n: int, x: np.ndarray) -> Iterator[slice]:
    """The ``n`` queries in ranges so short that a product with the vectors stays small."""
    step = max(1, TILE // (x.size if metric in ("euclidean", "manhattan") else len(x)))
    for i in range(0, n, step):
        yield slice(i, min(n, i + step))


def _nearest(d: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` nearest of each row's candidates; ties at the edge go by name."""
    if d.shape[1] <= k:
        return d, names
    at = np.argpartition(d, k - 1, axis=1)[:, :k]
    edge = np.take_along_axis(d, at, 1).max(axis=1)
    for r in np.flatnonzero((d == edge[:, None]).sum(axis=1) > 1):
        at[r] = sorted(np.flatnonzero(d[r] <= edge[r]), key=lambda c, r=r: (d[r, c], names[r, c]))[:k]
    return np.take_along_axis(d, at, 1), np.take_along_axis(names, at, 1)


def _by_blocks(records: DataFrame, queries: DataFrame, kernel: Callable, schema: str, key: str, block_bytes: int) -> DataFrame:
    """Rows that ``kernel(shared)`` makes of all records for every block of queries.

    One block is the usual case. If the queries exceed ``block_bytes``, they are written once and dealt to blocks by hash,
    and each block's rows are written before the next block is read, so the driver holds a single block.
    """
    spark = records.sparkSession
    visible_to_workers(spark)
    asked, rows = queries.select("query_id", "vector"), records.select(key, "vector")

    def read(block: DataFrame):
        found = block.toArrow()
        ids, vectors = (found.column(c).combine_chunks() for c in ("query_id", "vector"))
        if vectors.null_count or len(pc.unique(vectors.value_lengths())) > 1:
            raise invalid("the queries' vectors must have one length")
        values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return spark.sparkContext.broadcast((ids, values.reshape(len(ids), -1 if len(ids) else 0)))

    size = asked.agg(F.sum(8 * F.size("vector") + 32)).first()[0] or 0
    if size <= block_bytes:
        return rows.mapInArrow(kernel(read(asked)), schema)
    blocks = 2 * -(-size // block_bytes)
    asked, out = materialise(asked, "queries"), None
    for b in range(blocks):
        shared = read(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b))
        part = materialise(rows.mapInArrow(kernel(shared), schema), f"block{b}")
        shared.destroy()
        out = part if out is None else out.union(part)
    return out


def batch_knn(records: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", key: str = "id", block_bytes: int = MOST_QUERY_BYTES) -> DataFrame:
    """(query_id, key, distance, rank) of the ``k`` nearest rows of each query (columns query_id, vector).

    Queries are read in blocks of a bounded size and multiplied with Arrow batches of the records; each task keeps ``k``
    rows a query, so what is shuffled doesn't grow with the records a task reads.
    """
    key_type = records.schema[key].dataType.simpleString()
    query_type = queries.schema["query_id"].dataType.simpleString()
    arrow = to_arrow_type(queries.schema["query_id"].dataType), to_arrow_type(records.schema[key].dataType)

    def kernel(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            best_d, best_k = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), dtype=np.int64)
            for told, x in _in_steps(batches) if len(ids) else ():
                whole = pa.types.is_integer(told.type) and not told.null_count
                keys = told.to_numpy(zero_copy_only=False) if whole else np.array(told.to_pylist(), dtype=object)
                width = best_d.shape[1]
                if width < k or best_k.dtype != keys.dtype:  # all queries get as many rows, until they have k
                    grown = min(k, width + len(keys)), np.result_type(best_k, keys) if width else keys.dtype
                    d, names = np.zeros((len(ids), grown[0])), np.zeros((len(ids), grown[0]), dtype=grown[1])
                else:
                    d, names = best_d, best_k
                for tile in _tiles(metric, len(ids), x):
                    new = _distances(metric, x, q[tile])
                    rows = np.arange(tile.start, tile.stop)
                    if d is best_d:  # a query with nothing nearer or as near stays as it is
                        better = np.flatnonzero(~(new > best_d[tile].max(axis=1)[:, None]).all(axis=1))
                        rows, new = rows[better], new[better]
                    if len(rows):
                        both = np.hstack([best_k[rows], np.broadcast_to(keys, (len(rows), len(keys)))]) if width else np.broadcast_to(keys, (len(rows), len(keys)))
                        d[rows], names[rows] = _nearest(np.hstack([best_d[rows], new]), both, k)
                best_d, best_k = d, names
            n = best_d.shape[1]
            for i in range(0, len(ids) if n else 0, STEP * 16):
                some = slice(i, i + STEP * 16)
                of = pa.array(np.repeat(np.arange(len(ids))[some], n))
                names = best_k[some].ravel()
                yield pa.RecordBatch.from_arrays([ids.take(of).cast(arrow[0]), pa.array(names.tolist() if names.dtype == object else names, arrow[1]), pa.array(best_d[some].ravel())], ["query_id", key, "distance"])

        return run

    near = _by_blocks(records, queries, kernel, f"query_id {query_type}, `{key}` {key_type}, distance double", key, block_bytes)
    place = F.row_number().over(W.partitionBy("query_id").orderBy("distance", key))
    return near.withColumn("rank", place).where(F.col("rank") <= k)


def batch_above(records: DataFrame, queries: DataFrame, similarity: float, metric: str = "cosine", key: str = "id", block_bytes: int = MOST_QUERY_BYTES) -> DataFrame:
    """(query_id, key, similarity) of all rows at least so similar to a query; queries are read in blocks as in ``batch_knn``."""
    key_type = records.schema[key].dataType.simpleString()
    query_type = queries.schema["query_id"].dataType.simpleString()
    arrow = to_arrow_type(queries.schema["query_id"].dataType), to_arrow_type(records.schema[key].dataType)

    def kernel(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            for keys, x in _in_steps(batches) if len(ids) else ():
                for tile in _tiles(metric, len(ids), x):
                    d = _distances(metric, x, q[tile])
                    alike = 1 - d if metric == "cosine" else -d if metric == "dotProduct" else 1 / (1 + d)
                    at, of = np.nonzero(alike >= similarity)
                    if len(at):
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(at + tile.start)).cast(arrow[0]), keys.take(pa.array(of)).cast(arrow[1]), pa.array(alike[at, of])], ["query_id", key, "similarity"])

        return run

    return _by_blocks(records, queries, kernel, f"query_id {query_type}, `{key}` {key_type}, similarity double", key, block_bytes)


# re-ranking


def decay_factor(now_ms: int | Column, created_ms: Column, half_life_days: float | None = None, lambda_per_day: float | None = None) -> Column:
    """exp(-lambda * age in days); a missing or future time decays nothing."""
    rate = lambda_per_day if lambda_per_day is not None else float(np.log(2) / half_life_days)
    now = now_ms if isinstance(now_ms, Column) else F.lit(now_ms)
    age = F.greatest(F.lit(0.0), (now - created_ms) / F.lit(86_400_000.0))
    return F.coalesce(F.exp(-rate * age), F.lit(1.0))


def coherence_of(items: DataFrame, threshold: float, metric: str, key: str = "id") -> DataFrame:
    """(key, coherence): the share of the other candidates that are similar; ``items`` holds at most ``COHERENT`` rows."""
    a, b = items.select(F.col(key).alias("a"), F.col("vector").alias("va")), items.select(F.col(key).alias("b"), F.col("vector").alias("vb"))
    pair = a.crossJoin(F.broadcast(b)).where("a <> b")  # bounded: the candidates were limited before
    alike = vector.similarity(metric, vector.distance(metric, F.col("va"), F.col("vb"))) >= threshold
    return pair.groupBy(F.col("a").alias(key)).agg((F.sum(alike.cast("int")) / F.count("*")).alias("coherence"))


def ranked(df: DataFrame, score: str, rank: str, key: str = "id") -> DataFrame:
    """Ranks from 0, best first; only for bounded lists."""
    return df.withColumn(rank, F.row_number().over(W.orderBy(F.col(score).desc(), key)) - 1)


def rrf_score(ranks: Sequence[Column], weights: Sequence[float], k: int = 60) -> Column:
    """Reciprocal ranks, scaled so that an item first in every list scores 1; a missing rank adds nothing."""
    total = sum(weights)
    parts = [F.coalesce(F.lit(w * (k + 1) / total) / (F.lit(k + 1) + r), F.lit(0.0)) for r, w in zip(ranks, weights, strict=True)]
    return sum(parts[1:], parts[0])


def rsf_score(scores: Sequence[Column], weights: Sequence[float]) -> Column:
    """Weighted sum of min-max scaled scores over the whole (bounded) list; a constant list adds nothing."""
    everything, total = W.partitionBy(), sum(weights)

    def scaled(s: Column) -> Column:
        low, high = F.min(s).over(everything), F.max(s).over(everything)
        return F.coalesce((s - low) / F.when(high - low == 0, 1.0).otherwise(high - low), F.lit(0.0))

    parts = [F.lit(w / total) * scaled(s) for s, w in zip(scores, weights, strict=True)]
    return sum(parts[1:], parts[0])


def mmr(items: DataFrame, diversity: float, k: int, metric: str = "cosine", key: str = "id", score: str = "final") -> DataFrame:
    """Greedy maximal marginal relevance over bounded candidates: column ``pick`` from 1; the earliest wins a tie."""
    schema = items.schema
    visible_to_workers(items.sparkSession)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, key], ascending=[False, True], kind="stable").reset_index(drop=True)
        if not len(pdf):
            return pdf.assign(pick=pd.Series(dtype="int32"))
        x = np.array(pdf["vector"].tolist(), dtype=np.float64)
        if metric == "euclidean":
            alike = 1 / (1 + np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)))
        elif metric == "manhattan":
            alike = 1 / (1 + np.abs(x[:, None] - x[None]).sum(axis=2))
        else:
            alike = x @ x.T
        final = pdf[score].to_numpy(dtype=np.float64)
        spread = final.max() - final.min()
        relevance = (final - final.min()) / (spread if spread > 0 else 1.0)
        redundant, left, order = np.zeros(len(pdf)), np.ones(len(pdf), bool), []
        for n in range(min(k, len(pdf))):
            value = np.where(left, relevance if n == 0 else (1 - diversity) * relevance - diversity * redundant, -np.inf)
            at = int(np.argmax(value))
            order.append(at)
            left[at] = False
            redundant = np.maximum(redundant, alike[at])
        out = pdf.iloc[order].copy()
        out["pick"] = np.arange(1, len(order) + 1, dtype=np.int32)
        return out

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return items.groupBy().applyInPandas(choose, f"{fields}, pick int")


def search(records: DataFrame, s: Search, key: str = "id") -> DataFrame:
    """All columns of the ``k`` best rows with rank, distance, similarity, decay, coherence, dense_rank, lexical_rank and final."""
    s.check()
    rows = visible(records, s.where, s.capabilities, s.gate)
    fetch = min(max(4 * s.k, 20), MAX_OVERFETCH) if s.reranks else s.k
    items = knn(rows, s.query, fetch, s.metric, key).withColumn("final", F.col("similarity"))
    items = items.withColumn("decay", F.lit(None).cast("double")).withColumn("coherence", F.lit(None).cast("double"))
    if s.decay:
        factor = decay_factor(s.decay["now_ms"], F.col(s.decay.get("column", "created_ms")), s.decay.get("half_life_days"), s.decay.get("lambda_per_day"))
        items = items.withColumn("decay", factor).withColumn("final", F.col("final") * F.col("decay"))
    if s.coherence:
        share = coherence_of(items.orderBy("distance", key).limit(COHERENT), s.coherence.get("threshold", 0.75), s.metric, key)
        items = items.drop("coherence").join(F.broadcast(share), key, "left")
        items = items.withColumn("final", F.col("final") * (1 + F.lit(float(s.coherence["weight"])) * F.coalesce("coherence", F.lit(0.0))))
    if s.lexical:
        allowed = compile_filter(s.where, records.schema)
        if s.gate:
            allowed = allowed & capability_gate(F.col(s.gate), s.capabilities)
        words = lexical.bm25(records, s.lexical, fetch, allowed, key).withColumnRenamed("score", "lexical_score")
        items = _fused(records, materialise(items, "dense"), materialise(words, "lexical"), s, key)
    else:
        items = items.withColumn("dense_rank", F.lit(None).cast("int")).withColumn("lexical_rank", F.lit(None).cast("int"))
    if s.diversity:
        return mmr(items, s.diversity, s.k, s.metric, key).withColumnRenamed("pick", "rank")
    top = items.orderBy(F.col("final").desc(), "distance", key).limit(s.k)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.col("final").desc(), "distance", key)))


def _fused(records: DataFrame, items: DataFrame, words: DataFrame, s: Search, key: str) -> DataFrame:
    """Add rows that only the words found, rank both lists and replace ``final`` by the fused score."""
    only = with_distance(records.join(F.broadcast(words.select(key)), key, "left_semi").join(F.broadcast(items.select(key)), key, "left_anti"), s.query, s.metric)
    only = only.withColumn("similarity", vector.similarity(s.metric, F.col("distance"))).withColumn("final", F.col("similarity"))
    both = items.unionByName(only, allowMissingColumns=True).join(F.broadcast(words), key, "left")
    both = ranked(both, "final", "dense_rank", key)
    lexical_rank = F.row_number().over(W.orderBy(F.col("lexical_score").desc_nulls_last(), key)) - 1
    both = both.withColumn("lexical_rank", F.when(F.col("lexical_score").isNotNull(), lexical_rank))
    weights = (s.alpha, 1 - s.alpha)
    if s.method == "rrf":
        return both.withColumn("final", rrf_score([F.col("dense_rank"), F.col("lexical_rank")], weights, s.rrf_k)).drop("lexical_score")
    return both.withColumn("final", rsf_score([F.col("final"), F.col("lexical_score")], weights)).drop("lexical_score")


def report(records: DataFrame, s: Search) -> dict:
    """fetched, matched, complete and strategy of an exact search."""
    counts = records.agg(F.count("*").alias("fetched"), F.sum(compile_filter(s.where, records.schema).cast("int")).alias("matched")).first()
    return {"fetched": counts["fetched"], "matched": counts["matched"] or 0, "complete": True, "strategy": "exact-filtered" if s.where else "exact"}
