"""The driver's tables seen as the engine's data model: records, a property graph, turns, outcomes, versions and a log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.operators.graph import Graph
from engram.session import table

BASE_MS = 1_704_067_200_000
HOUR_MS = 3_600_000
NOW_MS = BASE_MS + 2000 * HOUR_MS


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have an embedding, as memories."""
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    both = d.join(e, d.doc_id == e.vec_id)
    return both.select(
        F.col("doc_id").alias("id"), F.col("embedding").alias("vector"), "text", F.col("lang").alias("kind"), "source", F.array("source", "lang").alias("tags"),
        (F.lit(BASE_MS) + F.col("doc_id") * HOUR_MS).alias("created_ms"), F.expr("shiftleft(1L, CAST(doc_id % 4 AS INT))").alias("req_caps"), (F.col("doc_id") % 50 == 0).alias("pinned"),
    )


def millis(column: str):
    """Epoch milliseconds of a timestamp, whatever the session's time zone."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(column).cast("timestamp_ntz"))


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0])


_PROPS = {"name": "string", "segment": "string", "balance": "double", "total": "double", "status": "string", "size": "int", "type": "string"}


def _nodes(df: DataFrame, prefix: str, key: str, labels: list[str], **props: str) -> DataFrame:
    cells = [(F.col(props[p]) if p in props else F.lit(None)).cast(t).alias(p) for p, t in _PROPS.items()]
    return df.select(F.concat(F.lit(f"{prefix}:"), F.col(key).cast("string")).alias("id"), F.array(*map(F.lit, labels)).alias("labels"), F.struct(*cells).alias("props"))


def graph(spark: SparkSession, sf_dir: str, hyper: bool = False) -> Graph:
    t = {n: table(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "orders", "part", "lineitem")}
    nodes = _nodes(t["region"], "region", "r_regionkey", ["Region"], name="r_name")
    nodes = nodes.union(_nodes(t["nation"], "nation", "n_nationkey", ["Nation"], name="n_name"))
    nodes = nodes.union(_nodes(t["customer"], "customer", "c_custkey", ["Customer", "Party"], name="c_name", segment="c_mktsegment", balance="c_acctbal"))
    nodes = nodes.union(_nodes(t["supplier"], "supplier", "s_suppkey", ["Supplier", "Party"], name="s_name", balance="s_acctbal"))
    nodes = nodes.union(_nodes(t["orders"], "order", "o_orderkey", ["Order"], total="o_totalprice", status="o_orderstatus"))
    nodes = nodes.union(_nodes(t["part"], "part", "p_partkey", ["Part"], name="p_name", size="p_size", type="p_type"))

    def edges(df: DataFrame, kind: str, src: str, a: str, dst: str, b: str, confidence=None) -> DataFrame:
        ends = [F.concat(F.lit(f"{p}:"), F.col(c).cast("string")) for p, c in ((src, a), (dst, b))]
        key = F.concat_ws("|", F.lit(kind), *ends, *([F.col("l_linenumber").cast("string")] if confidence is not None else []))
        return df.select(key.alias("id"), ends[0].alias("src"), ends[1].alias("dst"), F.lit(kind).alias("type"), (F.lit(1.0) if confidence is None else confidence).alias("confidence"))

    links = edges(t["nation"], "IN_REGION", "nation", "n_nationkey", "region", "n_regionkey")
    links = links.union(edges(t["customer"], "IN_NATION", "customer", "c_custkey", "nation", "c_nationkey"))
    links = links.union(edges(t["supplier"], "IN_NATION", "supplier", "s_suppkey", "nation", "s_nationkey"))
    links = links.union(edges(t["orders"], "PLACED_BY", "order", "o_orderkey", "customer", "o_custkey"))
    links = links.union(edges(t["lineitem"], "CONTAINS", "order", "l_orderkey", "part", "l_partkey", 1 - F.col("l_discount")))
    held = None
    if hyper:
        member = lambda p, c: F.concat(F.lit(f"{p}:"), F.col(c).cast("string"))
        held = t["lineitem"].select(
            F.concat_ws("|", F.lit("supplied"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
            F.array(member("order", "l_orderkey"), member("part", "l_partkey"), member("supplier", "l_suppkey")).alias("nodes"),
            F.lit("SUPPLIED").alias("type"), F.lit(1.0).alias("confidence"),
        )
    return Graph(nodes, links, held)


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as feedback: reward in [-1, 1], state, action."""
    e = table(spark, sf_dir, "events")
    action = F.concat(F.lit("a"), F.coalesce(F.get_json_object("props", "$.k").cast("int") % 5, F.lit(0)).cast("string"))
    return e.select(F.col("event_id").alias("ord"), F.col("user_id").alias("id"), F.col("event_type").alias("state"), action.alias("action"), (F.col("value") / 50 - 1).alias("raw")).withColumn("reward", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("raw")))).drop("raw")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a write log: one generation an event, keyed by user; purchases are deletes."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("generation"), F.col("user_id").alias("id"), F.when(F.col("event_type") == "purchase", "delete").otherwise("upsert").alias("op"), F.col("event_type").alias("payload"), "value")
