"""Registry of the engine's own queries over the driver's tables, each with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions import filters, lexical
from engram.functions.embedding import ngram_embed
from engram.operators import lifecycle, memory
from engram.operators.graph import similar
from engram.operators.search import Search, batch_above, batch_knn, knn, search
from engram.plans import cypher
from engram.session import table
from engram.sources import fixtures

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

TEXT = "thst erea onwh reati of the queque"
REC = f"""rec AS (SELECT doc_id AS id, embedding::DOUBLE[] AS vector, text, lang AS kind, source, [source, lang] AS tags,
    {fixtures.BASE_MS} + doc_id * {fixtures.HOUR_MS} AS created_ms, (1 << (doc_id % 4)::INT)::BIGINT AS req_caps, doc_id % 50 = 0 AS pinned
    FROM documents JOIN embeddings ON doc_id = vec_id), q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0)"""


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        key = name or f.__name__
        _QUERIES[key] = f
        if sql is not None:
            _SQL[key] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _r6(c):
    return F.round(c, 6)


# vectors

_DISTANCE = {
    "cosine": "greatest(0, 1 - list_dot_product(embedding::DOUBLE[], v))",
    "euclidean": "list_distance(embedding::DOUBLE[], v)",
    "dotProduct": "-list_dot_product(embedding::DOUBLE[], v)",
    "manhattan": "list_sum(list_transform(range(1, 65), lambda i: abs((embedding::DOUBLE[])[i] - v[i])))",
}


def _knn(metric: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
        return knn(rows, fixtures.query_vector(spark, sf_dir), 10, metric).select("id", _r6("distance").alias("distance"), _r6("similarity").alias("similarity"))

    return run


for _n, (_metric, _d) in enumerate(_DISTANCE.items(), 1):
    _sim = {"cosine": "1 - d", "dotProduct": "-d"}.get(_metric, "1 / (1 + d)")
    query(f"WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0), n AS (SELECT vec_id AS id, {_d} AS d FROM embeddings, q) SELECT id, round(d, 6) AS distance, round({_sim}, 6) AS similarity FROM n ORDER BY d, id LIMIT 10", f"v{_n}_knn_{_metric.lower()}")(_knn(_metric))


@query("""WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS id, greatest(0, 1 - list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS d
    FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM p)
    SELECT query_id, id, round(d, 6) AS distance, rank::INT AS rank FROM r WHERE rank <= 10""")
def v5_batch_knn(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
    return batch_knn(rows, asked, 10).select("query_id", "id", _r6("distance").alias("distance"), "rank")


@query(f"WITH {REC} SELECT id, kind, round(1 - list_dot_product(vector, v), 6) AS distance FROM rec, q WHERE kind = 'en' AND list_contains(tags, 'src1') ORDER BY greatest(0, 1 - list_dot_product(vector, v)), id LIMIT 10")
def v6_filtered_knn(spark, sf_dir):
    s = Search(fixtures.query_vector(spark, sf_dir), where={"kind": "en", "tags": {"$contains": "src1"}})
    return search(fixtures.records(spark, sf_dir), s).select("id", "kind", _r6("distance").alias("distance"))


@query(f"WITH {REC} SELECT id, req_caps, round(greatest(0, 1 - list_dot_product(vector, v)), 6) AS distance FROM rec, q WHERE (req_caps & 6) = req_caps ORDER BY 3, id LIMIT 10")
def v7_capability_gate(spark, sf_dir):
    s = Search(fixtures.query_vector(spark, sf_dir), capabilities=6, gate="req_caps")
    return search(fixtures.records(spark, sf_dir), s).select("id", "req_caps", _r6("distance").alias("distance"))


@query("""SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a, embeddings b
    WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.4""")
def v8_similar_above(spark, sf_dir):
    """All rows at least 0.4 similar to a query row; queries are blocks of vectors, so no pair table is formed."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
    return batch_above(rows, asked, 0.4).where("id <> query_id").select("query_id", "id", _r6("similarity").alias("similarity"))


# filters

_FILTERS = {
    "f01_bare_equality": ({"event_type": "click"}, "event_type = 'click'"),
    "f02_any_element": ({"tags": "click"}, "list_contains(tags, 'click')"),
    "f03_exists": ({"k": {"$exists": True}}, "k IS NOT NULL"),
    "f04_eq_ne": ({"event_type": {"$ne": "view"}, "user_id": {"$eq": 7}}, "event_type <> 'view' AND user_id = 7"),
    "f05_in": ({"event_type": {"$in": ["view", "error"]}, "user_id": {"$lt": 9}}, "event_type IN ('view', 'error') AND user_id < 9"),
    "f06_nin_missing": ({"nothing": {"$nin": [1]}, "event_type": {"$nin": ["view", "click", "error"]}}, "event_type NOT IN ('view', 'click', 'error')"),
    "f07_range": ({"value": {"$gt": 10, "$lte": 12.5}}, "value > 10 AND value <= 12.5"),
    "f08_range_text": ({"event_type": {"$gte": "error", "$lt": "signup"}}, "event_type >= 'error' AND event_type < 'signup'"),
    "f09_prefix": ({"event_type": {"$prefix": "pur"}}, "starts_with(event_type, 'pur')"),
    "f10_contains": ({"tags": {"$contains": "even"}}, "list_contains(tags, 'even')"),
    "f11_all": ({"tags": {"$all": ["error", "odd"]}}, "list_contains(tags, 'error') AND list_contains(tags, 'odd')"),
    "f12_wrong_type": ({"value": {"$gt": "a"}, "event_type": {"$ne": 3}}, "false"),
}


def _filtered(where: dict) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = table(spark, sf_dir, "events")
        e = e.withColumn("k", F.get_json_object("props", "$.k").cast("int")).withColumn("tags", F.array("event_type", F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd")))
        return e.where(filters.compile_filter(where, e.schema)).select("event_id", "user_id", "event_type", "value")

    return run


for _name, (_where, _sql) in _FILTERS.items():
    query(f"WITH e AS (SELECT *, (props->>'$.k')::INT AS k, [event_type, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END] AS tags FROM events) SELECT event_id, user_id, event_type, value FROM e WHERE {_sql}", _name)(_filtered(_where))

# words

_STOP = "[" + ", ".join(f"'{w}'" for w in lexical.STOP_WORDS) + "]"
_TOKENS = f"""list_transform(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_.\\-/:@]+'), lambda t: regexp_replace(t, '^[._\\-/:@]+|[._\\-/:@]+$', '', 'g'))"""
_WORDS = f"""flatten(list_transform(list_filter({_TOKENS}, lambda t: t <> '' AND NOT list_contains({_STOP}, t)),
    lambda t: CASE WHEN regexp_matches(t, '[._\\-/:@]+') THEN list_concat([t], list_filter(string_split_regex(t, '[._\\-/:@]+'), lambda p: length(p) > 1 AND NOT list_contains({_STOP}, p))) ELSE [t] END))"""


def bm25_sql(source: str, allowed: str = "true", text: str = TEXT) -> str:
    """CTEs that end in bm(id, score) over ``source`` (id, text and what ``allowed`` names)."""
    return f"""tk AS (SELECT *, {_WORDS} AS toks FROM {source} WHERE text IS NOT NULL AND text <> ''),
    st AS (SELECT count(*)::DOUBLE AS n, avg(len(toks))::DOUBLE AS avgdl FROM tk),
    qt AS (SELECT DISTINCT unnest({_WORDS}) AS term FROM (SELECT '{text}' AS text)),
    tf AS (SELECT id, len(toks)::DOUBLE AS dl, ({allowed}) AS ok, term, count(*)::DOUBLE AS tf FROM (SELECT *, unnest(toks) AS term FROM tk) JOIN qt USING (term) GROUP BY ALL),
    df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term),
    bm AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN df USING (term), st WHERE ok GROUP BY id)"""


@query(f"WITH d AS (SELECT lang, {_WORDS} AS toks FROM documents WHERE text IS NOT NULL AND text <> '') SELECT lang, sum(len(toks))::BIGINT AS tokens, sum(len(list_distinct(toks)))::BIGINT AS distinct_tokens FROM d GROUP BY lang")
def l1_tokenizer(spark, sf_dir):
    d = lexical.tokenized(table(spark, sf_dir, "documents"))
    return d.groupBy("lang").agg(F.sum(F.size("tokens")).alias("tokens"), F.sum(F.size(F.array_distinct("tokens"))).alias("distinct_tokens"))


@query(f"WITH d AS (SELECT doc_id AS id, * FROM documents), {bm25_sql('d')} SELECT id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, id LIMIT 20")
def l2_bm25(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id")
    return lexical.bm25(d, TEXT, 20).select("id", _r6("score").alias("score"))


@query(f"WITH d AS (SELECT doc_id AS id, * FROM documents), {bm25_sql('d', 'lang = $$fr$$')} SELECT id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, id LIMIT 20")
def l3_bm25_filtered(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id")
    return lexical.bm25(d, TEXT, 20, F.col("lang") == "fr").select("id", _r6("score").alias("score"))


# hybrid search


def hybrid_sql(where: str = "true", decay: str = "1.0", method: str = "rrf", alpha: float = 0.5, k: int = 10, fetch: int = 40) -> str:
    a, b = alpha, 1 - alpha
    fused = f"coalesce(({a} * 61 / {a + b}) / (61 + dr), 0) + coalesce(({b} * 61 / {a + b}) / (61 + lr), 0)"
    if method == "rsf":
        scaled = lambda c: f"coalesce(({c} - min({c}) OVER ()) / CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 1 ELSE max({c}) OVER () - min({c}) OVER () END, 0)"
        fused = f"{a} * {scaled('final')} + {b} * {scaled('score')}"
    return f"""WITH {REC}, dist AS (SELECT rec.*, greatest(0, 1 - list_dot_product(vector, v)) AS distance FROM rec, q),
    dense AS (SELECT * FROM dist WHERE {where} ORDER BY distance, id LIMIT {fetch}), {bm25_sql('rec', where)},
    lex AS (SELECT id, score FROM bm ORDER BY score DESC, id LIMIT {fetch}),
    items AS (SELECT id, distance, (1 - distance) * ({decay}) AS final FROM dense UNION ALL SELECT id, distance, 1 - distance FROM dist JOIN lex USING (id) WHERE id NOT IN (SELECT id FROM dense)),
    ranked AS (SELECT i.*, score, row_number() OVER (ORDER BY final DESC, id) - 1 AS dr, CASE WHEN score IS NOT NULL THEN row_number() OVER (ORDER BY score DESC NULLS LAST, id) - 1 END AS lr FROM items i LEFT JOIN lex USING (id)),
    fused AS (SELECT id, distance, dr, lr, {fused} AS f FROM ranked)
    SELECT id, round(f, 6) AS final, dr::INT AS dense_rank, lr::INT AS lexical_rank, row_number() OVER (ORDER BY f DESC, distance, id)::INT AS rank FROM fused ORDER BY f DESC, distance, id LIMIT {k}"""


def _hybrid(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    s = Search(fixtures.query_vector(spark, sf_dir), lexical=TEXT, **options)
    return search(fixtures.records(spark, sf_dir), s).select("id", _r6("final").alias("final"), "dense_rank", "lexical_rank", "rank")


_DECAY_SQL = f"exp(-(ln(2) / 30) * greatest(0, ({fixtures.NOW_MS} - created_ms) / 86400000.0))"
_DECAY = {"half_life_days": 30, "now_ms": fixtures.NOW_MS}


@query(hybrid_sql())
def h1_hybrid_rrf(spark, sf_dir):
    return _hybrid(spark, sf_dir)


@query(hybrid_sql(method="rsf", alpha=0.3))
def h2_hybrid_rsf(spark, sf_dir):
    return _hybrid(spark, sf_dir, method="rsf", alpha=0.3)


@query(hybrid_sql(decay=_DECAY_SQL, where="kind = 'en'"))
def h3_hybrid_decay(spark, sf_dir):
    return _hybrid(spark, sf_dir, decay=_DECAY, where={"kind": "en"})


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h3_hybrid_decay(spark, sf_dir)


# re-ranking


@query(f"""WITH {REC}, d AS (SELECT rec.*, greatest(0, 1 - list_dot_product(vector, v)) AS distance FROM rec, q ORDER BY distance, id LIMIT 40), f AS (SELECT id, distance, {_DECAY_SQL} AS w FROM d)
    SELECT id, round(1 - distance, 6) AS similarity, round(w, 6) AS decay, round((1 - distance) * w, 6) AS final FROM f ORDER BY (1 - distance) * w DESC, distance, id LIMIT 10""")
def r1_decay(spark, sf_dir):
    out = search(fixtures.records(spark, sf_dir), Search(fixtures.query_vector(spark, sf_dir), decay=_DECAY))
    return out.select("id", _r6("similarity").alias("similarity"), _r6("decay").alias("decay"), _r6("final").alias("final"))


@query(f"""WITH {REC}, c AS (SELECT rec.*, greatest(0, 1 - list_dot_product(vector, v)) AS distance FROM rec, q ORDER BY distance, id LIMIT 40),
    s AS (SELECT a.id, avg(CASE WHEN list_dot_product(a.vector, b.vector) >= 0.1 THEN 1.0 ELSE 0.0 END) AS coh FROM c a, c b WHERE a.id <> b.id GROUP BY a.id)
    SELECT id, round(coh, 6) AS coherence, round((1 - distance) * (1 + 0.5 * coh), 6) AS final FROM c JOIN s USING (id) ORDER BY (1 - distance) * (1 + 0.5 * coh) DESC, distance, id LIMIT 10""")
def r2_coherence(spark, sf_dir):
    out = search(fixtures.records(spark, sf_dir), Search(fixtures.query_vector(spark, sf_dir), coherence={"weight": 0.5, "threshold": 0.1}))
    return out.select("id", _r6("coherence").alias("coherence"), _r6("final").alias("final"))


@query()
def r3_mmr(spark, sf_dir):
    out = search(fixtures.records(spark, sf_dir), Search(fixtures.query_vector(spark, sf_dir), diversity=0.5))
    return out.select("rank", "id", _r6("final").alias("final"))


@query(f"""WITH {REC}, d AS (SELECT rec.*, greatest(0, 1 - list_dot_product(vector, v)) AS distance FROM rec, q)
    SELECT id, round(distance, 6) AS distance, round(1 - distance, 6) AS similarity, row_number() OVER (ORDER BY distance, id)::INT AS rank FROM d ORDER BY d.distance, id LIMIT 10""")
def r4_explain(spark, sf_dir):
    out = search(fixtures.records(spark, sf_dir), Search(fixtures.query_vector(spark, sf_dir)))
    return out.select("id", _r6("distance").alias("distance"), _r6("similarity").alias("similarity"), "rank")


# graph

EDGES = """links AS (SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst, 'IN_REGION' AS type, 1.0::DOUBLE AS confidence FROM nation
    UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'IN_NATION', 1.0 FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'IN_NATION', 1.0 FROM supplier
    UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'PLACED_BY', 1.0 FROM orders UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'CONTAINS', 1 - l_discount FROM lineitem)"""


@query(f"""WITH RECURSIVE {EDGES}, both_ways AS (SELECT src AS here, dst AS there FROM links UNION SELECT dst, src FROM links),
    walk AS (SELECT 'region:0' AS id, 0 AS h UNION SELECT there, h + 1 FROM walk JOIN both_ways ON here = id WHERE h < 3)
    SELECT id, min(h)::INT AS hops FROM walk GROUP BY id HAVING min(h) > 0""")
def g1_k_hop(spark, sf_dir):
    start = spark.createDataFrame([("region:0",)], "id string")
    return fixtures.graph(spark, sf_dir).k_hop(start, 3).select("id", "hops")


@query(f"""WITH {EDGES}, n(label, n) AS (SELECT 'Region', count(*) FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier
    UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'Part', count(*) FROM part)
    SELECT 'label' AS kind, label AS name, n::DOUBLE AS n FROM n UNION ALL SELECT 'label', 'Party', sum(n) FROM n WHERE label IN ('Customer', 'Supplier') UNION ALL SELECT 'type', type, count(*) FROM links GROUP BY type
    UNION ALL SELECT 'count', 'nodes', sum(n) FROM n UNION ALL SELECT 'count', 'edges', count(*) FROM links UNION ALL SELECT 'mean', 'degree', round(2.0 * (SELECT count(*) FROM links) / sum(n), 6) FROM n""")
def g2_stats(spark, sf_dir):
    return fixtures.graph(spark, sf_dir).stats().select("kind", "name", _r6("n").alias("n"))


@query("""SELECT DISTINCT id, 1 AS hops FROM (SELECT unnest(['order:' || l_orderkey, 'part:' || l_partkey, 'supplier:' || l_suppkey]) AS id FROM lineitem WHERE l_suppkey = 1) WHERE id <> 'supplier:1'""")
def g3_hyperedge_hop(spark, sf_dir):
    start = spark.createDataFrame([("supplier:1",)], "id string")
    return fixtures.graph(spark, sf_dir, hyper=True).k_hop(start, 1, types=["SUPPLIED"]).select("id", "hops")


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0) SELECT vec_id AS id, label, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS similarity
    FROM embeddings, q WHERE label IN (1, 3) ORDER BY list_cosine_similarity(embedding::DOUBLE[], v) DESC, id LIMIT 10""")
def g4_node_similarity(spark, sf_dir):
    nodes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
    return similar(nodes, fixtures.query_vector(spark, sf_dir), 10, F.col("label").isin(1, 3)).select("id", "label", _r6("similarity").alias("similarity"))


@query(f"""WITH {EDGES}, gone AS (SELECT 'supplier:' || s_suppkey AS id FROM supplier WHERE s_suppkey % 2 = 0)
    SELECT (SELECT count(*) FROM links WHERE src NOT IN (FROM gone) AND dst NOT IN (FROM gone)) AS edges, (SELECT count(*) FROM lineitem WHERE l_suppkey % 2 <> 0) AS hyperedges""")
def g5_delete_cascade(spark, sf_dir):
    gone = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("id"))
    left = fixtures.graph(spark, sf_dir, hyper=True).delete_nodes(gone)
    return left.edges.agg(F.count("*").alias("edges")).crossJoin(left.hyperedges.agg(F.count("*").alias("hyperedges")))


# pattern queries

_CYPHER = {
    "c01_nodes": ("MATCH (n:Nation) RETURN n.name AS name", "SELECT n_name AS name FROM nation"),
    "c02_where_order_limit": ("MATCH (c:Customer) WHERE c.balance > 9000 RETURN c.id AS id, c.balance AS balance ORDER BY c.balance DESC, id LIMIT 20", "SELECT 'customer:' || c_custkey AS id, c_acctbal AS balance FROM customer WHERE c_acctbal > 9000 ORDER BY balance DESC, id LIMIT 20"),
    "c03_chain_props": ("MATCH (c:Customer)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region {name:'ASIA'}) RETURN n.name AS nation, count(*) AS n", "SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name"),
    "c04_incoming": ("MATCH (r:Region)<-[:IN_REGION]-(n:Nation) RETURN r.name AS region, count(n) AS nations", "SELECT r_name AS region, count(*) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name"),
    "c05_undirected": ("MATCH (r:Region)-[:IN_REGION]-(x) RETURN r.name AS region, x.name AS other", "SELECT r_name AS region, n_name AS other FROM region JOIN nation ON n_regionkey = r_regionkey"),
    "c06_comma_product": ("MATCH (a:Region), (b:Region) WHERE a.name < b.name RETURN a.name AS a, b.name AS b", "SELECT a.r_name AS a, b.r_name AS b FROM region a, region b WHERE a.r_name < b.r_name"),
    "c07_second_match": ("MATCH (c:Customer)-[:IN_NATION]->(n) MATCH (s:Supplier)-[:IN_NATION]->(n) RETURN n.name AS nation, count(*) AS pairs", "SELECT n_name AS nation, count(*) AS pairs FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name"),
    "c08_logic": ("MATCH (p:Part) WHERE (p.size < 3 OR p.size > 48) AND NOT p.type CONTAINS 'STEEL' AND NOT p.missing RETURN id(p) AS id, p.size AS size", "SELECT 'part:' || p_partkey AS id, p_size AS size FROM part WHERE (p_size < 3 OR p_size > 48) AND NOT contains(p_type, 'STEEL')"),
    "c09_in_list": ("MATCH (n:Nation) WHERE n.name IN ['JAPAN', 'CHINA', 'NATION_3'] OR n.id IN ['nation:1', 'nation:2'] RETURN n.name AS name", "SELECT n_name AS name FROM nation WHERE n_name IN ('JAPAN', 'CHINA', 'NATION_3') OR n_nationkey IN (1, 2)"),
    "c10_starts_ends": ("MATCH (p:Part) WHERE p.name STARTS WITH 'red' AND p.name ENDS WITH 'ring' RETURN count(*) AS n", "SELECT count(*) AS n FROM part WHERE starts_with(p_name, 'red') AND ends_with(p_name, 'ring')"),
    "c11_null_tests": ("MATCH (n:Party) WHERE n.segment IS NULL AND n.balance IS NOT NULL RETURN count(*) AS n", "SELECT count(*) AS n FROM supplier WHERE s_acctbal IS NOT NULL"),
    "c12_string_functions": ("MATCH (r:Region) RETURN toLower(r.name) AS low, toUpper(r.name) AS up, size(r.name) AS len, r.name + '!' AS loud", "SELECT lower(r_name) AS low, upper(r_name) AS up, length(r_name)::BIGINT AS len, r_name || '!' AS loud FROM region"),
    "c13_arithmetic": ("MATCH (c:Customer) WHERE c.balance / 2 > 4900 RETURN id(c) AS id, c.balance * 2 + 1 AS x, -c.balance AS y", "SELECT 'customer:' || c_custkey AS id, c_acctbal * 2 + 1 AS x, -c_acctbal AS y FROM customer WHERE c_acctbal / 2 > 4900"),
    "c14_aggregates": ("MATCH (o:Order)-[:PLACED_BY]->(c:Customer) RETURN c.segment AS segment, count(*) AS n, round(sum(o.total)) AS total, round(avg(o.total)) AS mean, min(o.total) AS low, max(o.total) AS high", "SELECT c_mktsegment AS segment, count(*) AS n, floor(sum(o_totalprice) + 0.5) AS total, floor(avg(o_totalprice) + 0.5) AS mean, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment"),
    "c15_of_aggregates": ("MATCH (p:Part) RETURN p.type AS type, count(*) + 1 AS more, max(p.size) - min(p.size) AS spread", "SELECT p_type AS type, count(*) + 1 AS more, (max(p_size) - min(p_size))::BIGINT AS spread FROM part GROUP BY p_type"),
    "c16_null_order_skip": ("MATCH (n:Party) RETURN id(n) AS id, n.segment AS segment ORDER BY segment DESC, id SKIP 5 LIMIT 120", "SELECT id, segment FROM (SELECT 'customer:' || c_custkey AS id, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, NULL FROM supplier) ORDER BY segment DESC NULLS FIRST, id LIMIT 120 OFFSET 5"),
    "c17_distinct": ("MATCH (c:Customer) RETURN DISTINCT c.segment AS segment ORDER BY segment", "SELECT DISTINCT c_mktsegment AS segment FROM customer"),
    "c18_collect": ("MATCH (n:Nation)-[:IN_REGION]->(r) RETURN r.name AS region, size(collect(n.name)) AS n", "SELECT r_name AS region, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"),
    "c19_edge_property": ("MATCH (o:Order)-[r:CONTAINS]->(p:Part) WHERE r.confidence < 0.905 RETURN type(r) AS type, p.type AS kind, count(*) AS n", "SELECT 'CONTAINS' AS type, p_type AS kind, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey WHERE 1 - l_discount < 0.905 GROUP BY p_type"),
    "c20_id_seed": ("MATCH (o:Order)-[:PLACED_BY]->(c)-[:IN_NATION]->(n) WHERE o.id = 'order:1' RETURN c.name AS customer, n.name AS nation", "SELECT c_name AS customer, n_name AS nation FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderkey = 1"),
    "c21_empty_global": ("MATCH (n:Nothing) RETURN count(*) AS n, sum(n.balance) AS s, min(n.size) AS m", "SELECT 0::BIGINT AS n, 0::DOUBLE AS s, NULL::INT AS m"),
    "c22_functions": ("MATCH (n:Nation) RETURN coalesce(n.segment, n.name) AS c, toInteger('12') AS i, toFloat('1.5') AS f, toString(7) AS s, abs(-2) AS a, size(keys(n)) AS k, size(labels(n)) AS l, round(2.5) AS r", "SELECT n_name AS c, 12::BIGINT AS i, 1.5::DOUBLE AS f, '7' AS s, 2::BIGINT AS a, 1::BIGINT AS k, 1::BIGINT AS l, 3::DOUBLE AS r FROM nation"),
    "c23_edge_reuse": ("MATCH (a:Nation)-[x:IN_REGION]->(r)<-[y:IN_REGION]-(b:Nation) RETURN r.name AS region, count(*) AS n", "SELECT r_name AS region, count(*) AS n FROM region JOIN nation a ON a.n_regionkey = r_regionkey JOIN nation b ON b.n_regionkey = r_regionkey WHERE a.n_nationkey <> b.n_nationkey GROUP BY r_name"),
    "c24_types": ("MATCH (s:Supplier)-[e:IN_NATION|IN_REGION]->(x) WHERE s.balance <> 0 AND e.type = 'IN_NATION' RETURN x.name AS name, avg(s.size) AS none, count(s.segment) AS zero", "SELECT n_name AS name, NULL::DOUBLE AS none, 0::BIGINT AS zero FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal <> 0 GROUP BY n_name"),
}


def _cypher(source: str) -> Query:
    return lambda spark, sf_dir: cypher.query(fixtures.graph(spark, sf_dir), source, max_rows=2_000_000_000)


for _name, (_source, _sql) in _CYPHER.items():
    query(_sql, _name)(_cypher(_source))

# memory


@query(hybrid_sql(where="kind IN ('en', 'fr') AND list_contains(tags, 'src0') AND created_ms >= " + str(fixtures.BASE_MS), decay=_DECAY_SQL, alpha=0.6))
def m1_recall(spark, sf_dir):
    hits = memory.recall(fixtures.records(spark, sf_dir), fixtures.query_vector(spark, sf_dir), fixtures.NOW_MS, TEXT, kinds=["EN", "fr"], tags=["src0"], since_ms=fixtures.BASE_MS, half_life_days=30)
    return hits.select("id", _r6("final").alias("final"), "dense_rank", "lexical_rank", "rank")


_VERSIONS = """v AS (SELECT o_orderkey AS id, o_custkey AS key, epoch_ms(o_orderdate) AS valid_from, coalesce(lead(epoch_ms(o_orderdate)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 8640000000000000) AS valid_to FROM orders)"""


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"), fixtures.millis("o_orderdate").alias("at_ms"))
    return memory.supersede(o, "key", "at_ms", ["id"])


@query(f"WITH {_VERSIONS} SELECT id, key, valid_from, valid_to FROM v WHERE valid_from <= 852076800000 AND valid_to > 852076800000")
def m2_as_of(spark, sf_dir):
    return memory.as_of(_versions(spark, sf_dir), 852_076_800_000).select("id", "key", "valid_from", "valid_to")


@query(f"WITH {_VERSIONS} SELECT id, valid_from, valid_to, valid_to < 8640000000000000 AS superseded FROM v")
def m3_supersede(spark, sf_dir):
    return _versions(spark, sf_dir).select("id", "valid_from", "valid_to", "superseded")


@query("""WITH p AS (SELECT a.vec_id AS id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 10 = 0 AND b.vec_id % 10 <> 0),
    r AS (SELECT id, s, row_number() OVER (PARTITION BY id ORDER BY s DESC) AS n FROM p), t AS (SELECT id, greatest(0, least(1, 1 - max(s))) AS novelty, count(*) FILTER (s >= 0.8) AS "similar" FROM r WHERE n <= 5 GROUP BY id)
    SELECT id, round(novelty, 6) AS novelty, round(0.5 * novelty + 0.25, 6) AS importance, "similar" FROM t""")
def m4_novelty(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return memory.novelty(rows.where("id % 10 <> 0"), rows.where("id % 10 = 0")).select("id", _r6("novelty").alias("novelty"), _r6("importance").alias("importance"), "similar")


@query(f"""WITH RECURSIVE {REC}, hits AS (SELECT id, ceil(length(text) / 4)::INT AS tokens, row_number() OVER (ORDER BY greatest(0, 1 - list_dot_product(vector, v)), id) AS rank FROM rec, q QUALIFY rank <= 30),
    walk AS (SELECT 0 AS rank, 0::BIGINT AS used, 0 AS n, NULL::BIGINT AS id, NULL::INT AS tokens UNION ALL
    SELECT h.rank, CASE WHEN used + h.tokens <= 4000 AND n < 10 THEN used + h.tokens ELSE used END, CASE WHEN used + h.tokens <= 4000 AND n < 10 THEN n + 1 ELSE n END, CASE WHEN used + h.tokens <= 4000 AND n < 10 THEN h.id END, h.tokens FROM walk w JOIN hits h ON h.rank = w.rank + 1)
    SELECT id, tokens, rank::INT AS rank FROM walk WHERE id IS NOT NULL""")
def m5_token_budget(spark, sf_dir):
    hits = search(fixtures.records(spark, sf_dir), Search(fixtures.query_vector(spark, sf_dir), 30))
    return memory.pack_budget(hits.withColumn("tokens", memory.approx_tokens(F.col("text"))), 4000, 10).select("id", "tokens", "rank")


@query(f"WITH {REC} SELECT kind, count(*) AS n, sum(ceil(length(text) / 4))::BIGINT AS tokens, min(created_ms) AS first_ms FROM rec GROUP BY kind")
def m6_kind_stats(spark, sf_dir):
    return fixtures.records(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.sum(memory.approx_tokens(F.col("text"))).alias("tokens"), F.min("created_ms").alias("first_ms"))


@query("SELECT event_type AS skill, count(*) AS usage_count, sum((value > 50)::INT)::BIGINT AS successes, round(avg((value > 50)::INT), 6) AS success_rate FROM events GROUP BY event_type")
def m7_skill_counters(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("skill"), (F.col("value") > 50).alias("success"))
    return memory.skill_counters(e).withColumn("success_rate", _r6("success_rate"))


# sessions


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS place FROM conversations")
def s1_session_turns(spark, sf_dir):
    return memory.ordered_turns(table(spark, sf_dir, "conversations"), "conv_id").select("conv_id", "turn", "role", "place")


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2")
def s2_last_turns(spark, sf_dir):
    return memory.ordered_turns(table(spark, sf_dir, "conversations"), "conv_id", last=2).select("conv_id", "turn", "role")


@query("""WITH a AS (SELECT user_id AS key, (epoch_us(ts) // 1000) AS at_ms FROM events), g AS (SELECT *, lag(at_ms) OVER (PARTITION BY key ORDER BY at_ms) AS p FROM a),
    n AS (SELECT *, sum(CASE WHEN p IS NULL OR at_ms - p > 14400000 THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY at_ms) AS session FROM g)
    SELECT key, session::BIGINT AS session, min(at_ms) AS started_ms, max(at_ms) AS last_ms, count(*) AS n_turns, max(at_ms) + 14400000 AS expires_ms FROM n GROUP BY key, session""")
def s3_sliding_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), fixtures.millis("ts").alias("at_ms"))
    return memory.sliding_sessions(e, "key", "at_ms")


# learning

OUTCOMES = "o AS (SELECT event_id AS ord, user_id AS id, event_type AS state, 'a' || coalesce((props->>'$.k')::INT % 5, 0) AS action, greatest(-1, least(1, value / 50 - 1)) AS reward FROM events)"


@query(f"WITH {OUTCOMES} SELECT id, round(sum(CASE WHEN state IN ('click', 'purchase') THEN reward WHEN reward > 0 THEN -0.25 * reward ELSE 0 END), 6) AS feedback FROM o GROUP BY id")
def n1_feedback(spark, sf_dir):
    o = fixtures.outcomes(spark, sf_dir).withColumn("chosen", F.col("state").isin("click", "purchase"))
    return memory.feedback(o).withColumn("feedback", _r6("feedback"))


_ROUTING = f"""{OUTCOMES}, s AS (SELECT *, row_number() OVER (PARTITION BY state, action ORDER BY ord) AS seq FROM o),
    fold AS (SELECT state, action, seq, reward AS value FROM s WHERE seq = 1 UNION ALL SELECT s.state, s.action, s.seq, f.value + (s.reward - f.value) / least(s.seq, 20) FROM fold f JOIN s ON s.state = f.state AND s.action = f.action AND s.seq = f.seq + 1),
    ends AS (SELECT state, action, max(seq) AS n, max_by(value, seq) AS value FROM fold GROUP BY state, action)"""


@query(f"WITH RECURSIVE {_ROUTING} SELECT state, action, round(value, 6) AS value, n FROM ends")
def n2_routing(spark, sf_dir):
    return memory.routing(fixtures.outcomes(spark, sf_dir)).select("state", "action", _r6("value").alias("value"), "n")


@query(f"WITH RECURSIVE {_ROUTING} SELECT state, action FROM ends QUALIFY row_number() OVER (PARTITION BY state ORDER BY round(value, 9) DESC, action) = 1")
def n3_recommend(spark, sf_dir):
    routed = memory.routing(fixtures.outcomes(spark, sf_dir)).withColumn("value", F.round("value", 9))
    return memory.recommend(routed)


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0), near AS (SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], v) AS s, (label + 1) / 10.0 AS confidence FROM embeddings, q ORDER BY s DESC, id LIMIT 40)
    SELECT id, round(s * confidence, 6) AS score FROM near ORDER BY s * confidence DESC, id LIMIT 10""")
def n4_causal_rank(spark, sf_dir):
    h = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", ((F.col("label") + 1) / 10).alias("confidence"))
    return memory.causal_rank(h, fixtures.query_vector(spark, sf_dir), 10).select("id", _r6("score").alias("score"))


@query("""WITH RECURSIVE s AS (SELECT user_id AS id, (value > 50)::INT AS hit, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events),
    fold AS (SELECT id, seq, (0.5 + 0.2 * (hit - 0.5))::DOUBLE AS c FROM s WHERE seq = 1 UNION ALL SELECT s.id, s.seq, f.c + 0.2 * (s.hit - f.c) FROM fold f JOIN s ON s.id = f.id AND s.seq = f.seq + 1)
    SELECT id, round(max_by(c, seq), 6) AS confidence FROM fold GROUP BY id""")
def n5_causal_confidence(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("ord"), (F.col("value") > 50).cast("int").alias("confirmed"))
    return memory.folded_confidence(e).withColumn("confidence", _r6("confidence"))


# lifecycle

_ACCESS = f"""{REC}, acc AS (SELECT user_id AS id, max((epoch_us(ts) // 1000)) AS last_ms, count(*) AS count, sum(value) / 10000 AS feedback FROM events GROUP BY user_id),
    r AS (SELECT rec.*, last_ms, count, feedback, NULL::DOUBLE AS importance FROM rec LEFT JOIN acc USING (id)), total AS (SELECT count(*) AS n FROM r)"""
_SCORES = {
    "lru": f"coalesce(last_ms, created_ms, 0)::DOUBLE / {fixtures.NOW_MS}::DOUBLE",
    "lfu": "coalesce(count, 0)::DOUBLE",
    "coherence": f"""0.25 * exp(-(greatest(0, {fixtures.NOW_MS} - coalesce(last_ms, created_ms, 0)) / 86400000.0) / 30) + 0.35 * (1 - 1 / (1 + coalesce(count, 0)::DOUBLE)) + 0.4 * greatest(0, least(1, 1 - greatest(0, 1 - list_dot_product(vector, v))))
        + 0.2 * coalesce(importance, 0.5) + 0.2 * tanh(coalesce(feedback, 0) / 4)""",
}


def _compaction(policy: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = table(spark, sf_dir, "events")
        access = e.groupBy(F.col("user_id").alias("id")).agg(F.max(fixtures.millis("ts")).alias("last_ms"), F.count("*").alias("count"), (F.sum("value") / 10_000).alias("feedback"))
        rows = fixtures.records(spark, sf_dir).join(access, "id", "left").withColumn("importance", F.lit(None).cast("double"))
        recent = [fixtures.query_vector(spark, sf_dir)] if policy == "coherence" else []
        score = lifecycle.policy_score(policy, fixtures.NOW_MS, recent=recent)
        gone = lifecycle.evictions(rows, rows.count() // 2, score, 3)
        return gone.select("id", _r6("score").alias("score"), "cluster")

    return run


for _n, (_policy, _s) in enumerate(_SCORES.items(), 1):
    query(f"""WITH {_ACCESS}, s AS (SELECT id, {_s} AS score, coalesce(kind, '') || '|' || coalesce(tags[1], '') AS cluster FROM r, q WHERE NOT pinned),
        p AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, id DESC) AS place FROM s), e AS (SELECT *, row_number() OVER (ORDER BY score, id) AS o FROM p WHERE place > 3)
        SELECT id, round(score, 6) AS score, cluster FROM e, total WHERE o <= n - n // 2""", f"k{_n}_compact_{_policy}")(_compaction(_policy))


@query()
def k4_consolidate(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("vec_id").alias("created_ms"), F.lit("").alias("text"), "label", (F.col("vec_id") % 3 > 0).alias("success"))
    return memory.consolidate(rows, ["label"], 0.15).select("label", "leader_id", "medoid_id", "size", "success_rate", "eligible")


def _witness(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return lifecycle.append(e.select(
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("log"), F.col("event_id").alias("ord"), F.col("event_type").alias("operation"), F.col("event_id").cast("string").alias("record_id"),
        fixtures.millis("ts").cast("string").alias("timestamp"), F.lit("driver").alias("actor"), F.col("props").alias("payload"),
    ))


@query("SELECT 'user' || user_id AS log, count(*) AS entries, true AS ok, NULL::BIGINT AS first_break FROM events GROUP BY user_id")
def w1_witness_verify(spark, sf_dir):
    return lifecycle.verify(_witness(spark, sf_dir)).select("log", "entries", "ok", "first_break")


@query("""WITH n AS (SELECT 'user' || user_id AS log, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, event_type FROM events)
    SELECT log, count(*) AS entries, min(seq) FILTER (event_type = 'error' AND log IN ('user3', 'user4')) IS NULL AS ok, min(seq) FILTER (event_type = 'error' AND log IN ('user3', 'user4')) AS first_break FROM n GROUP BY log""")
def w1b_witness_tampered(spark, sf_dir):
    forged = F.when((F.col("operation") == "error") & F.col("log").isin("user3", "user4"), F.lit("forged")).otherwise(F.col("operation"))
    return lifecycle.verify(_witness(spark, sf_dir).withColumn("operation", forged)).select("log", "entries", "ok", "first_break")


@query("SELECT user_id AS id, event_id AS generation, event_type AS payload, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND event_type <> 'purchase'")
def w2_log_replay(spark, sf_dir):
    return lifecycle.replay(fixtures.log(spark, sf_dir)).select("id", "generation", "payload", "value")


def _branch(spark: SparkSession, sf_dir: str) -> lifecycle.Branch:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    return lifecycle.Branch(d, d.where("id % 7 = 0").withColumn("source", F.lit("branch")), d.where("id % 11 = 0 AND id % 7 <> 0").select("id"), 500)


@query("SELECT doc_id AS id, lang, CASE WHEN doc_id % 7 = 0 THEN 'branch' ELSE source END AS source FROM documents WHERE NOT (doc_id % 11 = 0 AND doc_id % 7 <> 0)")
def w3_branch_view(spark, sf_dir):
    return _branch(spark, sf_dir).view()


@query("SELECT doc_id AS id, doc_id AS generation FROM documents WHERE (doc_id % 7 = 0 OR doc_id % 11 = 0) AND doc_id > 500")
def w4_merge_conflicts(spark, sf_dir):
    generations = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("generation"))
    return _branch(spark, sf_dir).conflicts(generations)


@query("SELECT 'documents' AS store, count(*) AS removed FROM documents WHERE doc_id % 13 = 0 UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id % 13 = 0")
def w5_purge(spark, sf_dir):
    d, labels = (table(spark, sf_dir, n).withColumnRenamed("doc_id", "id") for n in ("documents", "labels"))
    return lifecycle.purge(d.where("id % 13 = 0").select("id"), documents=d, labels=labels)[1]


def _field(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR)::VARCHAR || ':' || {column}::VARCHAR, '-')"


@query(f"SELECT count(*) AS rows, coalesce(sum(('0x' || substr(sha256({_field('doc_id')} || ',' || {_field('lang')} || ',' || {_field('source')} || ',' || {_field('text')}), 1, 15))::BIGINT), 0)::VARCHAR AS checksum FROM documents")
def w6_snapshot_checksum(spark, sf_dir):
    return lifecycle.checksum(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))


@query()
def e1_ngram_search(spark, sf_dir):
    """The rows whose hashed n-gram embeddings are nearest to the first document's."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    first = d.where("id = 0").select(ngram_embed(F.col("text")).alias("v")).first()
    return knn(d.select("id", ngram_embed(F.col("text")).alias("vector")), list(first["v"]), 10).select("id", _r6("distance").alias("distance"))

