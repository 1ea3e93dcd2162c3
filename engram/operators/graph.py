"""Property graph over three tables: nodes, directed typed edges, and hyperedges of two or more nodes."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.errors import EngineError, invalid
from engram.functions import vector
from engram.session import materialise

MOST_HOPS = 6


@dataclass
class Graph:
    """nodes(id, labels, props), edges(id, src, dst, type, confidence, props), hyperedges(id, nodes, type, confidence, props).

    ``props`` is a struct of typed properties; nodes may have an ``embedding``. Writes give a new graph; ``subscribers`` are
    told of each committed change.
    """

    nodes: DataFrame
    edges: DataFrame
    hyperedges: DataFrame | None = None
    subscribers: list[Callable[[dict], None]] = field(default_factory=list)

    def _changed(self, **kept) -> Graph:
        out = replace(self, **kept)
        for tell in self.subscribers:
            try:
                tell({"changed": sorted(kept)})
            except Exception:  # noqa: S110  a subscriber's failure is its own
                pass
        return out

    def subscribe(self, tell: Callable[[dict], None]) -> Callable[[], None]:
        self.subscribers.append(tell)
        return lambda: self.subscribers.remove(tell)

    # writes

    def upsert_nodes(self, new: DataFrame) -> Graph:
        """Labels are united, the properties of the new row win where they aren't null."""
        old = self.nodes.select("id", F.col("labels").alias("_l"), F.col("props").alias("_p"))
        fields = self.nodes.schema["props"].dataType.names
        merged = new.join(old, "id", "left")
        labels = F.when(F.col("_l").isNull(), F.col("labels")).otherwise(F.array_union("_l", "labels"))
        props = F.struct(*[F.coalesce(F.col(f"props.{f}"), F.col(f"_p.{f}")).alias(f) for f in fields])
        rest = [c for c in self.nodes.columns if c not in ("id", "labels", "props")]
        out = merged.select("id", labels.alias("labels"), props.alias("props"), *rest)
        return self._changed(nodes=self.nodes.join(new.select("id"), "id", "left_anti").unionByName(out))

    def create_nodes(self, new: DataFrame) -> Graph:
        if not new.join(self.nodes.select("id"), "id", "left_semi").isEmpty():
            raise EngineError("ALREADY_EXISTS", "a node has this id")
        return self._changed(nodes=self.nodes.unionByName(new))

    def create_edges(self, new: DataFrame) -> Graph:
        ends = new.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        if not ends.join(self.nodes.select("id"), "id", "left_anti").isEmpty():
            raise EngineError("NOT_FOUND", "an end of an edge is no node")
        if not new.where("confidence < 0 OR confidence > 1").isEmpty():
            raise invalid("confidence must be between 0 and 1")
        if not new.join(self.edges.select("id"), "id", "left_semi").isEmpty():
            raise EngineError("ALREADY_EXISTS", "an edge has this id")
        return self._changed(edges=self.edges.unionByName(new))

    def create_hyperedges(self, new: DataFrame) -> Graph:
        if not new.where(F.size("nodes") < 2).isEmpty():
            raise invalid("a hyperedge needs two nodes")
        members = new.select(F.explode("nodes").alias("id")).distinct()
        if not members.join(self.nodes.select("id"), "id", "left_anti").isEmpty():
            raise EngineError("NOT_FOUND", "a member of a hyperedge is no node")
        return self._changed(hyperedges=new if self.hyperedges is None else self.hyperedges.unionByName(new))

    def update_hyperedge(self, key: str, confidence: float) -> Graph:
        if not 0 <= confidence <= 1:
            raise invalid("confidence must be between 0 and 1")
        if self.hyperedges is None or self.hyperedges.where(F.col("id") == key).isEmpty():
            raise EngineError("NOT_FOUND", key)
        return self._changed(hyperedges=self.hyperedges.withColumn("confidence", F.when(F.col("id") == key, F.lit(confidence)).otherwise(F.col("confidence"))))

    def delete_nodes(self, ids: DataFrame) -> Graph:
        """Nodes (column id) go with their edges and every hyperedge that holds one of them."""
        edges = self.edges
        for end in ("src", "dst"):
            edges = edges.join(ids.select(F.col("id").alias(end)), end, "left_anti")
        hyper = self.hyperedges
        if hyper is not None:
            hit = hyper.select(F.col("id").alias("_h"), F.explode("nodes").alias("id")).join(ids, "id", "left_semi").select(F.col("_h").alias("id"))
            hyper = hyper.join(hit, "id", "left_anti")
        return self._changed(nodes=self.nodes.join(ids, "id", "left_anti"), edges=edges.select(*self.edges.columns), hyperedges=hyper)

    def delete_edges(self, ids: DataFrame) -> Graph:
        return self._changed(edges=self.edges.join(ids, "id", "left_anti"))

    def delete_hyperedges(self, ids: DataFrame) -> Graph:
        return self._changed(hyperedges=self.hyperedges.join(ids, "id", "left_anti"))

    def transaction(self, work: Callable[[Graph], Graph]) -> Graph:
        """All of ``work`` or, if it raises, nothing."""
        staged = work(replace(self, subscribers=[]))
        return self._changed(nodes=staged.nodes, edges=staged.edges, hyperedges=staged.hyperedges)

    # reads

    def node(self, key: str) -> DataFrame:
        return self.nodes.where(F.col("id") == key)

    def edges_of(self, key: str, direction: str = "both", types: Sequence[str] | None = None) -> DataFrame:
        test = {"out": F.col("src") == key, "in": F.col("dst") == key, "both": (F.col("src") == key) | (F.col("dst") == key)}[direction]
        out = self.edges.where(test)
        return out.where(F.col("type").isin(list(types))) if types else out

    def hyperedges_of(self, key: str, types: Sequence[str] | None = None) -> DataFrame:
        out = self.hyperedges.where(F.array_contains("nodes", key))
        return out.where(F.col("type").isin(list(types))) if types else out

    def links(self, types: Sequence[str] | None = None, direction: str = "both") -> DataFrame:
        """(here, there) of all edges in the wanted direction."""
        e = self.edges.where(F.col("type").isin(list(types))) if types else self.edges
        out, into = e.select(F.col("src").alias("here"), F.col("dst").alias("there")), e.select(F.col("dst").alias("here"), F.col("src").alias("there"))
        return {"out": out, "in": into, "both": out.union(into)}[direction]

    def k_hop(self, start: DataFrame, k: int, types: Sequence[str] | None = None, direction: str = "both", hyper: bool = True) -> DataFrame:
        """(origin, id, hops): the least number of hops, at most ``k``, from each origin (column id) to other nodes.

        Each round joins the last round's nodes with the edges; a hyperedge is a hop between any two members, taken by way
        of the hyperedge, so members are never paired up front.
        """
        if not 1 <= k <= MOST_HOPS:
            raise invalid("k must be between 1 and 6")
        links = self.links(types, direction)
        members = None
        if hyper and self.hyperedges is not None:
            h = self.hyperedges.where(F.col("type").isin(list(types))) if types else self.hyperedges
            members = h.select(F.col("id").alias("h"), F.explode("nodes").alias("member"))
        seen = start.select(F.col("id").alias("origin"), "id", F.lit(0).alias("hops"))
        last = seen
        for hop in range(1, k + 1):
            now = last.join(links, F.col("id") == F.col("here")).select("origin", F.col("there").alias("id"))
            if members is not None:
                through = last.join(members, F.col("id") == F.col("member")).select("origin", "h").distinct()
                now = now.union(through.join(members, "h").select("origin", F.col("member").alias("id")))
            last = materialise(now.distinct().join(seen, ["origin", "id"], "left_anti").withColumn("hops", F.lit(hop)), "hop")
            seen = seen.unionByName(last)
        return seen.where("hops > 0")

    def stats(self) -> DataFrame:
        """(kind, name, n): numbers of elements, the mean degree, and counts by label and type."""
        n = self.nodes.agg(F.lit("count").alias("kind"), F.lit("nodes").alias("name"), F.count("*").cast("double").alias("n"))
        e = self.edges.agg(F.lit("count").alias("kind"), F.lit("edges").alias("name"), F.count("*").cast("double").alias("n"))
        degree = n.select(F.col("n").alias("a")).crossJoin(e.select(F.col("n").alias("b"))).select(F.lit("mean"), F.lit("degree"), F.when(F.col("a") > 0, 2 * F.col("b") / F.col("a")).otherwise(0.0))
        labels = self.nodes.select(F.explode("labels").alias("name")).groupBy("name").agg(F.count("*").cast("double").alias("n")).select(F.lit("label"), "name", "n")
        types = self.edges.groupBy("type").agg(F.count("*").cast("double").alias("n")).select(F.lit("type"), "type", "n")
        out = n.union(e).union(degree).union(labels).union(types)
        if self.hyperedges is not None:
            out = out.union(self.hyperedges.agg(F.lit("count"), F.lit("hyperedges"), F.count("*").cast("double")))
        return out

    def search_nodes(self, query: Sequence[float], k: int, labels: Sequence[str] | None = None) -> DataFrame:
        """The nodes with the most similar embeddings, of any of the labels."""
        return similar(self.nodes, query, k, F.arrays_overlap("labels", F.array(*map(F.lit, labels))) if labels else None)


def similar(elements: DataFrame, query: Sequence[float], k: int, where=None) -> DataFrame:
    """The ``k`` nodes, edges or hyperedges whose embeddings are most similar to the query."""
    rows = elements.where(F.col("embedding").isNotNull())
    if where is not None:
        rows = rows.where(where)
    s = 1 - vector.cosine_distance(F.col("embedding"), vector.vector(query))
    return rows.withColumn("similarity", s).orderBy(F.col("similarity").desc(), "id").limit(k)
