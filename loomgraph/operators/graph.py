"""Retrieval from node and edge tables: lookups, search, hops, neighbourhoods. Patterns are joins."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Partitions for each one of a scan, whose bytes are packed: about a million short rows each.
SHARES = 8


def dealt(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes dealt by id to as many partitions as joins of them with these edges need, so that a task's memory doesn't grow with the edges.

    The other side of a join on id goes to as many. A number that is given isn't made smaller at run time.
    """
    most = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), SHARES * edges.rdd.getNumPartitions())
    return nodes.repartition(most, "id")


@dataclass
class Graph:
    """Node tables (id, label, ...) by label and edge tables (source_id, target_id, ...) by type, with their end labels."""

    nodes: dict[str, DataFrame] = field(default_factory=dict)
    edges: dict[str, DataFrame] = field(default_factory=dict)
    ends: dict[str, tuple[str, str]] = field(default_factory=dict)

    def edges_at(self, type_: str, near: str, ids: DataFrame) -> DataFrame:
        """The edges of a type whose end `near` (source_id or target_id) is one of ids (column id)."""
        return self.edges[type_].join(ids.select(F.col("id").alias(near)), near, "left_semi")


def lookup(graph: Graph, label: str, id_: object) -> DataFrame:
    return graph.nodes[label].filter(F.col("id") == F.lit(id_))


def search(nodes: DataFrame, text: str, columns: Sequence[str] = ("label", "synonyms"), fallback: object | None = None, preferred: Column | None = None) -> DataFrame:
    """One node: the first whose label or synonyms contain the text in any case; without one, that with the fallback id."""
    hit = F.lit(False)
    for c in columns:
        if c in nodes.columns:
            hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(text.lower())), F.lit(False))
    rank = F.when(hit, 0)
    if fallback is not None:
        rank = rank.when(F.col("id") == F.lit(fallback), 1)
    ranked = nodes.withColumn("_rank", rank).filter("_rank is not null")
    return ranked.orderBy("_rank", *([preferred.desc()] if preferred is not None else []), "id").limit(1).drop("_rank")


def _limited(df: DataFrame, order: Sequence[str], limit: int | None, keys: Sequence[str] = ()) -> DataFrame:
    """The first `limit` rows of each group of the keys, or of all."""
    if limit is None:
        return df
    columns = [F.col(c).asc_nulls_last() for c in order]
    if not keys:
        return df.orderBy(*columns).limit(limit)
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*columns))).filter(F.col("_n") <= limit).drop("_n")


def hop(graph: Graph, type_: str, ids: DataFrame, outward: bool = True, limit: int | None = 200, order: Sequence[str] = ("label", "id")) -> DataFrame:
    """The neighbours over one edge type of the nodes in ids (column id): anchor_id, the neighbour's columns, the edge's as edge_*; `limit` rows of each anchor."""
    source, target = ("source_id", "target_id") if outward else ("target_id", "source_id")
    label = graph.ends[type_][1 if outward else 0]
    edges = graph.edges_at(type_, source, ids)
    more = [F.col(c).alias(f"edge_{c}") for c in edges.columns if c not in ("source_id", "target_id")]
    near = edges.select(F.col(source).alias("anchor_id"), F.col(target).alias("_other"), *more)
    found = near.join(graph.nodes[label], F.col("_other") == F.col("id")).drop("_other")
    return _limited(found, order, limit, ["anchor_id"])


def two_patterns(graph: Graph, first: str, second: str, anchor_ids: DataFrame, limit: int | None = 300) -> DataFrame:
    """Middle nodes with an edge `first` to an anchor and an edge `second` to another node: a row for each pair of edges, `limit` of each anchor.

    A middle with a second edge brings a row at least, and rows go by its label first: so only the middles of the first `limit`
    labels of each anchor (and those of equal label) are expanded, however many edges there are.
    """
    one = graph.edges_at(first, "target_id", anchor_ids).select(F.col("source_id").alias("_middle"), F.col("target_id").alias("anchor_id"))
    far = graph.nodes[graph.ends[second][1]].select(F.col("id").alias("_far"), F.col("label").alias("far_label"))
    two = graph.edges[second].select(F.col("source_id").alias("_middle"), F.col("target_id").alias("_far")).join(far, "_far")
    middle = graph.nodes[graph.ends[first][0]].select(F.col("id").alias("_middle"), F.col("label").alias("middle_label"))
    near = one.join(middle, "_middle")
    if limit is not None:
        place = F.rank().over(Window.partitionBy("anchor_id").orderBy(F.col("middle_label").asc_nulls_last()))
        near = near.join(two.select("_middle"), "_middle", "left_semi").withColumn("_n", place).filter(F.col("_n") <= limit).drop("_n")
    named = near.join(two, "_middle").select("anchor_id", F.col("_middle").alias("middle_id"), "middle_label", F.col("_far").alias("far_id"), "far_label")
    return _limited(named, ("middle_label", "far_label", "middle_id", "far_id"), limit, ["anchor_id"])


def edge_scan(graph: Graph, type_: str, limit: int | None = 200) -> DataFrame:
    """Every edge of a type with the labels of both ends."""
    source, target = graph.ends[type_]
    s = graph.nodes[source].select(F.col("id").alias("source_id"), F.col("label").alias("source_label"))
    t = graph.nodes[target].select(F.col("id").alias("target_id"), F.col("label").alias("target_label"))
    rows = graph.edges[type_].select("source_id", "target_id").join(s, "source_id").join(t, "target_id")
    return _limited(rows.select("source_id", "source_label", "target_id", "target_label"), ("source_label", "target_label", "source_id", "target_id"), limit)


def neighbours(graph: Graph, ids: DataFrame, types: Sequence[str] | None = None, direction: str = "both", limit: int | None = 200) -> DataFrame:
    """anchor_id, type, direction, neighbour_label, neighbour_id, properties and edge_properties (JSON) of the edges at the nodes in ids, `limit` of each.

    A self-loop is one row for 'both'. An unknown direction or type is an error. Joins are on the keys as they are; ids become text behind them.
    """
    if direction not in ("out", "in", "both"):
        raise ValueError(f"direction must be 'out', 'in' or 'both', not {direction!r}")
    wanted = ids.select("id").distinct()
    parts: list[DataFrame] = []
    for type_ in types or list(graph.edges):
        more = [c for c in graph.edges[type_].columns if c not in ("source_id", "target_id")]
        own = F.to_json(F.struct(*more)) if more else F.lit("{}")
        for way, (near, far), label in (("out", ("source_id", "target_id"), graph.ends[type_][1]), ("in", ("target_id", "source_id"), graph.ends[type_][0])):
            if direction in (way, "both"):
                edges = graph.edges_at(type_, near, wanted).select(F.col(near).alias("_near"), F.col(far).alias("_far"), own.alias("edge_properties"))
                if way == "in" and direction == "both":
                    edges = edges.filter("_near != _far")
                nodes = graph.nodes[label]
                props = nodes.select(F.col("id").alias("_far"), F.col("label").alias("neighbour_label"), F.to_json(F.struct(*nodes.columns)).alias("properties"))
                text = [F.col(c).cast("string").alias(name) for c, name in (("_near", "anchor_id"), ("_far", "neighbour_id"))]
                parts.append(edges.join(props, "_far").select(text[0], F.lit(type_).alias("type"), F.lit(way).alias("direction"), "neighbour_label", text[1], "properties", "edge_properties"))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return _limited(rows, ("type", "direction", "neighbour_label", "neighbour_id", "edge_properties"), limit, ["anchor_id"])
