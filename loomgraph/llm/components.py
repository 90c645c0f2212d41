"""Connected components of a table of edges, by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

#: A node of more than a FEW-th of all edges is hot. There are no more than 2 * FEW such nodes, so they go to every task.
FEW = 1000


def _with_least(rows: DataFrame, least: DataFrame, edges: int) -> DataFrame:
    """rows (u, ...) with the m of their u. least: (u, m, n), n the number of rows of u; those of hot nodes stay where they are."""
    most = max(1000, edges // FEW)
    hot, rest = F.broadcast(least.filter(F.col("n") > most).drop("n")), least.filter(F.col("n") <= most).drop("n")
    return rows.join(hot, "u").unionByName(rows.join(hot.select("u"), "u", "left_anti").join(rest, "u"))


def _large_star(edges: DataFrame, number: int) -> DataFrame:
    """Every node's larger neighbours are tied to its smallest neighbour, or to itself."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return _with_least(both.filter("v > u"), least, number).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(edges: DataFrame, number: int) -> DataFrame:
    """Every node and its smaller neighbours are tied to the smallest of them. Edges hold the larger node first."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _with_least(edges, least, number).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """links (a, b): longs, or structs of one type; the result: node and component (the smallest node), for every node of a link.

    Large and small stars alternate until they change nothing: about log of the longest path rounds, each of which
    writes the edges into the shared folder. No edge table grows, and nothing comes to the driver but a checksum.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    sign, number = None, edges.count()
    while True:
        large = stored(_large_star(edges, number), "edges")
        before, edges = edges, stored(_small_star(large, number), "edges")
        discard(before, large)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == sign:
            break
        sign, number = now, now[0]
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
