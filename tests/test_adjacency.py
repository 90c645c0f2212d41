"""Stored edges give what plain ones give; no exchange or sort stands above the edges' scan; split nodes, odd rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import adjacency as A
from loomgraph.operators import graph as G


def small_graph(spark, extra=()):
    """Node 0 has 300 edges of its own, 7 has repeated ones and a loop; some ends are missing."""
    edges = [(0, k, f"w{k}") for k in range(300)] + [(k, k % 5, None) for k in range(1, 60)] + [(7, 7, "loop"), (7, 8, "a"), (7, 8, "a")]
    edges += [(None, 3, "x"), (3, None, "y"), (None, None, "z"), *extra]
    nodes = spark.createDataFrame([(k, f"n{k % 40}", "p") for k in range(320)], "id long, label string, kind string")
    table = spark.createDataFrame(edges, "source_id long, target_id long, _salt string")
    return G.Graph({"Thing": nodes}, {"KNOWS": table}, {"KNOWS": ("Thing", "Thing")})


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


def above(plan: str, mark: str) -> list[str]:
    """The operators above the one that shows the mark, nearest first."""
    lines = plan.split("\n")
    at = next(k for k, line in enumerate(lines) if mark in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-*"))
    found, level = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if line.strip() and depth(line) < level:
            found.append(line)
            level = depth(line)
    return found


@pytest.mark.parametrize("part", [A.PART, 20])
def test_stored_edges_give_the_same_rows(spark, part):
    plain = small_graph(spark)
    kept = A.store_graph(plain, part=part)
    split = {r["id"]: r["parts"] for r in kept.sides["KNOWS", "source_id"].split.collect()}
    assert split == ({0: 15} if part == 20 else {})
    ids = spark.createDataFrame([(k,) for k in (0, 3, 7, 7, 59, 1000, None)], "id int")
    for outward in (True, False):
        for limit in (None, 4):
            assert rows(G.hop(kept, "KNOWS", ids, outward, limit)) == rows(G.hop(plain, "KNOWS", ids, outward, limit))
    for direction in ("out", "in", "both"):
        found = rows(G.neighbours(kept, ids, direction=direction, limit=None))
        assert found == rows(G.neighbours(plain, ids, direction=direction, limit=None)) and found
    assert rows(G.two_patterns(kept, "KNOWS", "KNOWS", ids, 10)) == rows(G.two_patterns(plain, "KNOWS", "KNOWS", ids, 10))
    assert rows(G.edge_scan(kept, "KNOWS", None)) == rows(G.edge_scan(plain, "KNOWS", None))
    A.drop(kept)


def test_no_edge_is_shuffled_or_sorted(spark):
    kept = A.store_graph(small_graph(spark), part=20)
    ids = kept.nodes["Thing"].filter("label = 'n7'")
    for near in A.ENDS:
        df = kept.edges_at("KNOWS", near, ids)
        over = above(df._jdf.queryExecution().executedPlan().toString(), "Bucketed: true")
        assert any("ShuffledHashJoin" in line for line in over)
        assert not [line for line in over if "Exchange" in line or "Sort " in line or "Broadcast" in line]
    A.drop(kept)


def test_a_node_of_many_edges_is_spread_over_buckets(spark):
    """A third of all edges at one node: no bucket holds much more than its share."""
    hot = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("source_id"), F.col("id").alias("target_id"))
    kept = A.store_graph(G.Graph({}, {"E": hot}, {}), part=50, bucket=100)
    side = kept.sides["E", "source_id"].edges
    sizes = [r["n"] for r in side.groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 3000 and max(sizes) < 400
    asked = spark.createDataFrame([(5,)], "id long")
    assert kept.edges_at("E", "source_id", asked).count() == 1001
    A.drop(kept)


def test_no_edges(spark):
    plain = small_graph(spark)
    plain.edges["KNOWS"] = plain.edges["KNOWS"].limit(0)
    kept = A.store_graph(plain)
    ids = plain.nodes["Thing"]
    assert G.hop(kept, "KNOWS", ids).count() == 0 and G.neighbours(kept, ids).count() == 0
