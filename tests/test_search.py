"""Searches for tables of texts, token overlap with hot tokens, and term lists by size: against brute force, and plans."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loomgraph import queries
from loomgraph.operators import graph as G
from loomgraph.operators import links as L
from loomgraph.operators import nodes as N
from loomgraph.operators import search as C
from loomgraph.streaming import questions as streaming

DATA = "/root/testdata/sf0.001"
WORDS = ["tau", "beta", "Amyloid", "b", "p-tau", "é", "x y", "%_", "NfL", "aa", "aaa"]


def _labels(seed, n):
    pick = random.Random(seed)
    return [None if pick.random() < 0.1 else " ".join(pick.choices(WORDS, k=pick.randint(0, 4))) for _ in range(n)]


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_containing_is_brute_force(spark, block):
    rows = [(k, a, b) for k, (a, b) in enumerate(zip(_labels(1, 60), _labels(2, 60), strict=True))] + [(None, "tau", "tau"), (3, "tau", "again")]
    asked = ["TAU", "ta", "u", "au b", "aa", "aaaa", "%", "É", "nothing", "", None, "tau", "aaa aaa", "p-tau beta"]
    nodes = spark.createDataFrame(rows, "id long, label string, synonyms string")
    wanted = spark.createDataFrame([(t,) for t in asked], "q string")
    got = {tuple(r) for r in C.containing(wanted, "q", nodes, "id", [F.col("label"), F.col("synonyms")], block=block).collect()}
    texts = {t.lower() for t in asked if t}
    assert got == {(t, k) for t in texts for k, *held in rows if k is not None and any(h is not None and t in h.lower() for h in held)}


def test_search_for_a_table_is_search_for_each(spark):
    rows = [(k, a, b, k % 3 == 0) for k, (a, b) in enumerate(zip(_labels(3, 40), _labels(4, 40), strict=True))]
    nodes = spark.createDataFrame(rows, "id long, label string, synonyms string, good boolean")
    asked = ["tau", "TAU b", "aaa", "no such", "x", "é", "tau"]
    texts = spark.createDataFrame([(k, t, "old") for k, t in enumerate(asked)], "k int, q string, match string")
    index = C.gram_index(nodes, "id", [F.col("label"), F.col("synonyms")])
    got = {r["k"]: (r["node_id"], r["match"]) for r in C.search_texts(nodes, texts, "q", fallback=5, preferred=F.col("good"), index=index).collect()}
    for k, t in enumerate(asked):
        each = G.search(nodes, t, fallback=5, preferred=F.col("good")).collect()
        assert got[k][0] == each[0]["id"], t
    assert got[3] == (5, "fallback") and got[0][1] == "search" and len(got) == len(asked)


def test_search_for_odd_texts(spark):
    nodes = spark.createDataFrame([(1, "tau")], "id long, label string")
    texts = spark.createDataFrame([(0, None), (1, ""), (2, "tau" * 50_000)], "k int, q string")
    assert {tuple(r) for r in C.search_texts(nodes, texts, "q").select("k", "node_id", "match").collect()} == {(k, None, None) for k in range(3)}
    assert {r["node_id"] for r in C.search_texts(nodes, texts, "q", fallback=1).collect()} == {1}
    assert {r["node_id"] for r in C.search_texts(nodes, texts, "q", fallback=2).collect()} == {None}
    assert C.search_texts(nodes.limit(0), texts, "q", fallback=1).filter("node_id is not null").count() == 0
    assert C.search_texts(nodes, texts.limit(0), "q").count() == 0


def test_searches_compare_no_pair_without_a_common_substring(spark):
    nodes, texts = spark.createDataFrame([(1, "tau")], "id long, label string"), spark.createDataFrame([("tau",)], "q string")
    for df in (C.search_texts(nodes, texts, "q"), C.allow_fragments(nodes, F.col("label"), texts, "q")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_fragments_of_a_table(spark):
    df = spark.createDataFrame([(1, "Cold Spring", "a"), (2, "bold", "b"), (3, None, "c"), (1, "Cold Spring", "a")], "id int, label string, _label string")
    fragments = spark.createDataFrame([("RING",), ("old b",), (None,), ("",)], "fragment string")
    assert [tuple(r) for r in C.allow_fragments(df, F.col("label"), fragments, "fragment").collect()] == [(1, "Cold Spring", "a")] * 2


@pytest.mark.parametrize("block", [1, 4, 4096])
def test_token_overlap_splits_hot_tokens(spark, block):
    pick = random.Random(block)
    names = [["hot", *pick.choices("abcdefgh", k=pick.randint(0, 3))] if k % 2 else pick.choices("abcdefgh", k=2) for k in range(60)]
    left = spark.createDataFrame([(k, " ".join(v)) for k, v in enumerate(names)] + [(0, "extra-a"), (99, None), (98, " ")], "x int, t string")
    right = spark.createDataFrame([(k, "-".join(v).upper()) for k, v in enumerate(names[:30])], "y int, t string")
    got = [tuple(r) for r in L.token_overlap(left, "x", F.col("t"), right, "y", F.col("t"), block=block).collect()]
    held = [set(v) for v in names]
    held[0] |= {"extra", "a"}
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in range(60) for b in range(30) if held[a] & set(names[b])}
    without = {tuple(r) for r in L.token_overlap(left, "x", F.col("t"), right, "y", F.col("t"), stop=["hot"], block=block).collect()}
    assert without == {(a, b) for a in range(60) for b in range(30) if held[a] & set(names[b]) - {"hot"}}


def test_term_lists_are_bounded_and_in_first_seen_order(spark):
    rows = [(k, "Common", f"own {k % 5}", (k * 37) % 101) for k in range(100)] + [(None, "Common", "x", 0), (3, " common ", "own 3", -1), (4, None, "", 2)]
    df = spark.createDataFrame(rows, "id int, a string, b string, at int")
    got = [tuple(r) for r in N.term_index(df, "id", [F.col("a"), F.col("b")], order=F.col("at"), size=7).collect()]
    seen: dict[str, dict[int, int]] = {}
    for k, a, b, at in rows:
        for t in (a, b):
            if k is not None and t:
                ids = seen.setdefault(" ".join(t.lower().split()), {})
                ids[k] = min(at, ids.get(k, at))
    want = set()
    for term, ids in seen.items():
        ordered = [k for k, _ in sorted(ids.items(), key=lambda x: (x[1], x[0]))]
        want |= {(term, p // 7, tuple(ordered[p : p + 7])) for p in range(0, len(ordered), 7)}
    assert {(t, p, tuple(ids)) for t, p, ids in got} == want and len(got) == len(want)


def test_reports_are_made_of_the_asked_nations_only(spark):
    """The parts themselves hold no other nation: the anchors reach them before any aggregate."""
    anchors = spark.createDataFrame([(3,), (8,), (77,)], "c_nationkey int")
    parts = queries._nation_reports(spark, DATA, anchors)
    found = {name: {r["c_nationkey"] for r in part.select("c_nationkey").collect()} for name, (part, _) in parts.items()}
    assert all(keys <= {3, 8} for keys in found.values()) and any(found.values())


def test_stored_reports_are_not_made_again(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    reports = spark.range(3).selectExpr("concat('s', id) AS strategy", "'text' AS context", "true AS anchor_found")
    stored = streaming.stored_reports(reports.mapInArrow(count, reports.schema))
    assert stored.count() == stored.filter("context = 'text'").count() == 3 and made.value == 3
