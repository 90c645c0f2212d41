"""Page queries at size: what their plans must not do, and odd pages through the steps that were made for it."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph import queries as Q
from loomgraph.operators import links as L
from loomgraph.operators import pages as P
from loomgraph.operators import search as S

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["page_details", "page_targets", "page_trials"])
def test_details_neither_join_nor_broadcast(spark, name):
    plan = _plan(Q.queries()[name](spark, SF))
    assert "Join" not in plan and "Broadcast" not in plan and plan.count("MapInArrow") == 1


def test_order_pages_are_not_broadcast(spark):
    for name in ("page_lines", "page_kv", "page_sections"):
        assert "Broadcast" not in _plan(Q.queries()[name](spark, SF))


def test_labelled_values_stay_in_their_row(spark):
    html = "<p><b>A b:</b> 1<br><b>A:</b> <i> </i></p><b>a B:</b> 2 &amp; 3<strong>K:</strong> v"
    rows = [(1, html), (2, None), (3, "<b>A:</b> "), (None, "<b>K:</b> z"), (1, "<b>Q:</b> q")]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    found = P.labelled_values(pages, {"k": "kind"})
    assert "Exchange" not in _plan(found)
    assert sorted([(r[0] or 0, r[1]) for r in found.collect()], key=str) == [(0, {"kind": "z"}), (1, {"a_b": "2 & 3", "kind": "v"}), (1, {"q": "q"})]


def _random_page(r) -> str:
    pieces = ["<table>", "</table>", "<tbody>", "<tr>", "</tr>", "<td>", "</td>", "<th scope=row>", "</th>", "<section id=s>", "</section>", '<div class="a primary">', '<div id=z class="m">', "</div>", "<h2>", "</h2>", "<p>", "</p>", "t &lt;", " ", "<a href=/u>", "</a>"]
    rows = ["<tr><td>a</td><td> b &amp; c</td></tr>", '<tr><td>x <a title="&gt;" href="/q?a&amp;b">l<b>m</b></a> y</td><td></td></tr>', "<tr><td>q</td> </tr>", '<tr><td><a href="">e</a></b></td></tr>']
    return "".join(r.choices(pieces + rows, [2] * len(pieces) + [8] * len(rows), k=r.randint(1, 25)))


def test_rows_in_one_step_equal_rows_tag_by_tag(monkeypatch):
    """Pages of any nesting; what isn't asked for is left out and changes nothing of the rest."""
    r, steps = random.Random(5), []
    pages = [_random_page(r) for _ in range(4000)]
    one_step = P._Parser._plain_row
    monkeypatch.setattr(P._Parser, "_plain_row", lambda self, cells: (steps.append(1), one_step(self, cells)))
    fast = [{k: P._Parser(k).result(html) for k in (P.KINDS, ("tables",), ("sections",), ("marks",))} for html in pages]
    assert len(steps) > 1000
    monkeypatch.setattr(P._Parser, "_row_follows", lambda self: False)
    monkeypatch.setattr(P._Parser, "_table_is_idle", lambda self: False)
    for html, found in zip(pages, fast, strict=True):
        whole = P._Parser().result(html)
        assert found[P.KINDS] == whole, html
        assert found[("tables",)] == {**whole, "sections": [], "named": [], "headings": []}, html
        assert found[("sections",)] == {**whole, "tables": [], "named": [], "headings": []}, html
        assert found[("marks",)]["tables"] == [{**t, "cells": [], "urls": [], "head": None, "href": None} for t in whole["tables"]], html


def test_search_meets_equal_texts_once(spark):
    """Of nodes with equal texts one is searched: the one that an id's best row puts first."""
    nodes = spark.createDataFrame([(5, "Ab c", "x", False), (5, "q", None, True), (3, "aB C", "x", False), (9, None, "ab", None)] + [(20 + k, "ab c", "x", False) for k in range(50)], "id long, label string, synonyms string, p boolean")
    texts = spark.createDataFrame([("AB C",), ("q",), ("ab",), ("zz",), (None,)], "t string")
    found = S.search_texts(nodes, texts, "t", preferred=F.col("p"))
    assert sorted((r["t"] or "", r["node_id"]) for r in found.collect()) == [("", None), ("AB C", 5), ("ab", 5), ("q", 5), ("zz", None)]
    assert "min(struct(late" in found._jdf.queryExecution().optimizedPlan().toString()


def test_multi_key_compares_pairs_of_rows_with_several_names_only(spark):
    targets = spark.createDataFrame([(1, "a"), (1, "B"), (1, "a "), (2, "b"), (3, ""), (4, None), (None, "c")], "row long, name string")
    nodes = spark.createDataFrame([(10, "A", "b", ["c"]), (11, "a", "B", ["c", "a"]), (10, "A", "x", ["b"])], "id long, s string, l string, y array<string>")
    found = L.multi_key(targets, "row", F.col("name"), nodes, F.col("s"), F.col("l"), F.col("y"), F.col("id"))
    assert sorted(tuple(-1 if c is None else c for c in r) for r in found.collect()) == [(-1, 10), (1, 10), (1, 11), (2, 10), (2, 11)]
    assert "Union" in found._jdf.queryExecution().optimizedPlan().toString()


def test_hop_in_is_dealt_by_its_input(spark):
    assert "REPARTITION_BY_NUM" in _plan(Q.queries()["hop_in"](spark, SF))


def _behind_the_parse(df) -> str:
    """The plan of what is done with parsed pages."""
    plan = _plan(df)
    assert plan.count("MapInArrow") == 1
    return plan.split("MapInArrow")[0]


def _odd_page(r) -> str:
    """A page as from _random_page, with headers, odd cells and whatever can't be cut at its brackets."""
    pieces = ["<!-- <tr> -->", "<script>'<tr>'</script>", "<TABLE>", "<TR>", "<th>", "a < b", "x > y", '<a title="<tr>" href=/v>', "<br/>", "<span", "<div class='x>y'>", "<!DOCTYPE x>"]
    rows = ["<tr><td>H</td><td># n</td></tr>", "<tr><td>G <b>x</b></td><td>#</td><td></td></tr>", "<tr><td>one</td></tr>", '<tr><td><a href="/q  \n r" title="\n">  m\n n </a>\t<b>o</b>&#32;</td><td>\u20031\xa0 2\x1f</td><td>&nbsp;&amp;lt;</td></tr>']
    return "".join(r.choice([_random_page(r), r.choice(rows), r.choice(pieces) if r.random() < 0.1 else "<table><tbody>"]) for _ in range(r.randint(1, 8)))


def test_cross_group_is_neither_dealt_nor_sorted_behind_the_parse(spark):
    plan = _behind_the_parse(Q.queries()["page_cross_group"](spark, SF))
    assert "Exchange" not in plan and "Sort" not in plan and "Window" not in plan


def test_headed_rows_are_the_rows_of_the_parse_with_their_headers(spark):
    r = random.Random(7)
    pages = spark.createDataFrame([*enumerate(_odd_page(r) for _ in range(1500)), (-1, None), (-2, ""), (-3, "<p>no table")], "page_id long, html string").repartition(3)
    names = ["page_id", "table_no", "row_no", "header", "cells", "urls", "head", "href"]
    parsed = P.parsed(pages).cache()
    for body_only in (True, False):
        expected = sorted(map(str, P.carried_headers(P.table_rows(parsed, body_only)).select(names).collect()))
        assert len(expected) > 2000 and sum("header=None" not in e for e in expected) > 200
        assert sorted(map(str, P.headed_rows(pages, body_only=body_only).select(names).collect())) == expected
    assert sorted(map(str, P.headed_rows(pages, body_only=False, only=1, dealt=True).select(names).collect())) == [e for e in expected if "table_no=1," in e]
    parsed.unpersist()


def test_a_header_is_carried_within_its_page(spark):
    """Also if pages share an id, or have none."""
    html = "<table><tbody><tr><td>{0}</td><td># n</td></tr><tr><td>r{0}</td><td>1</td></tr></tbody></table>"
    pages = spark.createDataFrame([(1, html.format("a")), (1, html.format("b")), (None, html.format("c"))], "page_id long, html string").coalesce(1)
    assert sorted((r["header"], r["cells"]) for r in P.headed_rows(pages).collect()) == [(k, [f"r{k}", "1"]) for k in "abc"]


def test_table_long_works_out_a_label_once_and_deals_no_page(spark):
    plan = _behind_the_parse(Q.queries()["page_table_long"](spark, SF))
    assert "Exchange" not in plan and "Sort" not in plan and "Window" not in plan
    assert plan.index("Generate explode") < plan.index("AS measure_key")


def test_measurements_are_the_same_of_rows_and_of_headed_rows(spark):
    cells = lambda *texts: "<tr>" + "".join(f"<td>{t}</td>" for t in texts) + "</tr>"
    main = cells("Head", "# n", "") + cells("Tau (CSF)", "1", "&lt;2", "", "-", " ", "-", "", "3.5", "x", 'm <a href="/a">b</a><a href="http://c">d</a>') + cells("none", *["-"] * 9, "m") + cells("short", "1")
    second = cells("NfL", "4", "-", "0.5") + cells("Other", "#") + cells("(x)", "", "1e3", "+7") + cells("", "-", "", "-")
    html = f"<table><tbody>{main}</tbody></table><table><tbody>{second}</tbody></table><table><tbody>{second}</tbody></table>"
    pages = spark.createDataFrame([(1, html), (2, html.replace("Head", "Top")), (3, None)], "page_id long, html string")
    whole, headed = P.table_rows(P.parsed(pages)), P.headed_rows(pages)
    for make, n in ((lambda rows: P.page_measurements(rows, base="http://x"), 8), (P.measurements, 4), (P.cross_group, 8)):
        found = sorted(map(str, make(headed).collect()))
        assert found == sorted(map(str, make(whole).collect())) and len(found) == n


def test_timeline_deals_no_page(spark):
    """Orders and lines are dealt; pages made of them and what is read from them stay where they are."""
    assert _plan(Q.queries()["page_timeline"](spark, SF)).count("Exchange hashpartitioning") == 2


def test_pages_of_which_rows_alone_are_asked_for():
    """Every column is as the walk of the whole page has it, whatever the slices."""
    r = random.Random(11)
    pages = [None, "", "<p>x", *(_odd_page(r) for _ in range(1500))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(pages))), pa.array(pages)], names=["page_id", "html"])
    assert [len(p) for p in P._parts(batch, 1000)] == [1000, 503] and sum(len(p) for p in P._parts(batch, 1000, 50)) == len(pages)
    for kinds in (("tables",), ("marks",)):
        found = [row for part in P._parse(iter([batch]), kinds) for row in part.to_pylist()]
        assert found == [{"page_id": k, **P._Parser(kinds).result(html)} for k, html in enumerate(pages)]
