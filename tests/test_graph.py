"""Small frames with nulls, blanks, NaN and non-ASCII text; the oracle over the given tables; plans."""

from __future__ import annotations

import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomgraph import queries
from loomgraph.functions import text as X
from loomgraph.operators import graph as G
from loomgraph.operators import links as L
from loomgraph.operators import nodes as N
from loomgraph.operators import pages as P
from loomgraph.operators import reports
from loomgraph.operators import routing as Q
from loomgraph.plans.specs import BIOMEDICAL
from loomgraph.sources import tables as S

DATA = "/root/testdata/sf0.001"


def one(spark, column, *values):
    """The expression's value for each of the texts."""
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, c string")
    return [r[0] for r in rows.orderBy("k").select(column(F.col("c"))).collect()]


def test_text_expressions(spark):
    assert one(spark, X.clean, " a  b\n", None) == ["a b", ""]
    assert one(spark, X.slug, "Aβ-42 (CSF) ", "--x--") == ["AΒ_42_CSF", "X"]
    assert one(spark, X.measure_key, "Aβ42 (CSF)", "albumin ratio", "§") == ["abeta42_csf", "albumin_ratio", "unknown"]
    assert one(spark, X.core_part, "Aβ42 (CSF)", "tau") == ["Aβ42", "tau"]
    assert one(spark, X.qualifier, "Aβ42 (CSF)", "tau") == ["CSF", None]
    assert one(spark, X.tolerant_int, " 12 ", "-", "", None, "1.5") == [12, None, None, None, None]
    assert one(spark, X.tolerant_double, "<0.05", "1.0f", "-", "1e-3") == [0.05, None, None, 0.001]
    assert one(spark, X.packed_list, "a| b ,,c", None, " ") == [["a", "b", "c"], [], []]
    assert one(spark, lambda c: X.packed_list(c, ","), "x0, y1, z2") == [["x0", "y1", "z2"]]
    assert one(spark, X.curie, "http://x/obo/MONDO_1_2") == ["MONDO:1_2"]
    assert one(spark, X.direction, "Higher in AD", "up", "No Change", " ", None, "mixed") == ["increased", "increased", "no_change", "unknown", "unknown", "mixed"]
    assert one(spark, X.fluid_bucket, "CSF", "serum", None) == ["CSF", "Plasma/Serum", "Other/unspecified"]
    assert one(spark, X.phase_max, "Phase 1/phase 3", "none") == [3, None]
    assert one(spark, X.phase_status, "Phase 2", "Approved", "Halted phase 1", "x", None) == ["ongoing", "approved", "discontinued", "unknown", None]
    assert one(spark, X.action_type, "DNA/RNA-based", "Small Molecule (timeline)", None) == ["gene_therapy", "small_molecule", None]
    assert one(spark, lambda c: X.summary(c, 1, "background"), "Background It is 10. Then 20.", " ") == ["It is 10.", None]
    assert one(spark, X.analyte_class, "Aβ42", "p-tau", "NfL", "YKL-40", "x") == ["amyloid", "tau", "neurodegeneration", "inflammation", "other"]


def test_effect_direction_guards_nan(spark):
    rows = spark.createDataFrame([(0, math.nan), (1, None), (2, 2.0), (3, 0.5), (4, 1.0)], "k int, e double")
    assert [r[0] for r in rows.orderBy("k").select(X.effect_direction(F.col("e"))).collect()] == ["no_change", "no_change", "increased", "decreased", "no_change"]


def test_development_bucket(spark):
    rows = spark.createDataFrame([(0, "Approved", None, None, None), (1, None, None, "nan", "true"), (2, None, "recruiting", "2", None), (3, None, "ongoing", "nan", None), (4, None, "halted", None, None), (5, None, None, None, None)], "k int, s string, t string, p string, h string")
    found = [r[0] for r in rows.orderBy("k").select(X.development_bucket(*map(F.col, "stph"))).collect()]
    assert found == ["Approved or marketed", "Phase 3 trials", "Ongoing Phase 1–2 trials", "Ongoing (phase unknown)", "Discontinued or terminated", "Status unclear / other"]


def test_catalog(spark):
    assert len(BIOMEDICAL.nodes) == 15 and len(BIOMEDICAL.edges) == 18
    assert BIOMEDICAL.node("Gene").columns[:2] == ("id", "label")
    with pytest.raises(KeyError):
        BIOMEDICAL.edge("NO_SUCH")
    assert BIOMEDICAL.listing(spark).count() == 33


def test_conform_and_empty(spark):
    df = spark.createDataFrame([("1", "a", "x")], "id string, label string, extra string")
    spec = BIOMEDICAL.node("Fluid")
    row = N.conform(df, spec.schema).first()
    assert row.asDict() == {"id": "1", "label": "a", "category": None, "source": None, "raw_source_ids": None}
    assert S.empty(spark, spec.schema).count() == 0


def test_distinct_join_keeps_first_seen_order(spark):
    df = spark.createDataFrame([(1, 0, "b"), (1, 1, "a"), (1, 2, "b"), (1, 3, ""), (2, 0, None)], "g int, o int, v string")
    assert {r["g"]: r["vs"] for r in N.distinct_join(df, ["g"], F.col("v"), F.col("o"), "vs").collect()} == {1: "b | a"}


def test_multi_key_and_overlap(spark):
    nodes = spark.createDataFrame([("n1", "TP", "first", ["alias"], 1), ("n2", "tp ", "same", ["alias"], 2), ("n3", "q", "Same", [], 3), ("n4", None, None, None, 4)], "id string, symbol string, label string, synonyms array<string>, o int")
    targets = spark.createDataFrame([(1, "tp"), (2, "SAME"), (3, "alias"), (4, ""), (5, None)], "row int, name string")
    found = L.multi_key(targets, "row", F.col("name"), nodes, F.col("symbol"), F.col("label"), F.col("synonyms"), F.col("o"))
    assert sorted(map(tuple, found.collect())) == [(1, "n1"), (1, "n2"), (2, "n3"), (3, "n1")]
    plan = L.token_overlap(targets, "row", F.col("name"), nodes, "id", F.col("label"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_anchor_and_enrich(spark):
    nodes = spark.createDataFrame([("2", "Big Asia", "b"), ("1", "asia", "a"), ("3", None, "a")], "id string, label string, source string")
    assert L.anchor(nodes, "Asia").first()["id"] == "1"
    assert L.anchor(nodes, "Asia", "b").first()["id"] == "2"
    base = spark.createDataFrame([(1,), (2,)], "k int")
    detail = spark.createDataFrame([(1, "y"), (1, "x")], "k int, d string")
    assert sorted(map(tuple, L.enrich(base, detail, "k").collect())) == [(1, "x"), (2, None)]


def test_neighbours_counts_self_loops_once(spark):
    nodes = spark.createDataFrame([(1, "a"), (2, "b")], "id int, label string")
    edges = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "source_id int, target_id int")
    g = G.Graph({"N": nodes}, {"E": edges}, {"E": ("N", "N")})
    assert G.neighbours(g, nodes.filter("id = 1")).count() == 3
    with pytest.raises(ValueError, match="direction"):
        G.neighbours(g, nodes, direction="sideways")


def test_routing(spark):
    asked = ["Which CSF biomarkers in phase 3?", "memory", "Alzheimer?", None, "", "gene HGNC:1 GO:2 MONDO:3 GO:2", "drug pathway"]
    df = spark.createDataFrame(list(enumerate(asked)), "k int, question string")
    rows = Q.prompts(Q.route(Q.classify(df), spark.createDataFrame([("AD_PHENOTYPES_V1", "ctx", True)], "strategy string, context string, anchor_found boolean"))).orderBy("k").collect()
    assert [r["intent"] for r in rows] == ["DRUG_TRIAL", "PHENOTYPE", "GENERAL_AD", "OTHER", "OTHER", "GENE_PROTEIN", "DRUG_TRIAL"]
    assert rows[0]["notes"].endswith(" A trial or a phase is named: DRUG_TRIAL.")
    assert rows[5]["focus_entities"] == ["MONDO:3", "GO:2", "HGNC:1"]
    assert rows[1]["prompt"].endswith("ctx") and rows[1]["answer"] is None and rows[0]["answer"] == Q.MISSING


HTML = """<title>T &amp; U</title><script>'<table><tr><td>x</td></tr></table>'</script><p>One</p><!-- <p>no</p> --><p>Two
<table><tbody><tr><td>Head</td><td># n</td></tr><tr><td>A<b>β</b></td><td>5</td><td>&lt;1.5</td><td>-</td><td>-</td><td></td><td>-</td><td>7</td><td></td><td>0.1</td><td>m <a href="/m">n</a></td></tr>
<tr><td>few</td><td>1</td></tr><tr><th scope="row"><a href="/d/one/">Drug <i>X</i></a></th><td>a<td>b</tr></tbody></table>
<div class="primary"><section id="over-view">Intro. More.</section><section><h2>Signs</h2>Text<section><h3>Deep</h3>er</section></section></div>
<p><strong>Type:</strong> old<br><strong>Type:</strong> new &amp; x</p><p>Last Updated: May</p>"""


def test_pages(spark):
    pages = spark.createDataFrame([(1, "http://x/p/1", HTML), (2, "http://x/?a", None), (3, "http://x/p/3", "<td")], "page_id long, url string, html string")
    walked = P.parsed(pages)
    assert walked.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    rows = P.table_rows(walked)
    found = P.measurements(rows, base="http://x").collect()
    assert [(r["comparison"], r["label"], r["version"], r["n"], r["effect"], r["p_value"], r["meta_text"], r["meta_urls"]) for r in found] == [("Head", "A β", "1.x", 5, 1.5, None, "m n", "http://x/m"), ("Head", "A β", "3.0", 7, None, 0.1, "m n", "http://x/m")]
    assert [r.asDict() for r in P.search_results(rows, ["first", "second"], "http://x").collect()] == [{"page_id": 1, "row_no": 3, "name": "Drug X", "slug": "one", "url": "http://x/d/one/", "first": "a", "second": "b"}]
    assert P.search_results(rows, ["first", "second", "third"]).count() == 0
    assert [(r["section_name"], r["section_title"], r["section_order"], r["text"]) for r in P.sections(walked).orderBy("section_order").collect()] == [("over-view", "Over View", 1, "Intro. More."), ("signs", "Signs", 2, "Text er")]
    assert P.labelled_values(pages, {"type": "kind"}).first()["values"] == {"kind": "new & x"}
    meta = {r["page_id"]: r for r in P.metadata(pages).collect()}
    assert meta[1]["title"] == "T & U" and meta[1]["intro"].startswith("One") and meta[1]["last_updated"] == "May"
    assert meta[2]["title"] is None and P.failures(walked).count() == 0


def test_links_keep_their_titles(spark):
    html = '<a href="/d/one">One <b>1</b><a href="/d/two">Two</a> <a name=x>no</a><A class=a HREF="/d/three/">Three</A><a href="/d/one">again</a><a href="/e/x">x</a><a href="/d/four'
    pages = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    found = {r["id"]: (r["url"], r["title"]) for r in P.links(pages, "/d/", base="http://x").collect()}
    assert found == {"one": ("http://x/d/one", "One 1"), "two": ("http://x/d/two", "Two"), "three": ("http://x/d/three/", "Three")}


def test_parser_of_messy_markup(spark):
    html = '<p title="a > b">x<p>y &amp; z&nbsp;<b>w<br/>v</b><ul><li>1<li>2</ul><!-- <td> --><style>td {}</style><table><tbody><tr><td>a<table><tr><td>in</td></tr></table>b<TD>c</tbody></table><div id=e>t<div id="f">u</div></div><script>"</b>"'
    walked = P.parsed(spark.createDataFrame([(1, html)], "page_id long, html string"))
    assert [r["cells"] for r in P.table_rows(walked).collect()] == [["a in b", "c"]]
    assert [tuple(r) for r in walked.first()["named"]] == [("f", "u"), ("e", "t u")]


def test_sections_without_a_primary_block(spark):
    pages = spark.createDataFrame([(1, "<section id=a>x</section>"), (2, '<div class="primary"><div><section id="b-c">y<h2>T</h2></section></div></div>')], "page_id long, html string")
    assert [(r["page_id"], r["section_name"], r["section_title"], r["text"]) for r in P.sections(P.parsed(pages)).collect()] == [(2, "b-c", "T", "y")]


def test_timeline_and_background(spark):
    timeline = '<div id="timeline"><h2>x</h2><table><tbody><tr><td><div class="timeline-span phase-12"></div></td></tr><tr><td><div class="phase-3 timeline-span"></div></td></tr><tr><td><div class="phase-99"></div></td></tr></tbody></table><table><tr><td><div class="timeline-span phase-50"></div></td></tr></table></div>'
    rows = [(1, timeline), (2, '<span class="timeline phase-2"></span><div class="timeline-span phase-4"></div>'), (3, "<h2>Other</h2><p>a</p><h2>Background of it</h2><p>b</p>text<div>c</div><span>d</span><h3>e</h3><p>f</p>"), (4, '<div id="mechanism">m <h2>n</h2></div>')]
    walked = P.parsed(spark.createDataFrame(rows, "page_id long, html string"))
    assert {r["page_id"]: (r["blocks"], r["phase_max"]) for r in P.timeline(walked).collect()} == {1: (2, 12), 2: (None, None), 3: (None, None), 4: (None, None)}
    assert [r[0] for r in walked.orderBy("page_id").select(P.background(["mechanism-of-action", "mechanism"], ["mechanism", "background"])).collect()] == [None, None, "b\n\nc", "m n"]


def test_values_in_running_text(spark):
    labels = ["Name", "U.S. FDA Status", "Condition(s)"]
    rows = spark.createDataFrame([(1, "Name: A b  U.S. FDA Status: Phase 2 Condition(s): x, y"), (2, "nothing"), (3, None)], "k int, c string")
    assert [r[0] for r in rows.orderBy("k").select(P.values_in_text(F.col("c"), labels)).collect()] == [{"name": "A b", "u.s. fda status": "Phase 2", "condition(s)": "x, y"}, {}, {}]


def test_limits_are_per_anchor(spark):
    nodes = spark.range(50).select("id", F.format_string("n%02d", "id").alias("label"))
    edges = nodes.select((F.col("id") % 3).alias("source_id"), F.col("id").alias("target_id"))
    g = G.Graph({"N": nodes}, {"E": edges}, {"E": ("N", "N")})
    found = G.hop(g, "E", nodes.filter("id < 3"), limit=5).groupBy("anchor_id").agg(F.count("*").alias("n"), F.min("label").alias("m")).collect()
    assert sorted(map(tuple, found)) == [(k, 5, f"n{k:02d}") for k in range(3)]
    assert G.neighbours(g, nodes.filter("id < 3"), direction="out", limit=4).count() == 12


def test_last_row_of_a_name_wins(spark):
    rows = [(1, "n", "b1", "old", 1), (1, "n", "b2", None, 2), (1, "m", "b2", "x", 3)]
    df = spark.createDataFrame(rows, "k int, name string, b string, d string, o int")
    text = reports.bucketed(df, "k", F.col("b"), F.col("name"), [("d", F.col("d"))], ["o"], ["b2", "b1"], "T").first()["text"]
    assert text == "T\nb2:\n- m (d: x)\n- n\nb1:\n- n"


def test_empty_tables_have_headers(spark, tmp_path):
    S.write_table(spark.createDataFrame([], "id string, label string"), str(tmp_path / "e"), "csv")
    assert spark.read.text(str(tmp_path / "e")).first()[0] == "id,label"
    assert S.read_text_table(spark, str(tmp_path / "e"), ["id", "label", "x"]).count() == 0


def test_csv_and_import(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('id,label\n1,"a\nb ""c"""\n2,\n')
    rows = S.read_text_table(spark, str(path), ["id", "label", "more"]).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("1", 'a\nb "c"', None), ("2", None, None)]
    with pytest.raises(ValueError, match="no column"):
        S.read_text_table(spark, str(path), ["id"], required=["nope"])
    assert S.import_nodes(spark.createDataFrame([(1, "x")], "id int, label string"), "L").columns == ["id:ID(L)", "label"]
    with pytest.raises(ValueError):
        S.import_edges(spark.createDataFrame([(1, 2)], "a int, b int"), "A", "B")
    with pytest.warns(UserWarning):
        assert S.preferred_source(spark, [str(tmp_path / "none")], lambda p: spark.read.parquet(p)) is None


def test_vocabulary(spark, tmp_path):
    path = tmp_path / "v.owl"
    path.write_text("""<rdf:RDF xmlns:rdf="r" xmlns:owl="o" xmlns:rdfs="s" xmlns:oboInOwl="b"><owl:Class rdf:about="http://x/obo/HP_1"><rdfs:label>Ataxia</rdfs:label><oboInOwl:hasExactSynonym>b</oboInOwl:hasExactSynonym><oboInOwl:hasExactSynonym>a</oboInOwl:hasExactSynonym></owl:Class><owl:Class rdf:about="http://x/obo/HP_2"/></rdf:RDF>""")
    assert [tuple(r) for r in S.read_vocabulary(spark, str(path), "hp").collect()] == [("HP:1", "Ataxia", "http://x/obo/HP_1", "a|b", "hp")]


def test_reports_hold_every_name(spark):
    rows = spark.range(1200).select(F.lit(1).alias("k"), F.format_string("n%04d", "id").alias("name"), F.lit("b").alias("b"))
    names = [f"n{k:04d}" for k in range(1200)]
    name = F.col("name")
    assert reports.listed(rows, "k", name, "T").first()["text"].split("\n") == ["T", *(f"- {x}" for x in names)]
    assert reports.listed_pairs(rows, "k", F.col("b"), name, "T").first()["text"] == "T\n- b: " + ", ".join(names)
    assert reports.bucketed(rows, "k", F.col("b"), name, [], ["name"], ["b"], "T").first()["text"].split("\n") == ["T", "b:", *(f"- {x}" for x in names)]
    assert reports.listed(reports.capped(rows, ["k"], ["name"], 2), "k", name, "T").first()["text"] == "T\n- n0000\n- n0001"


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_oracle(spark, name):
    import duckdb

    db = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        db.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    got = queries.queries()[name](spark, DATA)
    want = db.sql(queries.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns

    def key(row):
        return tuple("" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in row)

    assert sorted(key(r) for r in got.select(*(f"`{c}`" for c in columns)).collect()) == sorted(key(r) for r in want.select(*(f'"{c}"' for c in columns)).fetchall())


def test_stream_equals_batch(spark):
    batch = Q.route(Q.classify(spark.read.parquet(f"{DATA}/conversations.parquet").filter("role = 'user'").withColumnRenamed("text", "question"))).select("conv_id", "turn", "intent", "strategy")
    stream = queries.queries()["question_stream"](spark, DATA)
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, batch.collect()))


def test_overview_by_its_name_and_flags_by_id_or_title(spark):
    parts = spark.createDataFrame(
        [(1, "overview-of-trials", "Overview", 1, "Wrong. x"), (1, "overview", "About", 2, "Right. y"), (1, "s2", "Functions", 3, "z"), (2, "overview-of-trials", "T", 1, "no")],
        "page_id long, section_name string, section_title string, section_order int, text string",
    )
    index = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "page_id long, title string")
    rows = {r["page_id"]: r for r in P.entities(index, parts, {"functions": "functions"}, "c").collect()}
    assert [(rows[k]["overview"], rows[k]["functions"]) for k in (1, 2, 3)] == [("Right. y", True), (None, False), (None, False)]


def test_leading_word_goes_whatever_follows(spark):
    texts = ["Background It works. So", "BackgroundIt works.", "Background: It works.", "background", "It works"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", X.summary(F.col("t"), 1, "background").alias("s")).orderBy("k").collect()
    assert [r["s"] for r in rows] == ["It works.", "It works.", ": It works.", None, "It works."]


def test_listed_lines_are_rows(spark):
    """Details of different rows aren't mixed; a blank name is replaced by the id."""
    rows = spark.createDataFrame([(1, 7, "a", "z", None), (1, 8, "a", None, "b"), (1, 8, "a", None, "b"), (1, 9, " ", "q", None)], "k int, id int, n string, x string, y string")
    text = reports.listed(rows, "k", F.col("n"), "T", [("x", F.col("x")), ("y", F.col("y"))], F.col("id")).first()["text"]
    assert text.split("\n") == ["T", "- 9 (x: q)", "- a (y: b)", "- a (x: z)"]


def test_entity_groups_with_any_key_name(spark):
    rows = [(None, 1, "p", "x"), (None, 2, "q", "y"), ("n", 2, " ", None), ("n", 1, "r", "x"), ("n", 0, None, "x"), ("e", 1, None, " ")]
    for key in ("k", "v", "_at", "_c", "g"):
        df = spark.createDataFrame(rows, f"{key} string, o int, a string, b string")
        got = {r[0]: tuple(r[1:]) for r in N.entity_groups(df, key, {"first": F.col("a")}, {"all": F.col("b")}, ["o"]).collect()}
        assert got == {None: ("p", "x | y"), "n": ("r", "x"), "e": (None, "")}


def test_two_patterns_expands_few_middles(spark):
    """The same rows as a full expansion, with equal labels at the limit; only middles of the first labels are expanded."""
    r = random.Random(4)
    nodes = lambda ids, label: spark.createDataFrame([(k, label(k)) for k in ids], "id long, label string")
    near, far = [(k, k % 2) for k in range(60)], [(r.randrange(60), 1000 + r.randrange(9)) for _ in range(150)]
    graph = G.Graph({"M": nodes(range(60), lambda k: f"m{k // 7}"), "A": nodes(range(2), str), "F": nodes(range(1000, 1008), lambda k: f"f{k % 3}")})
    graph.edges = {"NEAR": spark.createDataFrame(near, "source_id long, target_id long"), "FAR": spark.createDataFrame(far, "source_id long, target_id long")}
    graph.ends = {"NEAR": ("M", "A"), "FAR": ("M", "F")}
    order = lambda x: (x["middle_label"], x["far_label"], x["middle_id"], x["far_id"])
    for limit in (1, 10, 40):
        every = [x.asDict() for x in G.two_patterns(graph, "NEAR", "FAR", graph.nodes["A"], None).collect()]
        want = sorted((*order(x), a) for a in (0, 1) for x in sorted((x for x in every if x["anchor_id"] == a), key=order)[:limit])
        got = sorted((*order(x), x["anchor_id"]) for x in G.two_patterns(graph, "NEAR", "FAR", graph.nodes["A"], limit).collect())
        assert got == want
