"""One query for each operator over the given tables, and the SQL that must give the same rows."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import text as X
from .operators import adjacency as A
from .operators import graph as G
from .operators import links as L
from .operators import nodes as N
from .operators import pages as P
from .operators import reports as R
from .operators import routing as Q
from .operators import search as C
from .plans.specs import QUESTIONS, Catalog, NodeSpec
from .sources import tables as S
from .streaming import questions as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


PARTY = NodeSpec("Party", ("kind", "nation", "segment", "iri", "source"))

# Nodes ------------------------------------------------------------------------------------------------------------


@_query("""SELECT 'CUST_' || c_custkey AS id, c_name AS label, 'customer' AS kind, CAST(c_nationkey AS VARCHAR) AS nation, c_mktsegment AS segment,
           CAST(NULL AS VARCHAR) AS iri, 'orders' AS source FROM customer""")
def node_conform_customer(spark, d):
    mapping = {"id": F.concat(F.lit("CUST_"), "c_custkey"), "label": F.col("c_name"), "kind": F.lit("customer"), "nation": F.col("c_nationkey"), "segment": F.col("c_mktsegment"), "source": F.lit("orders")}
    return N.project(_read(spark, d, "customer"), mapping, PARTY.schema)


@_query("""SELECT 'CUST_' || c_custkey AS id, coalesce(nullif(trim(CASE WHEN c_acctbal < 0 THEN ' ' ELSE c_mktsegment END), ''), c_name) AS label, 'customer' AS kind FROM customer
           UNION ALL SELECT 'SUPP_' || s_suppkey, s_name, NULL FROM supplier""")
def node_union_parties(spark, d):
    c, s = _read(spark, d, "customer"), _read(spark, d, "supplier")
    detail = F.when(F.col("c_acctbal") < 0, " ").otherwise(F.col("c_mktsegment"))
    return N.union_nodes(c.select(F.concat(F.lit("CUST_"), "c_custkey").alias("id"), X.first_filled(detail, F.col("c_name")).alias("label"), F.lit("customer").alias("kind")), s.select(F.concat(F.lit("SUPP_"), "s_suppkey").alias("id"), F.col("s_name").alias("label")))


@_query("""WITH t AS (SELECT p_partkey, p_type, unnest(string_split(p_name, ' ')) AS label, unnest(range(0, len(string_split(p_name, ' ')))) AS pos FROM part),
                k AS (SELECT *, 'MECH_' || upper(regexp_replace(label, '\\W+', '_', 'g')) AS id FROM t WHERE label <> ''),
                f AS (SELECT id, lower(p_type) AS c, min((p_partkey, pos)) AS o FROM k GROUP BY ALL)
           SELECT f.id, l.label, string_agg(c, ' | ' ORDER BY o) AS category FROM f JOIN (SELECT id, arg_min(label, (p_partkey, pos)) AS label FROM k GROUP BY id) l ON l.id = f.id GROUP BY ALL""")
def node_category_from_list(spark, d):
    return N.category_nodes(_read(spark, d, "part"), F.col("p_name"), F.col("p_type"), F.col("p_partkey"), "MECH_", " ")


@_query("""WITH t AS (SELECT p_partkey, 0 AS tab, unnest(string_split(p_name, ' ')) AS label, unnest(range(0, len(string_split(p_name, ' ')))) AS pos FROM part
                UNION ALL SELECT p_partkey, 1, p_type, 0 FROM part UNION ALL SELECT c_custkey, 2, c_mktsegment, 0 FROM customer),
                k AS (SELECT *, 'MECH_' || upper(regexp_replace(label, '\\W+', '_', 'g')) AS id FROM t WHERE label <> ''),
                f AS (SELECT id, arg_min(label, (tab, p_partkey, pos)) AS label FROM k GROUP BY id), o AS (SELECT DISTINCT id, tab FROM k)
           SELECT f.id, f.label, lower(f.label) AS category, CAST(NULL AS VARCHAR) AS description, (SELECT string_agg(['names','types','segments'][1 + tab], '|' ORDER BY tab) FROM o WHERE o.id = f.id) AS source, f.label AS raw_source_ids FROM f""")
def node_list_sources(spark, d):
    p, c = _read(spark, d, "part"), _read(spark, d, "customer")
    tables = [(p, F.col("p_name"), F.col("p_partkey"), "names"), (p, F.col("p_type"), F.col("p_partkey"), "types"), (c, F.col("c_mktsegment"), F.col("c_custkey"), "segments")]
    return N.list_nodes(tables, "MECH_", " ")


@_query("""WITH r AS (SELECT c_nationkey, o_orderkey, CASE WHEN o_totalprice > 300000 THEN c_name END AS big, o_orderpriority, o_orderstatus, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey),
                p AS (SELECT c_nationkey, o_orderpriority AS v, min(o_orderkey) AS o FROM r GROUP BY ALL), q AS (SELECT c_nationkey, o_orderstatus AS v, min(o_orderkey) AS o FROM r GROUP BY ALL), m AS (SELECT c_nationkey, c_mktsegment AS v, min(o_orderkey) AS o FROM r GROUP BY ALL)
           SELECT r.c_nationkey, arg_min(big, o_orderkey) FILTER (big IS NOT NULL) AS big, (SELECT string_agg(v, ' | ' ORDER BY o) FROM p WHERE p.c_nationkey = r.c_nationkey) AS priorities,
             (SELECT string_agg(v, ' | ' ORDER BY o) FROM q WHERE q.c_nationkey = r.c_nationkey) AS statuses, (SELECT string_agg(v, ' | ' ORDER BY o) FROM m WHERE m.c_nationkey = r.c_nationkey) AS segments FROM r GROUP BY r.c_nationkey""")
def node_entity_groups(spark, d):
    rows = _read(spark, d, "orders").join(_read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    joined = {"priorities": F.col("o_orderpriority"), "statuses": F.col("o_orderstatus"), "segments": F.col("c_mktsegment")}
    return N.entity_groups(rows, "c_nationkey", {"big": F.when(F.col("o_totalprice") > 300000, F.col("c_name"))}, joined, ["o_orderkey"])


@_query("""SELECT 'COMP_' || upper(regexp_replace(p_brand, '\\W+', '_', 'g')) AS id, arg_min(p_brand, p_partkey) AS label, string_agg(CAST(p_partkey AS VARCHAR), '|' ORDER BY p_partkey) AS raw_source_ids FROM part GROUP BY 1""")
def node_contributor_ids(spark, d):
    return N.contributor_nodes(_read(spark, d, "part"), F.col("p_brand"), F.col("p_partkey"), F.col("p_partkey"), "COMP_")


@_query("SELECT DISTINCT 'TT_' || upper(trim(regexp_replace(o_orderpriority, '\\W+', '_', 'g'), '_')) AS id, o_orderpriority AS label FROM orders")
def node_distinct_values(spark, d):
    return N.value_nodes(_read(spark, d, "orders"), F.col("o_orderpriority"), "TT_")


@_query("""SELECT l_orderkey, l_partkey, l_linenumber, 'TRIAL_' || l_orderkey || '_' || (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1) AS id FROM lineitem""")
def node_surrogate_id(spark, d):
    rows = N.numbered(_read(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "TRIAL")
    return rows.select("l_orderkey", "l_partkey", "l_linenumber", "id")


@_query("""WITH p AS (SELECT p_brand, p_partkey, CASE WHEN p_size > 40 THEN p_name END AS big, CASE WHEN p_type = 'PROMO' THEN p_name END AS promo, CASE WHEN p_size < 3 THEN p_size END AS tiny FROM part)
           SELECT p_brand, arg_min(big, p_partkey) FILTER (big IS NOT NULL) AS big, arg_min(promo, p_partkey) FILTER (promo IS NOT NULL) AS promo, arg_min(tiny, p_partkey) FILTER (tiny IS NOT NULL) AS tiny FROM p GROUP BY p_brand""")
def group_first_nonnull(spark, d):
    p = _read(spark, d, "part").select("p_brand", "p_partkey", F.when(F.col("p_size") > 40, F.col("p_name")).alias("big"), F.when(F.col("p_type") == "PROMO", F.col("p_name")).alias("promo"), F.when(F.col("p_size") < 3, F.col("p_size")).alias("tiny"))
    return N.first_filled_per_group(p, ["p_brand"], ["big", "promo", "tiny"], ["p_partkey"])


@_query("SELECT p_brand, p_type, arg_min(p_partkey, (p_size, p_partkey)) AS p_partkey, arg_min(p_name, (p_size, p_partkey)) AS p_name FROM part GROUP BY ALL")
def first_row_per_key(spark, d):
    p = _read(spark, d, "part").select("p_brand", "p_type", "p_partkey", "p_name", "p_size")
    return N.first_per_key(p, ["p_brand", "p_type"], ["p_size", "p_partkey"]).drop("p_size")


@_query("""WITH r AS (SELECT c_nationkey, o_orderpriority, min((o_orderdate, o_orderkey)) AS o FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
           SELECT c_nationkey, string_agg(o_orderpriority, ' | ' ORDER BY o) AS priorities FROM r GROUP BY 1""")
def distinct_join(spark, d):
    rows = _read(spark, d, "orders").join(_read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return N.distinct_join(rows, ["c_nationkey"], X.clean(F.col("o_orderpriority")), F.struct("o_orderdate", "o_orderkey"), "priorities")


@_query("SELECT p_partkey, p_name FROM part WHERE lower(p_type) IN (SELECT DISTINCT lower(p_type) FROM part WHERE p_partkey < 3)")
def allow_list_exact(spark, d):
    p = _read(spark, d, "part")
    return N.allow_exact(p, F.col("p_type"), p.filter("p_partkey < 3"), "p_type").select("p_partkey", "p_name")


@_query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_name), 'old b')")
def allow_list_fragment(spark, d):
    return N.allow_fragment(_read(spark, d, "part"), F.col("p_name"), ["Ring", "old b"]).select("p_partkey", "p_name")


@_query("""SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey % 30 = 7 AND contains(c_name, right(CAST(o_orderkey AS VARCHAR), 3)))""")
def allow_fragment_table(spark, d):
    """Customers whose name contains the last three digits of an order's key."""
    fragments = _read(spark, d, "orders").filter("o_orderkey % 30 = 7").select(F.expr("right(cast(o_orderkey as string), 3)").alias("fragment"))
    return C.allow_fragments(_read(spark, d, "customer"), F.col("c_name"), fragments, "fragment").select("c_custkey", "c_name")


_INDEX = """i AS (SELECT DISTINCT term, p_partkey, p_size FROM (SELECT p_partkey, p_size, unnest([lower(p_name), lower(p_type || ' ' || p_brand)] || string_split(lower(p_name), ' ')) AS term FROM part)),
   o AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY p_size, p_partkey) - 1 AS place FROM i),
   g AS (SELECT term, count(*) AS n, arg_min(p_partkey, place) AS first_id FROM o GROUP BY term)"""


def _terms(spark, d):
    """Ids in the order of p_size and the id, in lists of 64."""
    terms = [F.col("p_name"), F.concat_ws("  ", "p_type", "p_brand")]
    return N.term_index(_read(spark, d, "part"), "p_partkey", terms, [F.split("p_name", " ")], order=F.col("p_size"), size=64)


@_query(f"WITH {_INDEX} SELECT term, CAST(place // 64 AS INT) AS part, count(*) AS n, string_agg(p_partkey, ',' ORDER BY place) AS ids FROM o GROUP BY ALL")
def term_index(spark, d):
    return _terms(spark, d).select("term", "part", F.size("ids").cast("long").alias("n"), F.array_join("ids", ",").alias("ids"))


@_query(f"WITH {_INDEX} SELECT p_partkey, coalesce(n, 0) AS n, first_id FROM part LEFT JOIN g ON term = CASE WHEN p_size % 5 = 0 THEN 'no ' ELSE '' END || lower(p_name)")
def term_lookup(spark, d):
    asked = F.concat(F.when(F.col("p_size") % 5 == 0, " No ").otherwise(" "), F.upper("p_name"))
    found = N.term_lookup(_read(spark, d, "part").select("p_partkey", "p_name", "p_size"), asked, _terms(spark, d))
    return found.groupBy("p_partkey").agg(F.sum(F.size("ids")).alias("n"), F.min_by(F.get("ids", F.lit(0)), "part").alias("first_id"))


@_query(f"WITH {_INDEX} SELECT p_partkey FROM part WHERE CASE WHEN p_size % 5 = 0 THEN 'no ' ELSE '' END || lower(p_name) IN (SELECT term FROM i)")
def term_known(spark, d):
    asked = F.concat(F.when(F.col("p_size") % 5 == 0, "no ").otherwise(""), "p_name")
    return N.known_terms(_read(spark, d, "part").select("p_partkey", "p_name", "p_size"), asked, _terms(spark, d)).select("p_partkey")


@_query("""WITH m AS (SELECT p_type || '' AS term, min(p_brand) AS code FROM part WHERE p_size = 7 GROUP BY 1 UNION ALL SELECT p_name, min(p_brand) FROM part WHERE p_size = 9 GROUP BY 1),
                k AS (SELECT lower(term) AS term, min(code) AS code FROM m GROUP BY 1),
                t AS (SELECT p_partkey, 0 AS pos, lower(p_name) AS term FROM part UNION ALL SELECT p_partkey, 1, lower(p_type) FROM part UNION ALL SELECT p_partkey, 2, lower(p_brand) FROM part),
                b AS (SELECT p_partkey, arg_min(code, pos) AS code FROM t JOIN k USING (term) GROUP BY 1)
           SELECT p_partkey, p_name, code FROM part LEFT JOIN b USING (p_partkey)""")
def priority_mapping(spark, d):
    p = _read(spark, d, "part")
    m = p.filter("p_size = 7").select(F.col("p_type").alias("term"), "p_brand").union(p.filter("p_size = 9").select("p_name", "p_brand")).groupBy("term").agg(F.min("p_brand").alias("code"))
    return N.priority_mapping(p, "p_partkey", F.col("p_name"), F.array("p_type", "p_brand"), m, "term", "code").select("p_partkey", "p_name", "code")


# Links ------------------------------------------------------------------------------------------------------------


@_query("SELECT o_custkey AS source_id, o_orderkey AS target_id, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def edge_semi_known(spark, d):
    known = L.known_only(_read(spark, d, "orders"), "o_custkey", _read(spark, d, "customer").filter("c_acctbal > 5000"), "c_custkey")
    return known.select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("target_id"), "o_totalprice")


@_query("SELECT n_name AS source_id, s_name AS target_id FROM nation JOIN supplier ON s_nationkey = n_nationkey")
def edge_one_to_many(spark, d):
    n = _read(spark, d, "nation").select(F.col("n_name").alias("id"), F.concat(F.lit(" KEY "), F.col("n_nationkey").cast("string"), F.lit(" ")).alias("symbol"))
    s = _read(spark, d, "supplier").select(F.col("s_name").alias("id"), F.concat(F.lit("key "), F.col("s_nationkey").cast("string")).alias("symbol"))
    return L.one_to_many(n, F.col("symbol"), s, F.col("symbol"))


@_query("""WITH t AS (SELECT p_partkey AS target_row, lower(CASE p_partkey % 3 WHEN 0 THEN p_brand || ' ' || p_size || ' ' || p_type WHEN 1 THEN p_name ELSE p_type END) AS k FROM part),
                keys AS (SELECT lower(p_brand || ' ' || p_size || ' ' || p_type) AS k, p_partkey AS id FROM part UNION SELECT lower(p_name), max(p_partkey) FROM part GROUP BY 1 UNION SELECT lower(p_type), min(p_partkey) FROM part GROUP BY 1)
           SELECT DISTINCT target_row, id FROM t JOIN keys USING (k)""")
def edge_multi_key(spark, d):
    p = _read(spark, d, "part")
    symbol = F.concat_ws(" ", "p_brand", "p_size", "p_type")
    name = F.when(F.col("p_partkey") % 3 == 0, symbol).when(F.col("p_partkey") % 3 == 1, F.col("p_name")).otherwise(F.col("p_type"))
    nodes = p.withColumn("id", F.col("p_partkey"))
    return L.multi_key(p.withColumn("target_row", F.col("p_partkey")), "target_row", name, nodes, symbol, F.col("p_name"), F.array("p_type"), F.col("p_partkey"))


@_query("""WITH a AS (SELECT DISTINCT p_partkey, unnest(regexp_split_to_array(lower(p_name), '[\\s-]+')) AS t FROM part), l AS (SELECT DISTINCT p_name FROM part),
                b AS (SELECT DISTINCT p_name AS label, unnest(regexp_split_to_array(lower(p_name), '[\\s-]+')) AS t FROM l)
           SELECT DISTINCT p_partkey, label FROM a JOIN b USING (t)""")
def edge_token_overlap(spark, d):
    p = _read(spark, d, "part")
    labels = p.select(F.col("p_name").alias("label")).distinct()
    return L.token_overlap(p, "p_partkey", F.col("p_name"), labels, "label", F.col("label"))


@_query("SELECT 2 AS source_id, c_custkey AS target_id, c_name FROM customer WHERE (SELECT count(*) FROM region WHERE lower(r_name) = 'asia') > 0")
def edge_anchor_cross(spark, d):
    r = _read(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("label"), F.lit("list").alias("source"))
    return L.to_anchor(_read(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", L.anchor(r, "Asia", "list"))


@_query("""SELECT p_partkey AS source_id, (SELECT r_regionkey FROM region WHERE r_name = 'EUROPE') AS target_id, p_name FROM part
           WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) AND (contains(p_name, 'red') OR contains(p_name, 'gizmo'))""")
def edge_text_anchor(spark, d):
    p = L.known_only(_read(spark, d, "part"), "p_partkey", _read(spark, d, "lineitem").filter("l_quantity > 49"), "l_partkey")
    r = _read(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("label"), F.lit("list").alias("source"))
    return L.to_anchor(L.mentioning(p, F.col("p_name"), ["red", "gizmo"]).select("p_partkey", "p_name"), "p_partkey", L.anchor(r, "europe"), outward=False)


@_query("SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def enrich_left(spark, d):
    return L.enrich(_read(spark, d, "documents").select("doc_id", "lang"), _read(spark, d, "labels"), "doc_id")


# Rules and text ---------------------------------------------------------------------------------------------------


@_query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN e IS NULL OR isnan(e) THEN 'no_change' WHEN e > 1 THEN 'increased' WHEN e < 1 THEN 'decreased' ELSE 'no_change' END AS direction
           FROM (SELECT *, CASE WHEN l_quantity = 7 THEN NULL WHEN l_quantity = 8 THEN CAST('nan' AS DOUBLE) ELSE (1 + l_tax) * (1 + l_discount) / 1.05 END AS e FROM lineitem)""")
def direction_rule(spark, d):
    effect = F.when(F.col("l_quantity") == 8, F.lit(float("nan"))).when(F.col("l_quantity") != 7, (1 + F.col("l_tax")) * (1 + F.col("l_discount")) / 1.05)
    return _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", X.effect_direction(effect).alias("direction"))


_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'Discontinued in ' WHEN 'O' THEN 'Ongoing ' ELSE 'Recruiting ' END || CASE WHEN o_orderkey % 11 = 0 THEN 'Approved' ELSE 'Phase ' || substr(o_orderpriority, 1, 1) || '/phase' || (o_orderkey % 4) END"


def _status(spark, d):
    o = _read(spark, d, "orders")
    first = F.when(F.col("o_orderstatus") == "F", "Discontinued in ").when(F.col("o_orderstatus") == "O", "Ongoing ").otherwise("Recruiting ")
    second = F.when(F.col("o_orderkey") % 11 == 0, F.lit("Approved")).otherwise(F.concat(F.lit("Phase "), F.substring("o_orderpriority", 1, 1), F.lit("/phase"), (F.col("o_orderkey") % 4).cast("string")))
    return o.withColumn("status", F.concat(first, second))


@_query(f"""WITH s AS (SELECT o_orderkey, lower({_STATUS}) AS s, substr(o_orderpriority, 1, 1) AS ph, o_orderkey % 13 = 0 AS has3 FROM orders)
           SELECT o_orderkey, CASE WHEN contains(s, 'approved') THEN 'Approved or marketed' WHEN has3 THEN 'Phase 3 trials' WHEN CAST(ph AS DOUBLE) >= 3 THEN 'Phase 3 trials'
             WHEN contains(s, 'ongoing') OR contains(s, 'recruiting') THEN 'Ongoing Phase 1–2 trials' WHEN contains(s, 'discontinue') THEN 'Discontinued or terminated' ELSE 'Status unclear / other' END AS bucket FROM s""")
def status_bucket(spark, d):
    bucket = X.development_bucket(F.col("status"), F.col("status"), F.substring("o_orderpriority", 1, 1), F.col("o_orderkey") % 13 == 0)
    return _status(spark, d).select("o_orderkey", bucket.alias("bucket"))


@_query(f"""WITH s AS (SELECT o_orderkey, lower({_STATUS}) AS s FROM orders), p AS (SELECT *, list_max(list_transform(regexp_extract_all(s, 'phase\\s*(\\d)', 1), lambda x: CAST(x AS INT))) AS phase_max FROM s)
           SELECT o_orderkey, phase_max, CASE WHEN contains(s, 'approved') THEN 'approved' WHEN contains(s, 'discontinued') THEN 'discontinued' WHEN phase_max IS NOT NULL THEN 'ongoing' ELSE 'unknown' END AS status FROM p""")
def phase_status(spark, d):
    return _status(spark, d).select("o_orderkey", X.phase_max(F.col("status")).alias("phase_max"), X.phase_status(F.col("status")).alias("status"))


@_query("""WITH c AS (SELECT doc_id, trim(regexp_replace(text, '[\\s\\x{00A0}]+', ' ', 'g')) AS t FROM documents), p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(t, '\\.(\\s+|$)'), lambda x: trim(x)), lambda x: x <> '') AS s FROM c)
           SELECT doc_id, CASE WHEN len(s) > 0 THEN array_to_string(s[1:2], '. ') || '.' END AS summary FROM p""")
def summary_sentences(spark, d):
    return _read(spark, d, "documents").select("doc_id", X.summary(F.col("text"), 2).alias("summary"))


@_query("""WITH t AS (SELECT doc_id, regexp_extract(text, '([-+<.0-9]*[0-9][-.0-9eE]*)', 1) AS raw FROM documents), r AS (SELECT doc_id, trim(raw) AS raw, trim(regexp_replace(trim(raw), '^<', '')) AS x FROM t)
           SELECT doc_id, raw, CASE WHEN regexp_full_match(raw, '[+-]?[0-9]{1,18}') THEN CAST(raw AS BIGINT) END AS whole, CASE WHEN regexp_full_match(x, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(x AS DOUBLE) END AS number FROM r""")
def numeric_tolerant(spark, d):
    raw = _read(spark, d, "documents").select("doc_id", F.trim(F.regexp_extract("text", r"([-+<.0-9]*[0-9][-.0-9eE]*)", 1)).alias("raw"))
    return raw.select("doc_id", "raw", X.tolerant_int(F.col("raw")).alias("whole"), X.tolerant_double(F.col("raw")).alias("number"))


@_query("""SELECT p_partkey, regexp_replace(lower(p_name || '_' || p_type), '[^a-z0-9]+', '_', 'g') AS measure, p_name AS core, p_type AS qualifier, 'PART:' || p_partkey || '_X' AS curie, p_name || '|' || p_brand AS packed, len(string_split(p_name, ' ')) AS n FROM part""")
def text_keys(spark, d):
    label = F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))
    iri = F.concat(F.lit("http://example.org/obo/PART_"), F.col("p_partkey").cast("string"), F.lit("_X"))
    return _read(spark, d, "part").select("p_partkey", X.measure_key(label).alias("measure"), X.core_part(label).alias("core"), X.qualifier(label).alias("qualifier"), X.curie(iri).alias("curie"), X.pack(F.col("p_name"), F.lit(" "), F.col("p_brand")).alias("packed"), F.size(X.packed_list(F.col("p_name"), " ")).cast("long").alias("n"))


@_query("""WITH t AS (SELECT p_partkey, lower(p_name) AS n, CASE p_size % 4 WHEN 0 THEN 'CSF ' WHEN 1 THEN 'Serum' WHEN 2 THEN NULL ELSE p_type END AS f, ['Aβ', 'p-Tau ', 'NfL', 'YKL-', ''][1 + p_size % 5] AS a FROM part)
           SELECT p_partkey, CASE p_partkey % 1 WHEN 0 THEN CASE WHEN lower(a) = 'aβ' THEN 'amyloid' WHEN contains(n, 'tau') OR lower(a) = 'p-tau ' THEN 'tau' WHEN contains(n, 'nfl') OR lower(a) = 'nfl' THEN 'neurodegeneration'
             WHEN contains(n, 'trem') OR lower(a) = 'ykl-' THEN 'inflammation' ELSE 'other' END END AS analyte_class, CASE WHEN contains(lower(f), 'csf') THEN 'CSF' WHEN contains(lower(f), 'serum') OR contains(lower(f), 'plasma') THEN 'Plasma/Serum' ELSE 'Other/unspecified' END AS fluid FROM t""")
def text_rules(spark, d):
    p = _read(spark, d, "part")
    size = lambda n: (F.col("p_size") % n).cast("int")
    name = F.concat(F.get(F.array(*map(F.lit, ("Aβ", "p-Tau ", "NfL", "YKL-", ""))), size(5)), F.col("p_name"))
    fluid = F.when(size(4) == 0, F.lit("CSF ")).when(size(4) == 1, F.lit("Serum")).when(size(4) == 3, F.col("p_type"))
    return p.select("p_partkey", X.analyte_class(name).alias("analyte_class"), X.fluid_bucket(fluid).alias("fluid"))


# Graph ------------------------------------------------------------------------------------------------------------


def trade_graph(spark: SparkSession, d: str) -> G.Graph:
    """Customers PLACED orders, orders CONTAIN parts; nations are IN regions."""
    c, o, p, li, n, r = (_read(spark, d, t) for t in ("customer", "orders", "part", "lineitem", "nation", "region"))
    return G.Graph(
        nodes={
            "Customer": c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label"), F.col("c_mktsegment").alias("segment")),
            "Order": o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("label"), F.col("o_orderstatus").alias("status")),
            "Part": p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.col("p_brand").alias("brand")),
            "Nation": n.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("label")),
            "Region": r.select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("label")),
        },
        edges={
            "PLACED": o.select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("target_id"), F.col("o_totalprice").alias("total")),
            "CONTAINS": li.select(F.col("l_orderkey").alias("source_id"), F.col("l_partkey").alias("target_id")),
            "IN_REGION": n.select(F.col("n_nationkey").cast("long").alias("source_id"), F.col("n_regionkey").cast("long").alias("target_id")),
        },
        ends={"PLACED": ("Customer", "Order"), "CONTAINS": ("Order", "Part"), "IN_REGION": ("Nation", "Region")},
    )


@_query("""SELECT anchor_id, edge_total, id, label, status FROM (SELECT o_custkey AS anchor_id, o_totalprice AS edge_total, o_orderkey AS id, 'Order ' || o_orderkey AS label, o_orderstatus AS status,
             row_number() OVER (PARTITION BY o_custkey ORDER BY 'Order ' || o_orderkey, o_orderkey) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')) WHERE n <= 200""")
def hop_out(spark, d):
    g = trade_graph(spark, d)
    return G.hop(g, "PLACED", g.nodes["Customer"].filter("segment = 'BUILDING'"))


@_query("""SELECT DISTINCT p_partkey AS anchor_id, l_orderkey AS id, 'Order ' || l_orderkey AS label, o_orderstatus AS status, count(*) OVER (PARTITION BY p_partkey, l_orderkey) AS n
           FROM part JOIN lineitem ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey""")
def hop_in(spark, d):
    g = trade_graph(spark, d)
    for label in ("Order", "Part"):
        g.nodes[label] = G.dealt(g.nodes[label], g.edges["CONTAINS"])
    return G.hop(g, "CONTAINS", g.nodes["Part"], outward=False, limit=None).groupBy("anchor_id", "id", "label", "status").agg(F.count("*").alias("n"))


@_query("""SELECT anchor_id, middle_id, middle_label, far_id, far_label FROM (SELECT n_regionkey AS anchor_id, o.o_orderkey AS middle_id, 'Order ' || o.o_orderkey AS middle_label, p_partkey AS far_id, p_name AS far_label,
             row_number() OVER (PARTITION BY n_regionkey ORDER BY 'Order ' || o.o_orderkey, p_name, o.o_orderkey, p_partkey) AS n FROM (SELECT CAST(o_orderkey % 5 AS BIGINT) AS n_regionkey, o_orderkey FROM orders) o
           JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey ) WHERE n <= 300""")
def hop_two(spark, d):
    g = trade_graph(spark, d)
    g.edges["BOUND_FOR"] = g.nodes["Order"].select(F.col("id").alias("source_id"), (F.col("id") % 5).alias("target_id"))
    g.ends["BOUND_FOR"] = ("Order", "Region")
    return G.two_patterns(g, "BOUND_FOR", "CONTAINS", g.nodes["Region"])


@_query(SQL["hop_out"])
def stored_hop(spark, d):
    """hop_out over edges stored by either end: the anchors move to the edges."""
    g = trade_graph(spark, d)
    return G.hop(A.store_graph(g, ["PLACED"]), "PLACED", g.nodes["Customer"].filter("segment = 'BUILDING'"))


@_query("""SELECT CAST(p_partkey AS VARCHAR) AS anchor_id, 'CONTAINS' AS type, 'in' AS direction, 'Order ' || l_orderkey AS neighbour_label, CAST(l_orderkey AS VARCHAR) AS neighbour_id,
             '{"id":' || o_orderkey || ',"label":"Order ' || o_orderkey || '","status":"' || o_orderstatus || '"}' AS properties, '{}' AS edge_properties FROM part JOIN lineitem ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey""")
def stored_neighbors(spark, d):
    """The orders of each part, over edges stored by either end."""
    g = trade_graph(spark, d)
    return G.neighbours(A.store_graph(g, ["CONTAINS"]), g.nodes["Part"], ["CONTAINS"], "in", limit=None)


@_query("SELECT o_custkey AS source_id, c_name AS source_label, o_orderkey AS target_id, 'Order ' || o_orderkey AS target_label FROM orders JOIN customer ON c_custkey = o_custkey")
def edge_scan(spark, d):
    return G.edge_scan(trade_graph(spark, d), "PLACED", limit=None)


@_query("""SELECT CAST(o_orderkey AS VARCHAR) AS anchor_id, 'PLACED' AS type, 'in' AS direction, c_name AS neighbour_label, CAST(c_custkey AS VARCHAR) AS neighbour_id,
             '{"id":' || c_custkey || ',"label":"' || c_name || '","segment":"' || c_mktsegment || '"}' AS properties, '{"status":"' || o_orderstatus || '"}' AS edge_properties FROM orders JOIN customer ON c_custkey = o_custkey
           UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'CONTAINS', 'out', p_name, CAST(p_partkey AS VARCHAR), '{"id":' || p_partkey || ',"label":"' || p_name || '","brand":"' || p_brand || '"}', '{"line":' || l_linenumber || '}'
             FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey""")
def neighbors(spark, d):
    """Both ways: what each order contains and who placed it, with the properties of the node and of the edge."""
    g = trade_graph(spark, d)
    edges = {"PLACED": _read(spark, d, "orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("target_id"), F.col("o_orderstatus").alias("status"))}
    edges["CONTAINS"] = _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.col("l_partkey").alias("target_id"), F.col("l_linenumber").alias("line"))
    own = G.Graph(g.nodes, edges, g.ends)
    orders = g.nodes["Order"]
    return G.neighbours(own, orders, ["CONTAINS"], "out", limit=None).unionByName(G.neighbours(own, orders, ["PLACED"], "in", limit=None))


@_query("""SELECT * FROM (SELECT p_partkey AS id, p_name AS label, p_brand AS brand, 'search' AS how FROM part WHERE contains(lower(p_name), 'ring') ORDER BY p_partkey LIMIT 1)
           UNION ALL SELECT p_partkey, p_name, p_brand, 'fallback' FROM part WHERE p_partkey = 7 UNION ALL SELECT p_partkey, p_name, p_brand, 'lookup' FROM part WHERE p_partkey = 3""")
def node_search(spark, d):
    g = trade_graph(spark, d)
    parts = g.nodes["Part"]
    return G.search(parts, "Ring").withColumn("how", F.lit("search")).unionByName(G.search(parts, "atlantis", fallback=7).withColumn("how", F.lit("fallback"))).unionByName(G.lookup(g, "Part", 3).withColumn("how", F.lit("lookup")))


_ASKED = "CASE WHEN p_partkey % 7 = 0 THEN 'zq' || p_name WHEN p_partkey % 11 = 0 THEN substr(p_name, 2, 2) ELSE upper(substr(p_name, CAST(1 + p_partkey % 4 AS INT), CAST(4 + p_partkey % 9 AS INT))) END"


@_query(f"""WITH q AS (SELECT p_partkey, {_ASKED} AS question FROM part), u AS (SELECT DISTINCT lower(question) AS t FROM q),
                m AS (SELECT t, arg_min(p_partkey, (p_size <= 25, p_partkey)) AS id FROM u JOIN part ON contains(lower(p_name), t) OR contains(lower(p_type), t) GROUP BY t)
           SELECT p_partkey, question, coalesce(id, 7) AS node_id, CASE WHEN id IS NULL THEN 'fallback' ELSE 'search' END AS match FROM q LEFT JOIN m ON t = lower(question)""")
def node_search_table(spark, d):
    """A node for each of a table of texts: pieces of names of different lengths, and some that no name has."""
    p = _read(spark, d, "part")
    nodes = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.col("p_type").alias("synonyms"), "p_size")
    return C.search_texts(nodes, p.select("p_partkey", F.expr(_ASKED).alias("question")), "question", fallback=7, preferred=F.col("p_size") > 25)


# Reports ----------------------------------------------------------------------------------------------------------

_BUCKETS = ["Approved or marketed", "Phase 3 trials", "Ongoing Phase 1–2 trials", "Ongoing (phase unknown)", "Discontinued or terminated", "Status unclear / other"]


def _of_asked(rows, key, anchors):
    """The rows of the nations that are asked for (all without anchors), so that joins and aggregates behind see no others."""
    return rows if anchors is None else L.known_only(rows, key, anchors, "c_nationkey")


def _orders_by_nation(spark, d, anchors=None):
    customers = _of_asked(_read(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), "c_nationkey", anchors)
    return _status(spark, d).join(customers, F.col("o_custkey") == F.col("c_custkey"))


def _report_status(spark, d, anchors=None):
    bucket = X.development_bucket(F.col("status"), F.col("status"), F.substring("o_orderpriority", 1, 1), F.lit(False))
    name = F.concat("o_orderpriority", F.lit(" of "), "c_mktsegment")
    return R.bucketed(_orders_by_nation(spark, d, anchors), "c_nationkey", bucket, name, [("", F.col("o_orderstatus")), ("last status", F.col("status"))], ["o_orderkey"], _BUCKETS, "Orders by stage")


_REPORT_STATUS = f"""rs AS (SELECT c_nationkey, o_orderkey, o_orderstatus, o_orderpriority, o_orderpriority || ' of ' || c_mktsegment AS name, {_STATUS} AS status FROM orders JOIN customer ON c_custkey = o_custkey),
   b AS (SELECT *, CASE WHEN contains(status, 'Approved') THEN 1 WHEN CAST(substr(o_orderpriority, 1, 1) AS INT) >= 3 THEN 2 WHEN contains(status, 'Ongoing') OR contains(status, 'Recruiting') THEN 3 WHEN contains(status, 'Discontinue') THEN 5 ELSE 6 END AS place FROM rs),
   last AS (SELECT c_nationkey, name, arg_max(o_orderstatus || '; last status: ' || status, o_orderkey) AS meta FROM b GROUP BY ALL),
   l AS (SELECT c_nationkey, place, string_agg('- ' || name || ' (' || meta || ')', chr(10) ORDER BY name) AS lines FROM (SELECT DISTINCT c_nationkey, place, name FROM b) JOIN last USING (c_nationkey, name) GROUP BY ALL),
   r1 AS (SELECT c_nationkey, 'Orders by stage' || chr(10) || string_agg(['Approved or marketed','Phase 3 trials','Ongoing Phase 1–2 trials','Ongoing (phase unknown)','Discontinued or terminated','Status unclear / other'][place] || ':' || chr(10) || lines, chr(10) ORDER BY place) AS text FROM l GROUP BY 1)"""


@_query(f"WITH {_REPORT_STATUS} SELECT c_nationkey, text FROM r1")
def report_bucketed(spark, d):
    return _report_status(spark, d)


_SECONDS = {"decreased": "Lower", "increased": "Higher", "no_change": "No clear change"}


def _lines_by_nation(spark, d, anchors=None):
    """Lines with their part and the supplier's nation; the suppliers come first, as they leave the fewest lines."""
    suppliers = _of_asked(_read(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("c_nationkey")), "c_nationkey", anchors)
    rows = _read(spark, d, "lineitem").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.join(_read(spark, d, "part").select("p_partkey", "p_type", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))


def _report_two_level(spark, d, anchors=None):
    """Per supplier's nation: line flags, then directions, then part types with their first brand and order."""
    rows = _lines_by_nation(spark, d, anchors)
    raw = F.when(F.col("l_discount") > F.col("l_tax"), "Higher").when(F.col("l_discount") < F.col("l_tax"), "lowered, decrease").otherwise("no real change")
    details = [("", F.when(F.col("l_linenumber") > 1, F.col("p_brand"))), ("first order", F.col("l_orderkey"))]
    return R.two_level(rows, "c_nationkey", F.col("l_returnflag"), X.direction(raw), F.col("p_type"), details, ["l_orderkey", "l_linenumber", "p_brand", "l_partkey"], ["A", "R"], _SECONDS, "Lines by flag and direction")


_REPORT_TWO_LEVEL = """t AS (SELECT s_nationkey AS c_nationkey, l_returnflag AS r, CASE WHEN l_discount > l_tax THEN 2 WHEN l_discount < l_tax THEN 1 ELSE 3 END AS dir, p_type, l_orderkey, CASE WHEN l_linenumber > 1 THEN p_brand END AS brand, (l_orderkey, l_linenumber, p_brand, l_partkey) AS o
     FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag IN ('A', 'R')),
   t1 AS (SELECT c_nationkey, r, dir, p_type, min(l_orderkey) AS f, arg_min(brand, o) FILTER (brand IS NOT NULL) AS fb FROM t GROUP BY ALL),
   t2 AS (SELECT c_nationkey, r, dir, '- ' || ['Lower','Higher','No clear change'][dir] || ':' || chr(10) || string_agg('  - ' || p_type || ' (' || coalesce(fb || '; ', '') || 'first order: ' || f || ')', chr(10) ORDER BY p_type) AS lines FROM t1 GROUP BY c_nationkey, r, dir),
   t3 AS (SELECT c_nationkey, r, r || chr(10) || string_agg(lines, chr(10) ORDER BY dir) AS lines FROM t2 GROUP BY c_nationkey, r),
   r0 AS (SELECT c_nationkey, 'Lines by flag and direction' || chr(10) || string_agg(lines, chr(10) || chr(10) ORDER BY r) AS text FROM t3 GROUP BY 1)"""


@_query(f"WITH {_REPORT_TWO_LEVEL} SELECT c_nationkey, text FROM r0")
def report_grouped(spark, d):
    return _report_two_level(spark, d)


@_query("""WITH n AS (SELECT DISTINCT p_brand, CASE WHEN p_size % 7 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE p_name END AS name, CASE WHEN p_size > 40 THEN p_type END AS onset, CAST(p_size AS VARCHAR) AS frequency FROM part)
           SELECT p_brand, 'Parts' || chr(10) || string_agg('- ' || name || ' (' || coalesce('onset: ' || onset || '; ', '') || 'frequency: ' || frequency || ')', chr(10) ORDER BY name, onset NULLS FIRST, frequency) AS text FROM n GROUP BY 1""")
def report_list(spark, d):
    """A line for each row with its own details; every seventh size has a blank name and shows its id."""
    name = F.when(F.col("p_size") % 7 == 0, " ").otherwise(F.col("p_name"))
    details = [("onset", F.when(F.col("p_size") > 40, F.col("p_type"))), ("frequency", F.col("p_size"))]
    return R.listed(_read(spark, d, "part"), "p_brand", name, "Parts", details, F.col("p_partkey"))


@_query("""WITH n AS (SELECT p_brand, p_type, p_name, min(p_partkey) AS o FROM part GROUP BY ALL),
                x AS (SELECT *, CASE WHEN p_size_first % 2 = 0 THEN 'even; ' ELSE '' END AS act FROM (SELECT n.*, (SELECT p_size FROM part WHERE p_partkey = n.o) AS p_size_first FROM n)),
                l AS (SELECT p_brand, p_type, string_agg(p_name || ' (' || act || 'primary: ' || CAST(p_size_first > 25 AS VARCHAR) || ')', ', ' ORDER BY o) AS i FROM x GROUP BY ALL)
           SELECT p_brand, 'Types' || chr(10) || string_agg('- ' || p_type || ': ' || i, chr(10) ORDER BY p_type) AS text FROM l GROUP BY 1""")
def report_pairs(spark, d):
    details = [("", F.when(F.col("p_size") % 2 == 0, "even")), ("primary", F.col("p_size") > 25)]
    return R.listed_pairs(_read(spark, d, "part"), "p_brand", F.col("p_type"), F.col("p_name"), "Types", details, ["p_partkey"])


@_query("""WITH n AS (SELECT DISTINCT p_type, p_name, NOT (starts_with(p_name, 'red') OR starts_with(p_name, 'old')) AS late FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY late, p_name) AS k FROM n)
           SELECT p_type, 'Top' || chr(10) || string_agg('- ' || p_name, chr(10) ORDER BY late, p_name) AS text FROM r WHERE k <= 15 GROUP BY 1""")
def report_topk(spark, d):
    return R.top_preferred(_read(spark, d, "part"), "p_type", F.col("p_name"), ["red", "old"], "Top")


def _nation_suppliers(spark, d, cap, anchors=None):
    """Each nation's suppliers, the first `cap` by name."""
    g = trade_graph(spark, d)
    g.nodes["Supplier"] = _read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("label"))
    g.edges["SUPPLIED_BY"] = _read(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("source_id"), F.col("s_suppkey").alias("target_id"))
    g.ends["SUPPLIED_BY"] = ("Nation", "Supplier")
    return G.hop(g, "SUPPLIED_BY", _of_asked(g.nodes["Nation"], "id", anchors), limit=cap).select(F.col("anchor_id").cast("int").alias("c_nationkey"), "label")


def _nation_brands(spark, d, anchors=None):
    """Brands and types that each nation's suppliers have lines of, once each: two sections share this exchange."""
    return _lines_by_nation(spark, d, anchors).select("c_nationkey", "p_brand", "p_type").distinct()


_NATION_PARTS = """v AS (SELECT s_nationkey, s_name FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name, s_suppkey) AS n FROM supplier) WHERE n <= 100),
   r2 AS (SELECT s_nationkey AS c_nationkey, 'Suppliers' || chr(10) || string_agg('- ' || s_name, chr(10) ORDER BY s_name) AS text FROM v GROUP BY 1),
   nb AS (SELECT DISTINCT s_nationkey AS c_nationkey, p_brand, p_type FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey),
   nl AS (SELECT c_nationkey, p_type, string_agg(p_brand, ', ' ORDER BY p_brand) AS i FROM nb GROUP BY ALL),
   r3 AS (SELECT c_nationkey, 'Brands by type' || chr(10) || string_agg('- ' || p_type || ': ' || i, chr(10) ORDER BY p_type) AS text FROM nl GROUP BY 1),
   nt AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY late, p_brand) AS n FROM (SELECT DISTINCT c_nationkey, p_brand, NOT starts_with(p_brand, 'Brand#2') AS late FROM nb)),
   r4 AS (SELECT c_nationkey, 'First brands' || chr(10) || string_agg('- ' || p_brand, chr(10) ORDER BY late, p_brand) AS text FROM nt WHERE n <= 15 GROUP BY 1)"""


def _nation_reports(spark, d, anchors):
    """The five sections of the nations asked for, each with the sentence for none."""
    brands = _nation_brands(spark, d, anchors)
    return {
        "lines": (_report_two_level(spark, d, anchors), "No lines."),
        "stages": (_report_status(spark, d, anchors), "No orders."),
        "suppliers": (R.listed(_nation_suppliers(spark, d, 100, anchors), "c_nationkey", F.col("label"), "Suppliers"), "No suppliers."),
        "types": (R.listed_pairs(brands, "c_nationkey", F.col("p_type"), F.col("p_brand"), "Brands by type"), "No brands."),
        "top": (R.top_preferred(brands, "c_nationkey", F.col("p_brand"), ["Brand#2"], "First brands"), "No first brands."),
    }


_SECTION = {"lines": "coalesce(r0.text, 'No lines.')", "stages": "coalesce(r1.text, 'No orders.')", "suppliers": "coalesce(r2.text, 'No suppliers.')", "types": "coalesce(r3.text, 'No brands.')", "top": "coalesce(r4.text, 'No first brands.')"}
_BLANK = " || chr(10) || chr(10) || "
_ALL_PARTS = f"{_REPORT_STATUS}, {_REPORT_TWO_LEVEL}, {_NATION_PARTS}"
_JOINED = " ".join(f"LEFT JOIN r{k} ON r{k}.c_nationkey = a.c_nationkey" for k in range(5))


@_query(f"WITH {_ALL_PARTS}, a AS (SELECT n_nationkey AS c_nationkey FROM nation) SELECT a.c_nationkey, {_BLANK.join(_SECTION.values())} AS text FROM a {_JOINED}")
def report_combined(spark, d):
    nations = _read(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"))
    return R.combined(nations, "c_nationkey", list(_nation_reports(spark, d, nations).values()))


_CLOSING = "Name only what is listed above."
_KINDS = {"lines": ("Lines of nation", ("lines",)), "suppliers": ("Suppliers of nation", ("suppliers",)), "trade": ("Orders and brands of nation", ("stages", "types")), "general": ("Nation", tuple(_SECTION))}


def _intent_reports(spark, d, anchors):
    """A row for each anchor and kind of question: kind, c_nationkey, text, anchor_found. Nations that aren't there are told apart by a left join."""
    parts, nations = _nation_reports(spark, d, anchors), _read(spark, d, "nation").select(F.col("n_nationkey").alias("_there"))
    asked = anchors.join(nations, F.col("c_nationkey") == F.col("_there"), "left")
    return R.framed(asked, "c_nationkey", F.col("_there").isNotNull(), _KINDS, parts, _CLOSING, "There is no such nation.")


def _intent_sql(anchors: str) -> str:
    one = lambda kind, heading, names: f"SELECT '{kind}' AS kind, a.c_nationkey, EXISTS (SELECT 1 FROM nation WHERE n_nationkey = a.c_nationkey) AS anchor_found, '{heading} ' || a.c_nationkey{_BLANK}{_BLANK.join(_SECTION[n] for n in names)}{_BLANK}'{_CLOSING}' AS body FROM a {_JOINED}"
    every = " UNION ALL ".join(one(kind, heading, names) for kind, (heading, names) in _KINDS.items())
    return f"{_ALL_PARTS}, a AS ({anchors}), fr AS ({every}), fx AS (SELECT kind, c_nationkey, anchor_found, CASE WHEN anchor_found THEN body ELSE 'There is no such nation.' END AS text FROM fr)"


@_query(f"WITH {_intent_sql('SELECT DISTINCT c_nationkey FROM (SELECT c_nationkey FROM customer UNION ALL SELECT CAST(o_orderkey % 30 AS INT) FROM orders)')} SELECT kind, c_nationkey, anchor_found, text FROM fx")
def report_intents(spark, d):
    more = _read(spark, d, "orders").select((F.col("o_orderkey") % 30).cast("int").alias("c_nationkey"))
    return _intent_reports(spark, d, _read(spark, d, "customer").select("c_nationkey").union(more).distinct())


# Questions --------------------------------------------------------------------------------------------------------


def _questions(spark, d):
    """User turns; every third also names words and ids that its numbers choose, as invented prose holds few."""
    c = _read(spark, d, "conversations").filter("role = 'user'")
    words = F.array(*map(F.lit, ("CSF biomarker and phase 2", "drug trial", "memory symptom", "synaptic pathway GO:12", "gene HGNC:5 variant GO:7 GO:12", "alzheimer", "plasma MONDO:4")))
    more = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit(" "), F.get(words, ((F.col("conv_id") + F.col("turn")) % 7).cast("int")))).otherwise("")
    return c.select("conv_id", "turn", F.concat("text", more).alias("question"))


_QUESTIONS = "q AS (SELECT conv_id, turn, text || CASE WHEN conv_id % 3 = 0 THEN ' ' || ['CSF biomarker and phase 2','drug trial','memory symptom','synaptic pathway GO:12','gene HGNC:5 variant GO:7 GO:12','alzheimer','plasma MONDO:4'][1 + (conv_id + turn) % 7] ELSE '' END AS question FROM conversations WHERE role = 'user')"


def _hits(words) -> str:
    return " + ".join(f"CAST(contains(x, '{w}') AS INT)" for w in words)


_INTENTS = list(QUESTIONS.keywords)
_SCORES = f"""{_QUESTIONS}, x AS (SELECT *, lower(question) AS x FROM q), s AS (SELECT *, {', '.join(f'{_hits(w)} AS score_{k}' for k, w in QUESTIONS.keywords.items())} FROM x),
   m AS (SELECT *, greatest({', '.join(f'score_{k}' for k in _INTENTS)}) AS top FROM s),
   i0 AS (SELECT *, CASE WHEN top = 0 THEN CASE WHEN contains(x, 'alzheimer') THEN 'GENERAL_AD' ELSE 'OTHER' END {' '.join(f"WHEN score_{k} = top THEN '{k}'" for k in _INTENTS)} END AS first FROM m),
   i1 AS (SELECT *, CASE WHEN contains(x, 'biomarker') THEN 'BIOMARKER' ELSE first END AS second FROM i0),
   i AS (SELECT *, CASE WHEN (contains(x, 'trial') OR contains(x, 'phase')) AND score_DRUG_TRIAL > 0 THEN 'DRUG_TRIAL' ELSE second END AS intent FROM i1)"""
_SQL_TEXT = [x.replace("'", "''") for x in (QUESTIONS.general[2], QUESTIONS.other[1], QUESTIONS.overrides[0][3], QUESTIONS.overrides[1][3])]
_NOTES = f"""CASE WHEN top = 0 THEN CASE WHEN contains(x, 'alzheimer') THEN '{_SQL_TEXT[0]}' ELSE '{_SQL_TEXT[1]}' END
   ELSE 'Selected ' || first || ' based on keyword hits: ' || {" || ', ' || ".join(f"'{k}: ' || score_{k}" for k in _INTENTS)} END || CASE WHEN second <> first THEN '{_SQL_TEXT[2]}' ELSE '' END
   || CASE WHEN intent <> second THEN '{_SQL_TEXT[3]}' ELSE '' END"""
_FOCUS = "coalesce(focus, '')"
_FOUND = "f0 AS (" + " UNION ALL ".join(f"SELECT conv_id, turn, {k} AS pattern, unnest(range(0, len(regexp_extract_all(question, '{p}')))) AS pos, unnest(regexp_extract_all(question, '{p}')) AS v FROM q" for k, p in enumerate(QUESTIONS.patterns)) + """),
   f1 AS (SELECT conv_id, turn, v, min((pattern, pos)) AS o FROM f0 GROUP BY ALL), focus AS (SELECT conv_id, turn, string_agg(v, ', ' ORDER BY o) AS focus FROM f1 GROUP BY ALL)"""
_STRATEGY = "CASE intent " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in QUESTIONS.strategies.items()) + " END"


@_query(f"WITH {_SCORES} SELECT conv_id, turn, {', '.join(f'score_{k}' for k in _INTENTS)} FROM s")
def question_scores(spark, d):
    return _questions(spark, d).select("conv_id", "turn", *(c.alias(f"score_{k}") for k, c in Q.scores(F.col("question")).items()))


@_query(f"WITH {_SCORES} SELECT conv_id, turn, intent, {_NOTES} AS notes FROM i")
def question_intent(spark, d):
    return Q.classify(_questions(spark, d)).select("conv_id", "turn", "intent", "notes")


@_query(f"WITH {_QUESTIONS}, {_FOUND} SELECT conv_id, turn, {_FOCUS} AS ids FROM q LEFT JOIN focus USING (conv_id, turn)")
def question_ids(spark, d):
    return _questions(spark, d).select("conv_id", "turn", F.array_join(Q.question_ids(F.col("question")), ", ").alias("ids"))


_STRATEGY_KINDS = {"AD_BIOMARKERS_V1": "lines", "AD_PHENOTYPES_V1": "suppliers", "AD_DRUGS_PATHWAYS_V1": "trade", "AD_GENERAL_V1": "general"}


def _strategy_reports(spark, d):
    """Each strategy's report on the nation of the first customer; strategies without a kind of report have none."""
    first = _read(spark, d, "customer").orderBy("c_custkey").limit(1).select("c_nationkey")
    strategy = F.lit(None).cast("string")
    for name, kind in _STRATEGY_KINDS.items():
        strategy = F.when(F.col("kind") == kind, F.lit(name)).otherwise(strategy)
    return _intent_reports(spark, d, first).select(strategy.alias("strategy"), F.col("text").alias("context"), "anchor_found")


@_query(f"""WITH {_SCORES}, {_FOUND} SELECT conv_id, turn, intent, {_STRATEGY} AS strategy, 'Intent: ' || intent || chr(10) || 'Notes: ' || {_NOTES} || chr(10) || 'Strategy: ' || {_STRATEGY} || CASE WHEN {_FOCUS} <> '' THEN chr(10) || 'Focus entities: ' || {_FOCUS} ELSE '' END AS description,
           CASE WHEN {_FOCUS} <> '' THEN 4 ELSE 3 END AS n_debug FROM i LEFT JOIN focus USING (conv_id, turn)""")
def question_route(spark, d):
    routed = Q.route(Q.classify(_questions(spark, d)), _strategy_reports(spark, d))
    return routed.select("conv_id", "turn", "intent", "strategy", "description", F.size("debug").alias("n_debug"))


@_query(f"""WITH {_SCORES}, {_intent_sql('SELECT c_nationkey FROM customer ORDER BY c_custkey LIMIT 1')},
                c AS (SELECT CASE kind {' '.join(f"WHEN '{k}' THEN '{name}'" for name, k in _STRATEGY_KINDS.items())} END AS strategy, text AS context FROM fx), rt AS (SELECT *, {_STRATEGY} AS strategy FROM i)
           SELECT conv_id, turn, CASE WHEN context IS NOT NULL THEN '{Q.RULES}' || chr(10) || chr(10) || 'Intent: ' || intent || chr(10) || chr(10) || 'Question: ' || question || chr(10) || chr(10) || 'Context:' || chr(10) || context END AS prompt,
           CASE WHEN context IS NULL THEN '{Q.MISSING.replace("'", "''")}' END AS answer FROM rt LEFT JOIN c USING (strategy)""")
def question_prompt(spark, d):
    return Q.prompts(Q.route(Q.classify(_questions(spark, d)), _strategy_reports(spark, d))).select("conv_id", "turn", "prompt", "answer")


@_query(f"WITH {_SCORES.replace('q AS (SELECT conv_id, turn, text || CASE', 'q AS (SELECT conv_id, turn, text AS question FROM conversations WHERE role = ' + chr(39) + 'user' + chr(39) + '), unused AS (SELECT conv_id, turn, text || CASE')} SELECT conv_id, turn, intent, {_STRATEGY} AS strategy FROM i")
def question_stream(spark, d):
    """The user turns as a file stream, routed and written to a folder that all executors share."""
    path, checkpoint = (S.shared_folder(spark, f"questions-{x}") for x in ("out", "log"))
    table = _read(spark, d, "conversations")
    stream = streaming.read_questions(spark, d, table.schema, "conversations.parquet*").filter("role = 'user'").withColumnRenamed("text", "question")
    routed = streaming.routed(stream, streaming.stored_reports(_strategy_reports(spark, d))).select("conv_id", "turn", "intent", "strategy")
    streaming.write(routed, path, checkpoint).awaitTermination()
    return spark.read.schema(routed.schema).parquet(path)


# Pages ------------------------------------------------------------------------------------------------------------


@_query("""WITH l AS (SELECT page_id, regexp_split_to_array(html, '(?is)<a\\s') AS parts FROM pages), u AS (SELECT page_id, unnest(parts[2:]) AS part, unnest(range(0, len(parts) - 1)) AS pos FROM l),
                h AS (SELECT page_id, pos, regexp_extract(part, '(?is)^[^>]*?href="([^"]*)"[^>]*>', 1) AS href, regexp_replace(part, '(?is)^[^>]*?href="[^"]*"[^>]*>', '') AS rest FROM u WHERE regexp_matches(part, '(?is)^[^>]*?href="[^"]*"[^>]*>')),
                f AS (SELECT page_id, pos, href, regexp_replace(href, '[?#].*$|/+$', '') AS path, regexp_replace(rest, '(?is)</a\\s*>.*$', '') AS title FROM h WHERE starts_with(href, '/') AND NOT contains(href, 'privacy')),
                c AS (SELECT page_id, pos, regexp_extract(path, '([^/]*)$', 1) AS id, 'https://example.org' || href AS url, regexp_replace(title, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<[^>]*>', ' ', 'g') AS t FROM f),
                s AS (SELECT page_id, pos, id, url, trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[\\s\\x{00A0}]+', ' ', 'g')) AS title FROM c WHERE id <> '')
           SELECT page_id, id, arg_min(url, pos) AS url, arg_min(title, pos) AS title FROM s GROUP BY page_id, id""")
def page_links(spark, d):
    return P.links(_read(spark, d, "pages"), "/", "privacy", 1, "https://example.org")


@_query("SELECT page_id, url FROM pages WHERE page_id NOT IN (SELECT page_id FROM pages WHERE contains(html, '<h2'))")
def page_pending(spark, d):
    pages = _read(spark, d, "pages")
    return P.pending(pages.select("page_id", "url"), pages.filter("contains(html, '<h2')"))


@_query("SELECT o_orderkey, o_orderkey IN (SELECT page_id FROM pages) AS found FROM orders")
def page_scan(spark, d):
    """Orders as an index of pages: those whose page is stored, and the report of those without."""
    index = _read(spark, d, "orders").select(F.col("o_orderkey").alias("page_id"))
    found, missing = P.scan(index, _read(spark, d, "pages").select("page_id", "html"))
    return found.select("page_id", F.lit(True).alias("found")).union(missing.select("page_id", F.lit(False))).withColumnRenamed("page_id", "o_orderkey")


@_query("""WITH b AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', '', 'g') AS h FROM pages),
                t AS (SELECT page_id, regexp_extract(h, '(?is)<title\\b[^>]*>(.*?)</title>', 1) AS t, regexp_extract(h, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1) AS g FROM b),
                c AS (SELECT page_id, regexp_replace(t, '(?is)<[^>]*>', ' ', 'g') AS t, regexp_replace(g, '(?is)<[^>]*>', ' ', 'g') AS g FROM t),
                e AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS t, replace(replace(replace(replace(replace(replace(g, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS g FROM c)
           SELECT page_id, nullif(trim(regexp_replace(t, '[\\s\\x{00A0}]+', ' ', 'g')), '') AS title, nullif(trim(regexp_replace(g, '[\\s\\x{00A0}]+', ' ', 'g')), '') AS heading FROM e""")
def page_meta(spark, d):
    return P.metadata(_read(spark, d, "pages")).select("page_id", "title", "heading")


def _cells(*texts):
    return F.concat(*(F.concat(F.lit("<td> "), t if not isinstance(t, str) else F.lit(t), F.lit("</td>")) for t in texts))


def _fold(row, *order):
    """All rows of a group, in order, as one text."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("k"), row.alias("r")))), lambda x: x["r"]), "")


def _order_pages(spark, d):
    """A page for each order: sections, labelled values, its lines as a versioned table under header rows, lines across groups, a timeline."""
    li = P.spread(_read(spark, d, "lineitem"), "l_orderkey")  # one deal for the grouping and the join
    keys, values = ("l_returnflag", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), ("l_discount", "l_quantity", "l_tax")
    lines = li.filter("l_returnflag is not null").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*keys, *values))).alias("lines"))
    o = P.spread(_read(spark, d, "orders"), "o_orderkey").join(lines.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"), "left")  # pages are never broadcast
    part = lambda x, name: F.concat(F.lit(f"{name} "), x["l_partkey"].cast("string"), F.lit(" (CSF)"))
    link = lambda x: F.concat(F.lit('see <a href="/notes/'), x["l_partkey"].cast("string"), F.lit('">a<b>b</b></a> <a href="http://x.org/">y</a>'))
    row = lambda x: _cells(part(x, "tau"), x["l_linenumber"].cast("string"), F.concat(F.lit("&lt;"), x["l_discount"].cast("string")), "-", "-", "-", "-", x["l_quantity"].cast("int").cast("string"), "", "0.5", link(x))
    crossed = lambda x: _cells(part(x, "nfl"), x["l_linenumber"].cast("string"), x["l_tax"].cast("string"), "-")
    head = lambda x: F.concat(F.lit("<tr><td>Flag "), x["l_returnflag"], F.lit("</td><td># n</td></tr>"))

    def body(cells):
        """The rows of all lines, a header row above the first of each flag."""
        first = lambda x, i: (i == 0) | (x["l_returnflag"] != F.get("lines", i - 1)["l_returnflag"])
        texts = F.transform("lines", lambda x, i: F.concat(F.when(first(x, i), head(x)).otherwise(F.lit("")), F.coalesce(F.concat(F.lit("<tr>"), cells(x), F.lit("</tr>")), F.lit(""))))
        return F.array_join(texts, "")

    key = F.col("o_orderkey").cast("string")
    table = lambda rows: F.concat(F.lit("<table><thead><tr><th>x</th></tr></thead><tbody>"), F.coalesce(rows, F.lit("")), F.lit("</tbody></table>"))
    span = lambda classes: F.concat(F.lit('<tr><td>trial</td><td><div class="'), classes, F.lit('"></div></td></tr>'))
    timeline = F.concat(F.lit('<div id="timeline"><table><tbody>'), span(F.concat(F.lit("timeline-span phase-"), (F.col("o_orderkey") % 13).cast("string"))), span(F.lit("timeline-span")), F.lit("<tr><td>other</td><td></td></tr></tbody></table></div>"))
    html = F.concat(
        F.lit("<html><body><script>var x='<table><tr><td>no</td></tr></table>';</script><article id=article><h1 class=page-title>Order "), key, F.lit('</h1><p>Synonyms (other): <i>no</i> '), key,
        F.lit('</p><div class="a primary"><section id="about-over-view"><h3>Before</h3>Wrong. x</section><section id="over-view"><h2 class="pane-title">Over<b>view</b></h2>Order '), key, F.lit(". It is "), "o_orderstatus", F.lit(".</section><section id=s2><h3>The "), "o_orderpriority",
        F.lit("</h3>Text<br>more<section id=inner>Deep</section></section><section>Third</section></div><p><strong>Priority:</strong> "), "o_orderpriority", F.lit("<br><strong>State:</strong> old</p><p><strong>State:</strong> "), "o_orderstatus",
        F.lit("</p><p>Last updated: day "), key, F.lit("</p>"), table(body(row)), table(body(crossed)), F.when(F.col("o_orderkey") % 2 == 0, timeline).otherwise(F.lit('<div id="timeline"></div>')), F.lit("</article></body></html>"),
    )
    return o.select(F.col("o_orderkey").alias("page_id"), F.concat(F.lit("https://example.org/orders/"), key).alias("url"), html.alias("html"))


@_query("""SELECT l_orderkey AS page_id, 'version_summary' AS section, 'Flag ' || l_returnflag AS comparison, 'tau_' || l_partkey || '_csf' AS measure_key, 'tau ' || l_partkey || ' (CSF)' AS label, 'tau ' || l_partkey AS core, 'CSF' AS fluid, 'tau' AS analyte_class, v.version,
             CASE v.version WHEN '1.x' THEN l_linenumber ELSE CAST(l_quantity AS INT) END AS n, CASE v.version WHEN '1.x' THEN l_discount END AS effect, CASE v.version WHEN '3.0' THEN 0.5 END AS p_value,
             'see a b y' AS meta_text, 'https://example.org/notes/' || l_partkey || ';http://x.org/' AS meta_urls FROM lineitem JOIN orders ON o_orderkey = l_orderkey, (VALUES ('1.x'), ('3.0')) v(version)
           UNION ALL SELECT l_orderkey, 'cross_group', 'Flag ' || l_returnflag, 'nfl_' || l_partkey || '_csf', 'nfl ' || l_partkey || ' (CSF)', 'nfl ' || l_partkey, 'CSF', 'neurodegeneration', 'cross', l_linenumber, l_tax, NULL, NULL, NULL FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def page_table_long(spark, d):
    """Both tables of a page in one: versions from the first, comparisons across groups from the second."""
    return P.page_measurements(P.headed_rows(_order_pages(spark, d), dealt=True), base="https://example.org").drop("n_raw", "effect_raw", "p_raw")


@_query("""SELECT o_orderkey AS page_id, 'about-over-view' AS section_name, 'Before' AS section_title, 1 AS section_order, 'Wrong. x' AS text FROM orders UNION ALL SELECT o_orderkey AS page_id, 'over-view' AS section_name, 'Over view' AS section_title, 2 AS section_order, 'Order ' || o_orderkey || '. It is ' || o_orderstatus || '.' AS text FROM orders
           UNION ALL SELECT o_orderkey, 's2', 'The ' || o_orderpriority, 3, 'Text more Deep' FROM orders UNION ALL SELECT o_orderkey, 'section_4', 'Section 4', 4, 'Third' FROM orders""")
def page_sections(spark, d):
    return P.sections(P.parsed(_order_pages(spark, d), kinds=["sections"]))


@_query("SELECT o_orderkey AS page_id, 'Order ' || o_orderkey || '. It is ' || o_orderstatus || '.' AS overview, 'Order ' || o_orderkey || '.' AS short_summary, 'order' AS category, true AS has_overview, contains(lower(o_orderpriority), 'urgent') AS has_urgent FROM orders")
def page_entities(spark, d):
    pages = _order_pages(spark, d)
    index = pages.select("page_id", F.col("url").alias("title"))
    return P.entities(index, P.sections(P.parsed(pages, kinds=["sections"])), {"has_overview": "over-view", "has_urgent": "urgent"}, "order", "over-view").drop("title")


@_query("SELECT o_orderkey AS page_id, o_orderpriority AS priority, o_orderstatus AS state FROM orders")
def page_kv(spark, d):
    values = P.labelled_values(_order_pages(spark, d), {"priority": "priority_level"})
    return values.select("page_id", F.col("values").getItem("priority_level").alias("priority"), F.col("values").getItem("state").alias("state"))


@_query("SELECT o_orderkey AS page_id, 'Order ' || o_orderkey AS heading, 'Over view' AS subtitle, 'no ' || o_orderkey AS synonyms, 'day ' || o_orderkey AS last_updated FROM orders")
def page_lines(spark, d):
    """Labelled lines of a page: synonyms and the day of the last change."""
    first = F.get(F.split("intro", "\n\n"), F.lit(0))
    return P.metadata(_order_pages(spark, d)).select("page_id", "heading", "subtitle", P.synonym_line(first).alias("synonyms"), "last_updated")


@_query("SELECT o_orderkey AS page_id, CASE WHEN o_orderkey % 2 = 0 THEN 2 END AS blocks, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 13 AS INT) END AS phase_max FROM orders")
def page_timeline(spark, d):
    return P.timeline(P.parsed(_order_pages(spark, d), kinds=["marks"], dealt=True))


def _part_pages(spark, d):
    """A page for each brand and size: a list of its parts with linked row headers, and a heading with paragraphs behind it."""
    p = _read(spark, d, "part")
    name = F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string"))
    listed = F.concat(F.lit('<tr><th scope="row"><a href="/parts/'), F.col("p_partkey").cast("string"), F.lit('/">'), name, F.lit("</a> <a href=/no>no</a></th>"), _cells(F.col("p_type"), F.concat(F.lit('<a href="/sizes">'), F.col("p_size").cast("string"), F.lit("</a>"))), F.lit("</tr>"))
    pages = p.groupBy("p_brand", "p_size").agg(_fold(listed, "p_partkey").alias("rows"), F.min("p_partkey").alias("page_id"))
    html = F.concat(F.lit("<table><thead><tr><th scope=row><a href=/head>Name</a></th><td>a</td><td>b</td></tr></thead><tbody>"), "rows", F.lit("<tr><th>plain</th><td>c</td><td>d</td></tr></tbody></table><div><h2>Notes</h2><p>Plain "), "p_brand", F.lit("</p><h3>Mechanism of <i>action</i></h3><p>Acts on "), "p_brand", F.lit("<ul><li>one<li>two</ul><span>not</span><h3>End</h3><p>no</p></div>"))
    return pages.select("page_id", F.concat(F.lit("https://example.org/"), "p_brand").alias("url"), html.alias("html"))


@_query("SELECT 'https://example.org/parts/' || p_partkey || '/' AS url, CAST(p_partkey AS VARCHAR) AS slug, p_name || ' ' || p_partkey AS name, p_type AS kind, CAST(p_size AS VARCHAR) AS size FROM part")
def page_search_rows(spark, d):
    return P.search_results(P.table_rows(P.parsed(_part_pages(spark, d))), ["kind", "size"], "https://example.org").drop("page_id", "row_no")


@_query("SELECT l_orderkey AS page_id, 'Flag ' || l_returnflag AS comparison, 'nfl ' || l_partkey || ' (CSF)' AS label, 'cross' AS version, l_linenumber AS n, l_tax AS effect, CAST(NULL AS DOUBLE) AS p_value FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def page_cross_group(spark, d):
    rows = P.headed_rows(_order_pages(spark, d), only=1, dealt=True)
    return P.cross_group(rows).select("page_id", "comparison", "label", "version", "n", "effect", "p_value")


@_query("SELECT min(p_partkey) AS page_id, 'Acts on ' || p_brand || chr(10) || chr(10) || 'one two' AS text FROM part GROUP BY p_brand, p_size")
def page_background(spark, d):
    return P.parsed(_part_pages(spark, d)).select("page_id", P.background(["mechanism", "background"], ["mechanism"]).alias("text"))


_LABELS = {"Name": "name", "U.S. FDA Status": "fda_status", "Target Type": "target_type", "Therapy Type": "therapy_type", "Condition(s)": "conditions"}


def _detail_pages(spark, d):
    """A page for each part: labelled values (every third in running text), a mechanism with or without an id, a timeline."""
    p = _read(spark, d, "part")
    labels = F.when(F.col("p_partkey") % 3 == 0, F.lit("%s: ")).otherwise(F.lit("<strong>%s:</strong> "))
    end = F.when(F.col("p_partkey") % 3 == 0, F.lit(" ")).otherwise(F.lit("<br/>"))
    field = lambda label, value: F.concat(F.replace(labels, F.lit("%s"), F.lit(label)), value, end)
    size = F.col("p_size")
    status = F.when(size % 6 == 0, F.lit("")).otherwise(F.concat(F.lit("Phase "), (size % 4).cast("string")))
    values = F.concat(field("Name", F.col("p_name")), F.when(size % 6 == 0, F.lit("")).otherwise(field("U.S. FDA Status", status)), field("Target Type", F.concat(F.lit("(timeline), "), "p_name", F.lit(" (timeline), "), "p_brand")), field("Therapy Type", F.when(size % 2 == 0, "Small Molecule (timeline)").otherwise("Dietary")), field("Condition(s)", F.col("p_type")))
    word = F.when(size % 4 == 0, "Background").otherwise("Background ")
    named, behind = F.concat(F.lit('<section id="background">'), word, F.lit("It has ")), F.lit("<h3>The Mechanism</h3><p>It has ")
    mechanism = F.concat(F.when(size % 2 == 0, named).otherwise(behind), "p_brand", F.lit(". Then more. Then end"), F.when(size % 2 == 0, F.lit("</section>")).otherwise(F.lit("</p><h2>x</h2><p>no</p>")))
    html = F.concat(F.lit('<article id="article"><h1>'), "p_name", F.lit('</h1><section id="overview"><p>'), values, F.lit("</p></section>"), mechanism, F.lit('<section id="timeline"><table><tr><td><div class="timeline-span phase-'), (size % 3 + 1).cast("string"), F.lit('"></div></td></tr></table></section><p>Last updated: today</p></article>'))
    return p.select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("https://example.org/parts/"), F.when(F.col("p_partkey") % 10 == 0, "?").otherwise(""), F.col("p_partkey").cast("string")).alias("url"), html.alias("html"))


_DETAILS = """x AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_name, p_brand, p_type, CASE WHEN p_size % 6 <> 0 THEN 'Phase ' || (p_size % 4) END AS status, CASE WHEN p_size % 6 <> 0 THEN p_size % 4 END AS ph, p_size % 3 + 1 AS tl, p_size, p_partkey FROM part WHERE p_partkey % 10 <> 0),
   y AS (SELECT *, CAST(greatest(coalesce(ph, 0), tl) AS INT) AS phase, CASE WHEN status IS NULL THEN greatest(coalesce(ph, 0), tl) >= 3 ELSE ph >= 3 END AS has3 FROM x)"""


@_query(f"""WITH {_DETAILS} SELECT id, p_name AS page_title, p_name AS name, status AS fda_status, p_name || ', ' || p_brand AS target_type, CASE WHEN p_size % 2 = 0 THEN 'Small Molecule' ELSE 'Dietary' END AS therapy_type, p_type AS conditions,
             'It has ' || p_brand || '. Then more.' AS mechanism_summary, CASE WHEN p_size % 4 = 0 THEN 'Background' WHEN p_size % 2 = 0 THEN 'Background ' ELSE '' END || 'It has ' || p_brand || '. Then more. Then end' AS mechanism_raw, CASE WHEN status IS NOT NULL THEN 'ongoing' END AS status,
             phase AS trial_phase_max, has3 AS has_phase3, 1 AS trial_count, 'today' AS last_updated, 'https://example.org/parts/' || id AS url FROM y""")
def page_details(spark, d):
    return P.details(_detail_pages(spark, d), _LABELS)[0].drop("overview_raw")


@_query(f"""WITH {_DETAILS}, t AS (SELECT id, 'pathway_or_process' AS target_kind, CASE WHEN p_size % 2 = 0 THEN 'small_molecule' ELSE 'supplement' END AS action_type, p_name, p_brand, 'It has ' || p_brand || '.' AS target_notes FROM y)
           SELECT id, p_name AS target_name, target_kind, action_type, true AS is_primary_target, target_notes FROM t UNION ALL SELECT id, p_brand, target_kind, action_type, false, target_notes FROM t""")
def page_targets(spark, d):
    return P.details(_detail_pages(spark, d), _LABELS)[1]


@_query(f"WITH {_DETAILS} SELECT id, p_type AS indication, phase AS trial_phase_max, has3 AS has_phase3, CASE WHEN status IS NOT NULL THEN 'ongoing' END AS status, 1 AS trial_count, status AS notes FROM y")
def page_trials(spark, d):
    return P.details(_detail_pages(spark, d), _LABELS)[2]


# Sources and sinks ------------------------------------------------------------------------------------------------


@_query("SELECT CAST(c_custkey AS VARCHAR) AS \"id:ID(Customer)\", c_name AS label, c_mktsegment AS segment FROM customer")
def import_nodes(spark, d):
    return S.import_nodes(trade_graph(spark, d).nodes["Customer"], "Customer")


@_query("SELECT CAST(o_custkey AS VARCHAR) AS \":START_ID(Customer)\", CAST(o_orderkey AS VARCHAR) AS \":END_ID(Order)\", o_orderstatus AS status FROM orders")
def import_edges(spark, d):
    edges = _read(spark, d, "orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("target_id"), F.col("o_orderstatus").alias("status"))
    return S.import_edges(edges, "Customer", "Order")


@_query("""SELECT CAST(c_custkey AS VARCHAR) AS id, c_name || chr(10) || '"' || c_mktsegment || '", x' AS label, CASE WHEN c_nationkey % 2 = 0 THEN CAST(c_nationkey AS VARCHAR) END AS nation, CAST(NULL AS VARCHAR) AS absent FROM customer""")
def source_text_table(spark, d):
    """Customers written as CSV, with quotes, line breaks and blanks, and read again as text."""
    path = S.shared_folder(spark, "customers-csv")
    label = F.concat("c_name", F.lit('\n"'), "c_mktsegment", F.lit('", x'))
    S.write_table(_read(spark, d, "customer").select(F.col("c_custkey").alias("id"), label.alias("label"), F.when(F.col("c_nationkey") % 2 == 0, F.col("c_nationkey")).alias("nation")), path, "csv")
    return S.read_text_table(spark, path, ["id", "label", "nation", "absent"], required=["id"])


@_query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS number, CASE WHEN o_orderkey % 3 = 1 THEN CAST(o_orderkey AS DOUBLE) / 4 END AS share, o_orderstatus = 'F' AS flag FROM orders""")
def source_typed_table(spark, d):
    """Orders written as CSV and read with declared types: what isn't a value of its type is null."""
    path = S.shared_folder(spark, "orders-csv")
    key = F.col("o_orderkey")
    share = F.when(key % 3 == 1, (key / 4).cast("string")).when(key % 3 == 2, "-").otherwise("<1")
    rows = _read(spark, d, "orders").select("o_orderkey", F.when(key % 3 != 0, F.col("o_custkey").cast("string")).otherwise("none").alias("number"), share.alias("share"), (F.col("o_orderstatus") == "F").alias("flag"))
    S.write_table(rows, path, "csv")
    return S.read_typed_table(spark, path, T.StructType.fromDDL("o_orderkey long, number long, share double, flag boolean"))


@_query("SELECT CAST(p_partkey AS VARCHAR) AS symbol, CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END AS name, '' AS absent FROM part")
def source_tabbed(spark, d):
    path = S.shared_folder(spark, "parts-tabbed")
    _read(spark, d, "part").select(F.col("p_partkey").alias("symbol"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("name"), "p_type").write.option("header", True).option("sep", "\t").csv(path)
    return S.read_tabbed(spark, path, ["symbol", "name", "absent"])


@_query("""SELECT 'PART:' || p_partkey AS id, p_name AS label, 'http://example.org/obo/PART_' || p_partkey AS iri, CASE WHEN p_brand < p_type THEN p_brand || '|' || p_type ELSE p_type || '|' || p_brand END AS synonyms, 'parts' AS source FROM part WHERE p_size % 7 <> 0""")
def source_vocabulary(spark, d):
    """Parts written as classes of OWL files, a thousand in each, and read again; those without a label are left out."""
    path = S.shared_folder(spark, "parts-owl")
    key, label = F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 7 != 0, F.concat(F.lit("<rdfs:label>"), "p_name", F.lit("</rdfs:label>"))).otherwise("")
    of = lambda tag, c: F.concat(F.lit(f"<oboInOwl:{tag}>"), c, F.lit(f"</oboInOwl:{tag}>"))
    text = F.concat(F.lit('<owl:Class rdf:about="http://example.org/obo/PART_'), key, F.lit('">'), label, of("hasExactSynonym", F.col("p_type")), of("hasRelatedSynonym", F.col("p_brand")), of("hasExactSynonym", F.col("p_type")), F.lit("</owl:Class>"))
    space = " ".join(f'xmlns:{n}="http://example.org/{n}"' for n in ("rdf", "owl", "rdfs", "oboInOwl"))
    whole = F.concat(F.lit(f"<rdf:RDF {space}>"), _fold(text, "p_partkey"), F.lit("</rdf:RDF>"))
    _read(spark, d, "part").groupBy(F.floor(F.col("p_partkey") / 1000).alias("file")).agg(whole.alias("value")).write.partitionBy("file").text(path)
    return S.read_vocabulary(spark, path, "parts")


@_query("SELECT s_suppkey, s_name FROM supplier")
def source_preferred(spark, d):
    """The enriched table isn't there, so the base table is read."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return S.preferred_source(spark, [f"{d}/supplier_enriched.parquet", f"{d}/supplier.parquet"], spark.read.parquet).select("s_suppkey", "s_name")


@_query("""SELECT 'Customer' AS label, (SELECT count(*) FROM customer) AS rows, (SELECT count(*) FROM customer) AS kept, '' AS empty_header UNION ALL SELECT 'Order', (SELECT count(*) FROM orders), (SELECT count(*) FROM orders), ''
           UNION ALL SELECT 'Nothing', 0, 0, 'id,label,kind'""")
def build_counts(spark, d):
    """Each label's table built and written, with the rows counted on the way, and read again; a label without a source is skipped."""
    folder, g = S.shared_folder(spark, "graph"), trade_graph(spark, d)
    nothing = NodeSpec("Nothing", ("kind",))
    catalog = Catalog({n: NodeSpec(n, ()) for n in ("Customer", "Order", "Absent")} | {"Nothing": nothing}, {})
    builders = {"Customer": lambda: g.nodes["Customer"], "Order": lambda: g.nodes["Order"], "Absent": lambda: None, "Nothing": lambda: S.empty(spark, nothing.schema)}
    counts = S.build_all(builders, catalog, "node", folder)
    S.write_table(S.empty(spark, nothing.schema), f"{folder}/empty-csv", "csv")
    header = spark.read.text(f"{folder}/empty-csv").agg(F.array_join(F.collect_list("value"), "").alias("empty_header"))
    parts = [spark.read.parquet(f"{folder}/{n}").agg(F.lit(n).alias("label"), F.lit(rows).cast("long").alias("rows"), F.count("*").alias("kept")) for n, rows in counts.items()]
    return N.union_nodes(*parts).crossJoin(F.broadcast(header)).withColumn("empty_header", F.when(F.col("label") == "Nothing", F.col("empty_header")).otherwise(""))


@_query("""SELECT 'region' AS table_name, (SELECT count(*) FROM region) AS row_count, 'r_regionkey,r_name' AS column_names, (SELECT string_agg('{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}', chr(10) ORDER BY r_regionkey) FROM (FROM region ORDER BY r_regionkey LIMIT 3)) AS first_rows
           UNION ALL SELECT 'labels', (SELECT count(*) FROM labels), 'doc_id,quality,toxic', (SELECT string_agg('{"doc_id":' || doc_id || ',"quality":' || quality || ',"toxic":' || toxic || '}', chr(10) ORDER BY doc_id) FROM (FROM labels ORDER BY doc_id LIMIT 3))""")
def table_profile(spark, d):
    return S.profile({t: _read(spark, d, t) for t in ("region", "labels")}, {"region": ["r_regionkey"], "labels": ["doc_id"]})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
