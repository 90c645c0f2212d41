"""Node tables: projections to a spec, categories from packed lists, distinct values, surrogate ids, vocabularies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..sources.shared import shared_folder


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its order: missing ones null, others dropped."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def project(df: DataFrame, mapping: Mapping[str, Column], schema: T.StructType) -> DataFrame:
    """A node or edge table: the mapped columns, conformed."""
    return conform(df.select(*(c.alias(name) for name, c in mapping.items())), schema)


def union_nodes(*tables: DataFrame) -> DataFrame:
    first, *others = tables
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def distinct_join(df: DataFrame, keys: Sequence[str], value: Column, order: Column, name: str, delimiter: str = " | ") -> DataFrame:
    """Per group the distinct filled values, joined in the order in which they come first.

    Values are reduced to their first places before they are gathered, so a group's list holds distinct values only.
    """
    firsts = df.withColumn("_value", value).withColumn("_order", order).filter(F.col("_value").isNotNull() & (F.col("_value") != "")).groupBy(*keys, "_value").agg(F.min("_order").alias("_order"))
    gathered = F.array_sort(F.collect_list(F.struct("_order", "_value")))
    return firsts.groupBy(*keys).agg(F.array_join(F.transform(gathered, lambda x: x["_value"]), delimiter).alias(name))


def category_nodes(df: DataFrame, packed: Column, category: Column, order: Column, prefix: str, delimiters: str = "|,") -> DataFrame:
    """id, label, category: a node for each distinct entry of a packed list; first label, distinct categories in order of appearance."""
    rows = df.select(category.alias("_category"), order.alias("_first"), F.posexplode(X.packed_list(packed, delimiters)).alias("_pos", "_label"))
    rows = rows.withColumn("id", F.concat(F.lit(prefix), X.slug(F.col("_label")))).withColumn("_at", F.struct("_first", "_pos"))
    labels = rows.groupBy("id").agg(F.min_by("_label", "_at").alias("label"))
    return labels.join(distinct_join(rows, ["id"], F.lower("_category"), F.col("_at"), "category"), "id", "left")


def list_nodes(tables: Sequence[tuple[DataFrame, Column, Column, str]], prefix: str, delimiters: str = "|,") -> DataFrame:
    """id, label, category, description, source, raw_source_ids: a node for each distinct entry of packed lists in several columns or tables.

    tables: (rows, packed list, order, source), orders of one type. The label is an entry's first spelling, the category the same in lower case,
    sources are those of all columns that have the entry, in the order of the tables.
    """
    rows = union_nodes(*(df.select(order.alias("_first"), F.lit(source).alias("_source"), F.lit(k).alias("_table"), F.posexplode(X.packed_list(packed, delimiters)).alias("_pos", "_label")) for k, (df, packed, order, source) in enumerate(tables)))
    rows = rows.withColumn("id", F.concat(F.lit(prefix), X.slug(F.col("_label")))).withColumn("_at", F.struct("_table", "_first", "_pos"))
    labels = rows.groupBy("id").agg(F.min_by("_label", "_at").alias("label"))
    sources = distinct_join(rows, ["id"], F.col("_source"), F.col("_table"), "source", "|")
    return labels.join(sources, "id").select("id", "label", F.lower("label").alias("category"), F.lit(None).cast("string").alias("description"), "source", F.col("label").alias("raw_source_ids"))


def entity_groups(df: DataFrame, key: str, firsts: Mapping[str, Column], joined: Mapping[str, Column], order: Sequence[Column | str], delimiter: str = " | ") -> DataFrame:
    """A row for each key: each of `firsts` has its first filled value, each of `joined` its distinct filled values in order of appearance.

    All columns go through one exchange. Of `firsts` one value is kept from the start, of `joined` each value's first place, so only
    distinct joined values are ever gathered. The key may have any name, and may be null.
    """
    columns = {**firsts, **joined}
    cells = F.array(*(F.struct(F.lit(k).alias("k"), X.filled(c.cast("string")).alias("v")) for k, c in enumerate(columns.values())))
    rows = df.select(F.col(key).alias("_key"), F.struct(*order).alias("_at"), F.explode(cells).alias("_c"))
    value = F.col("_c.v")
    told_apart = F.when(F.col("_c.k") >= len(firsts), value)
    places = rows.groupBy("_key", F.col("_c.k").alias("_k"), told_apart.alias("_v")).agg(F.min(F.when(value.isNotNull(), F.struct(F.col("_at").alias("at"), F.col("_c.k").alias("k"), value.alias("v")))).alias("_place"))
    groups = places.groupBy("_key").agg(F.array_sort(F.collect_list("_place")).alias("_all"))
    of = lambda k: F.transform(F.filter("_all", lambda x: x["k"] == k), lambda x: x["v"])
    named = [F.get(of(k), F.lit(0)).alias(n) if n in firsts else F.array_join(of(k), delimiter).alias(n) for k, n in enumerate(columns)]
    return groups.select(F.col("_key").alias(key), *named)


def contributor_nodes(df: DataFrame, packed: Column, contributor: Column, order: Column, prefix: str, delimiters: str = ",") -> DataFrame:
    """id, label, raw_source_ids: a node for each distinct entry, with the ids of the rows that name it."""
    rows = df.select(contributor.cast("string").alias("_from"), order.alias("_first"), F.posexplode(X.packed_list(packed, delimiters)).alias("_pos", "_label"))
    rows = rows.withColumn("id", F.concat(F.lit(prefix), X.slug(F.col("_label")))).withColumn("_at", F.struct("_first", "_pos"))
    labels = rows.groupBy("id").agg(F.min_by("_label", "_at").alias("label"))
    return labels.join(distinct_join(rows, ["id"], F.col("_from"), F.col("_at"), "raw_source_ids", "|"), "id")


def value_nodes(df: DataFrame, value: Column, prefix: str) -> DataFrame:
    """id, label: a node for each distinct filled value."""
    values = df.select(X.filled(value).alias("label")).filter("label is not null").distinct()
    return values.select(F.concat(F.lit(prefix), X.slug(F.col("label"))).alias("id"), "label")


def numbered(df: DataFrame, key: str, order: Sequence[Column | str], prefix: str, name: str = "id") -> DataFrame:
    """A surrogate id prefix_key_n, n from 0 in the declared order within the key."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return df.withColumn(name, F.concat_ws("_", F.lit(prefix), F.col(key).cast("string"), n.cast("string")))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key: one aggregate, no window."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return first.select(*keys, *(F.col(f"_first.{c}").alias(c) for c in rest)).select(*df.columns)


def first_filled_per_group(df: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Each column's first value that is not null, in the given order."""
    at = F.struct(*order)
    return df.groupBy(*keys).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns))


def allow_exact(df: DataFrame, label: Column, allowed: DataFrame, column: str) -> DataFrame:
    """Rows whose lower-cased label is in the list."""
    wanted = allowed.select(F.lower(F.col(column)).alias("_allowed")).distinct()
    return df.join(wanted, F.lower(label) == F.col("_allowed"), "left_semi")


def allow_fragment(df: DataFrame, label: Column, fragments: Sequence[str]) -> DataFrame:
    """Rows whose lower-cased label contains one of the fragments, which are a spec's list."""
    return df.filter(X.mentions(F.lower(label), [f.lower() for f in fragments]))


def term_index(df: DataFrame, id_column: str, terms: Sequence[Column], lists: Sequence[Column] = (), order: Column | None = None, size: int = 4096) -> DataFrame:
    """term, part, ids: the distinct ids of each normalised term as first seen (by the order, then the id), in lists of `size` ids, numbered from 0.

    A term's ids are numbered in two levels, by ranges of (term, order, id) and within each range, so a term of very many ids is
    the work of many tasks and no list passes the size. The ranges are written to the shared folder, as both levels read them.
    """
    every = F.array_union(F.array(*terms), F.flatten(F.array(*lists))) if lists else F.array(*terms)
    at = F.col(id_column) if order is None else order
    rows = df.filter(F.col(id_column).isNotNull()).select(F.col(id_column).alias("id"), at.alias("at"), F.explode(every).alias("raw"))
    firsts = rows.select(X.term_key(F.col("raw")).alias("term"), "id", "at").filter("term != ''").groupBy("term", "id").agg(F.min("at").alias("at"))
    folder = shared_folder(df.sparkSession, "terms")
    firsts.repartitionByRange("term", F.col("at").asc_nulls_last(), "id").withColumn("chunk", F.spark_partition_id()).write.parquet(folder)
    ranged = df.sparkSession.read.parquet(folder)
    earlier = Window.partitionBy("term").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("term", "chunk").agg(F.count("*").alias("n"))
    before = counts.select("term", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("term", "chunk").orderBy(F.col("at").asc_nulls_last(), "id")) - 1
    numbered_ = ranged.withColumn("place", place).join(before, ["term", "chunk"]).withColumn("place", F.col("before") + F.col("place"))
    part = F.floor(F.col("place") / size).cast("int").alias("part")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"])
    return numbered_.groupBy("term", part).agg(ids.alias("ids"))


def term_lookup(df: DataFrame, term: Column, index: DataFrame) -> DataFrame:
    """df with part and ids of its term, a row for each of the term's lists, and one with an empty list (and no part) where there is none."""
    keyed = df.withColumn("_term", X.term_key(term))
    found = keyed.join(index.select(F.col("term").alias("_term"), "part", "ids"), "_term", "left")
    return found.withColumn("ids", F.coalesce("ids", F.array().cast(index.schema["ids"].dataType))).drop("_term")


def known_terms(df: DataFrame, term: Column, index: DataFrame) -> DataFrame:
    return df.withColumn("_term", X.term_key(term)).join(index.select(F.col("term").alias("_term")), "_term", "left_semi").drop("_term")


def priority_mapping(df: DataFrame, key: str, label: Column, synonyms: Column, mapping: DataFrame, term: str, value: str) -> DataFrame:
    """df with the value of its label, else of the first of its synonyms that the mapping has."""
    tried = df.select(key, F.posexplode(F.concat(F.array(label), synonyms)).alias("_pos", "_name")).withColumn("_term", X.term_key(F.col("_name")))
    known = mapping.select(X.term_key(F.col(term)).alias("_term"), F.col(value).alias("_value")).groupBy("_term").agg(F.min("_value").alias("_value"))
    best = tried.join(known, "_term").groupBy(key).agg(F.min_by("_value", "_pos").alias(value))
    return df.join(best, key, "left")
