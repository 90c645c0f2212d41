"""Scans and sinks: text tables, vocabularies in XML, graph tables, bulk-import files, profiles."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators.nodes import conform
from ..plans.specs import Catalog
from .shared import shared_folder  # noqa: F401  (part of this module's interface)


def strings(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_text_table(spark: SparkSession, path: str, columns: Sequence[str], separator: str = ",", required: Sequence[str] = ()) -> DataFrame:
    """A delimited file with a header, all columns text; quoted fields may hold line breaks. A missing file or required column is an error."""
    head = spark.read.option("header", True).option("sep", separator).option("multiLine", True).option("escape", '"').option("inferSchema", False).csv(path)
    for name in required:
        if name not in head.columns:
            raise ValueError(f"{path} has no column {name!r}; it has {head.columns}")
    return conform(head, strings(columns))


def read_typed_table(spark: SparkSession, path: str, schema: T.StructType, separator: str = ",") -> DataFrame:
    """The same with declared types: what isn't a value of a column's type is null."""
    rows = read_text_table(spark, path, schema.names, separator)
    return rows.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema))


def read_tabbed(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Named columns of a tab-separated file, blank for absent ones and nulls."""
    rows = read_text_table(spark, path, columns, "\t")
    return rows.select(*(F.coalesce(c, F.lit("")).alias(c) for c in columns))


def read_vocabulary(spark: SparkSession, path: str, source: str, row_tag: str = "owl:Class") -> DataFrame:
    """id, label, iri, synonyms, source of the labelled classes of an OWL file in RDF/XML; synonyms sorted and packed by '|'."""
    names = {"_rdf:about": "iri", "rdfs:label": "label", "oboInOwl:hasExactSynonym": "exact", "oboInOwl:hasRelatedSynonym": "related", "oboInOwl:hasBroadSynonym": "broad", "oboInOwl:hasNarrowSynonym": "narrow", "skos:altLabel": "other"}
    schema = T.StructType([T.StructField(n, T.StringType() if n.startswith("_") else T.ArrayType(T.StringType())) for n in names])
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    rows = rows.select(*(F.col(f"`{n}`").alias(short) for n, short in names.items()))
    none = F.array().cast("array<string>")
    kinds = [F.coalesce(c, none) for c in ("exact", "related", "broad", "narrow", "other")]
    synonyms = F.array_sort(F.array_distinct(F.filter(F.transform(F.flatten(F.array(*kinds)), X.clean), lambda x: x != "")))
    label = X.filled(F.get(F.coalesce("label", none), F.lit(0)))
    return rows.select(X.curie(F.col("iri")).alias("id"), label.alias("label"), "iri", F.array_join(synonyms, "|").alias("synonyms"), F.lit(source).alias("source")).filter("iri is not null and label is not null")


def preferred_source(spark: SparkSession, paths: Sequence[str], read: Callable[[str], DataFrame]) -> DataFrame | None:
    """The first of the tables that is there, or None with a warning."""
    for path in paths:
        try:
            return read(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    warnings.warn(f"none of {list(paths)} is there", stacklevel=2)
    return None


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """One folder for each table; CSV has a header even for no rows (it is written by one task then)."""
    if kind == "csv":
        df.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    else:
        df.write.mode("overwrite").format(kind).save(path)


def import_nodes(df: DataFrame, label: str) -> DataFrame:
    """For a bulk import: the first column, id, becomes id:ID(label); the rest is text."""
    if not df.columns or df.columns[0] != "id":
        raise ValueError(f"the first column of {label} must be id; it has {df.columns}")
    return df.select(*(F.col(c).cast("string").alias(f"id:ID({label})" if c == "id" else c) for c in df.columns))


def import_edges(df: DataFrame, source: str, target: str) -> DataFrame:
    """For a bulk import: source_id and target_id, the first columns, become :START_ID(source) and :END_ID(target)."""
    if df.columns[:2] != ["source_id", "target_id"]:
        raise ValueError(f"the first columns must be source_id and target_id; they are {df.columns[:2]}")
    new = {"source_id": f":START_ID({source})", "target_id": f":END_ID({target})"}
    return df.select(*(F.col(c).cast("string").alias(new.get(c, c)) for c in df.columns))


def profile(tables: Mapping[str, DataFrame], order: Mapping[str, Sequence[str]], n: int = 3) -> DataFrame:
    """table_name, row_count, column_names and the first rows (JSON), for each table."""
    parts = []
    for name, df in tables.items():
        heads = df.orderBy(*order[name]).limit(n).select(F.to_json(F.struct(*df.columns)).alias("_row"), F.struct(*order[name]).alias("_at"))
        head = heads.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_row"))), lambda x: x["_row"]), "\n").alias("first_rows"))
        count = df.agg(F.count("*").alias("row_count"))
        parts.append(count.crossJoin(F.broadcast(head)).select(F.lit(name).alias("table_name"), "row_count", F.lit(",".join(df.columns)).alias("column_names"), "first_rows"))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def build_all(builders: Mapping[str, Callable[[], DataFrame | None]], catalog: Catalog, kind: str, folder: str) -> dict[str, int]:
    """Builds and writes each label or type, one Spark job each; those without a source are skipped. The number of rows written of each, counted as they are written."""
    written = {}
    for name, build in builders.items():
        df = build()
        if df is None:
            continue
        spec, seen = catalog.node(name) if kind == "node" else catalog.edge(name), Observation()
        write_table(conform(df, spec.schema).observe(seen, F.count("*").alias("rows")), f"{folder}/{name}")
        written[name] = seen.get["rows"]
    return written
