"""Edges stored for retrieval: each type twice, once by its source and once by its target.

A table is bucketed by the end that it is looked up by, so a hop or a neighbourhood moves the asked ids to the edges and
neither shuffles nor sorts an edge. A node of very many edges is split: its edges carry a salt from 0 to its number of
parts less one by its other end, the tables are bucketed by (end, salt), and an asked id goes to each of its parts. Only
repeats of one edge stay together.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_folder
from .graph import Graph

#: Edges of one node in one part, and about how many edges a bucket holds.
PART, BUCKET = 1_000_000, 4_000_000
#: Nodes that are split: the list of them is handed to every task that writes edges.
MOST_SPLIT = 100_000

ENDS = ("source_id", "target_id")


@dataclass
class Side:
    """The edges of a type by one end, the name of their salt, and how many parts the split nodes have (id, parts)."""

    edges: DataFrame
    salt: str
    split: DataFrame


@dataclass
class StoredGraph(Graph):
    """A graph whose edges stand in tables by (type, end)."""

    sides: dict[tuple[str, str], Side] = field(default_factory=dict)

    def edges_at(self, type_: str, near: str, ids: DataFrame) -> DataFrame:
        """Only the ids move: each goes to the buckets of its parts, where it meets the edges."""
        side = self.sides[type_, near]
        kind = side.edges.schema[near].dataType
        asked = ids.select(F.col("id").cast(kind).alias(near)).filter(F.col(near).isNotNull()).distinct()
        parts = F.coalesce("_parts", F.lit(1))
        spread = asked.join(side.split.select(F.col("id").alias(near), F.col("parts").alias("_parts")), near, "left")
        spread = spread.select(near, F.explode(F.sequence(F.lit(0), parts - 1)).alias(side.salt))
        return side.edges.join(spread.hint("shuffle_hash"), [near, side.salt], "left_semi").drop(side.salt)


def _side(edges: DataFrame, near: str, part: int, bucket: int) -> Side:
    spark, name = edges.sparkSession, f"edges_{uuid.uuid4().hex}"
    salt = "_salt"
    while salt.lower() in {c.lower() for c in edges.columns}:
        salt = f"_{salt}"
    other = ENDS[1 - ENDS.index(near)]
    total = edges.count()
    most = max(part, total // MOST_SPLIT)
    degrees = edges.groupBy(F.col(near).alias("id")).agg(F.count("*").alias("n")).filter(F.col("n") > most)
    folder = shared_folder(spark, "split-nodes")
    degrees.select("id", F.ceil(F.col("n") / part).cast("int").alias("parts")).write.parquet(folder)
    split = spark.read.parquet(folder)
    found = F.broadcast(split.select(F.col("id").alias("_split"), F.col("parts").alias("_parts")))
    place = F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(other), F.col("_parts"))).cast("int")
    salted = edges.join(found, F.col(near) == F.col("_split"), "left").select(*edges.columns, place.alias(salt))
    buckets = max(-(-total // bucket), int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = salted.repartition(buckets, near, salt).write.bucketBy(buckets, near, salt).sortBy(near, salt)
    rows.option("path", shared_folder(spark, "edges")).format("parquet").saveAsTable(name)
    return Side(spark.read.table(name), salt, split)


def store_graph(graph: Graph, types: list[str] | None = None, part: int = PART, bucket: int = BUCKET) -> StoredGraph:
    """The graph with its edges (of the given types, or all) written by either end to the shared folder; nodes stay as they are.

    Edges without one of their ends are left out, as no pattern finds them; repeated edges and loops are kept. At most
    MOST_SPLIT nodes are split: those of more than `part` edges, or in very large graphs of more than that share of all.
    The files stay in the folder until `drop` removes them.
    """
    sides, edges = {}, {}
    for type_ in types or list(graph.edges):
        whole = graph.edges[type_].dropna(subset=list(ENDS))
        for near in ENDS:
            sides[type_, near] = _side(whole, near, part, bucket)
        by_source = sides[type_, "source_id"]
        edges[type_] = by_source.edges.drop(by_source.salt)
    return StoredGraph(graph.nodes, edges, graph.ends, sides)


def drop(graph: StoredGraph) -> None:
    """Removes the files of a stored graph once nothing reads it any more; the tables' names stay in the catalog."""
    for side in graph.sides.values():
        context = side.split.sparkSession.sparkContext
        for folder in {f.rpartition("/")[0] for df in (side.edges, side.split) for f in df.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    graph.sides.clear()
