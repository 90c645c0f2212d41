"""What the two vector searches share: vectors that take part, shards of them, and sets of queries that meet every shard's index."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Up to so many kinds of vectors (dimension and band) their counts are broadcast.
FEW_KINDS = 10_000


def usable(vectors: DataFrame, zero: bool = True) -> DataFrame:
    """(vec_id long, v array<double>): rows with an id whose vector is not null or empty and has finite components only."""
    v = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & (F.size(F.coalesce(v, F.array())) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    if not zero:
        fine &= F.exists(v, lambda x: x != 0)
    return vectors.filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def dealt(rows: DataFrame, kinds: Sequence[str], size: Column, name: str) -> DataFrame:
    """Rows (of a stored table) with `name`: parts of about equal numbers, `size` or so, within each kind, dealt by hash."""
    counts = rows.groupBy(*kinds).agg(F.count("*").alias("_n"))
    if counts.count() <= FEW_KINDS:
        counts = F.broadcast(counts)
    parts = F.ceil(F.col("_n") / size).cast("int")
    return rows.join(counts, list(kinds)).withColumn(name, F.pmod(F.xxhash64("vec_id", "v"), parts).cast("int")).drop("_n")


def query_sets(asked: DataFrame, size: int) -> DataFrame:
    """(dim, query_set, query_ids, queries): the queries of one dimension, packed. asked: (vec_id, v), of a stored table."""
    rows = dealt(asked.withColumn("dim", F.size("v")), ["dim"], F.lit(float(size)), "query_set")
    packed = lambda t: pa.table({"dim": t["dim"][:1], "query_set": t["query_set"][:1], **as_binary(*matrix(t["vec_id"], t["v"]), "query_ids", "queries")})
    return rows.groupBy("dim", "query_set").applyInArrow(packed, "dim int, query_set int, query_ids binary, queries binary")


def meet(index: DataFrame, keys: Sequence[str], sets: DataFrame, search: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """search(rows of one shard's index, one set of queries) for every shard and set of a dimension: a stated query set against all rows.

    index: a stored table with dim among its keys. Which shard meets which set is decided on narrow rows; then each pair is
    a group of its own, so any task may take it, and it holds one shard and one set of bounded size.
    """
    pairs = index.select(*keys).distinct().join(sets.select("dim", "query_set"), "dim")
    left, right = index.join(pairs, list(keys)), sets.join(pairs, ["dim", "query_set"])
    left, right = (x.toDF(*x.columns).groupBy(*keys, "query_set") for x in (left, right))
    return left.cogroup(right).applyInArrow(search, schema)


def matrix(ids, vectors) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of rows, by id (then by vector), so that ties fall to smaller ids."""
    ids = np.asarray(ids.combine_chunks(), np.int64)
    table = np.asarray(vectors.combine_chunks().flatten(), float).reshape(len(ids), -1)
    order = np.lexsort((*table.T[::-1], ids))
    return ids[order], table[order]


def as_binary(ids: np.ndarray, vectors: np.ndarray, *names: str) -> dict[str, pa.Array]:
    return {n: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for n, x in zip(names, (ids, vectors), strict=True)}


def from_binary(table: pa.Table, ids: str, vectors: str) -> tuple[np.ndarray, np.ndarray]:
    number = np.frombuffer(table[ids][0].as_py(), np.int64)
    return number, np.frombuffer(table[vectors][0].as_py(), float).reshape(len(number), -1)


def best(found: DataFrame, k: int) -> DataFrame:
    """Of rows (query_id, vec_id, score): each query's k highest scores, ties to smaller vec_id, with their ranks.

    A query's rows are at most k from each shard, so a window over a query holds no more than that.
    """
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
