"""Centroid clustering on a VA-file: every vector has a short approximation, and full vectors are fetched only where it can't decide.

A vector's approximation holds, for each component, the cell of BITS bits in which it lies. The cells of a component are
bounded by quantiles of a normal law with that component's mean and a little more than its spread, the outermost ones
by its smallest and largest value. For a round's centroids, lookup tables give each cell's least and largest share of
the squared distance, so a scan of the approximations knows an interval of the distance to each centroid. All these
distances are taken less that to the centroids' middle, which changes no order and leaves shares that are linear in the
component, so that intervals are as narrow as the centroids are near. Where one interval lies below all others the
centroid is known; where they overlap, the full vector is fetched and decides.

Full vectors stand in a table bucketed by row, so that a fetch moves the asked rows to it and not the table. The sums of
the clusters are exact: they begin with the first assignment, and then only vectors whose centroid changes are taken from
one sum and added to another; those are fetched as well. The driver holds centroids, sums and cell bounds, never vectors.

Vectors that are null, or haven't `dimensions` components, or hold null or non-finite ones, take no part. Components x become
floor(1024 * x), no further from 0 than LARGEST. Rows with equal vec_id are vectors of their own; as first centroids, equal
hashes go by their components. A null vec_id is hashed as an empty text. With fewer vectors than centroids there
are as many centroids as vectors. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, new_folder, stored

#: Bits of a cell, 8 at most, and the spread of its bounds: that of the least mean width for a normal law. Of vectors
#: without much structure 95, 43 and 8 of 100 are fetched in a round with 4, 6 and 8 bits.
BITS, SPREAD = 8, 2**0.5
LARGEST = 1 << 27
#: Vectors in one bucket of the full table.
BUCKET = 1 << 18


def whole_vectors(vectors: DataFrame, dimensions: int) -> DataFrame:
    """(vec_id, q array<int>): the vectors that take part, as integers."""
    v = F.col("embedding").cast("array<double>")
    fine = (F.size(v) == dimensions) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    bounded = lambda x: F.greatest(F.lit(float(-LARGEST)), F.least(F.lit(float(LARGEST)), x * 1024.0))
    return vectors.filter(F.coalesce(fine, F.lit(False))).select("vec_id", F.transform(v, lambda x: F.floor(bounded(x)).cast("int")).alias("q"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(len(column), -1)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch and component: number, sum, sum of squares, least and largest value."""
    for batch in batches:
        if len(batch):
            q = _matrix(batch.column("q"))
            each = [np.full(q.shape[1], len(q)), q.sum(0).astype(float), (q.astype(float) ** 2).sum(0), q.min(0), q.max(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(q.shape[1], dtype=np.int32)), *map(pa.array, each)], ["i", "n", "s", "ss", "low", "high"])


def cell_bounds(full: DataFrame) -> np.ndarray:
    """Per component the least values of its cells, and one more than its largest value: ascending integers."""
    parts = full.select("q").mapInArrow(_moments, "i int, n long, s double, ss double, low long, high long")
    rows = parts.groupBy("i").agg(F.sum("n"), F.sum("s"), F.sum("ss"), F.min("low"), F.max("high")).orderBy("i").collect()
    cuts = SPREAD * np.array([NormalDist().inv_cdf(k / (1 << BITS)) for k in range(1, 1 << BITS)])
    bounds = np.zeros((len(rows), (1 << BITS) + 1), np.int64)
    for i, (_, n, s, ss, low, high) in enumerate(rows):
        inner = np.round(s / n + cuts * np.sqrt(max(0.0, ss / n - (s / n) ** 2)))
        bounds[i] = [low, *np.clip(inner, low, high + 1), high + 1]
    return bounds


def cells(q: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The approximations: each component's cell."""
    return np.stack([np.searchsorted(b[1:-1], x, "right") for b, x in zip(bounds, q.T, strict=True)], 1).astype(np.uint8)


def lookup_tables(centroids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For (centroid, component, cell): the least and the largest share of the squared distance, less that to the middle."""
    middle = centroids.sum(0) // len(centroids)
    first, last = bounds[None, :, :-1], np.maximum(bounds[None, :, 1:] - 1, bounds[None, :, :-1])
    share = lambda x: ((centroids - middle)[:, :, None]) * ((centroids + middle)[:, :, None] - 2 * x)
    return np.minimum(share(first), share(last)), np.maximum(share(first), share(last))


def decide(codes: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The nearest centroid of each approximation, or -1 where intervals overlap."""
    place = np.arange(codes.shape[1])
    low, high = (np.stack([x[place, codes].sum(1) for x in table], 1) for table in (least, most))
    best = high.argmin(1)
    rivals = (low <= np.take_along_axis(high, best[:, None], 1)).sum(1)  # the best one is among them
    return np.where(rivals == 1, best, -1)


def nearest(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector (ties: the smaller number) and its squared distance."""
    far = np.stack([((q - c) ** 2).sum(1) for c in centroids], 1)
    best = far.argmin(1)
    return best, np.take_along_axis(far, best[:, None], 1)[:, 0]


_STATE = "row long, cells binary, cluster int"


def _begin(centroids: np.ndarray, bounds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                q = _matrix(batch.column("q"))
                codes = [x.tobytes() for x in cells(q, bounds)]
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(codes, pa.binary()), pa.array(nearest(q, centroids)[0].astype(np.int32))], ["row", "cells", "cluster"])

    return run


def _scan(centroids: np.ndarray, bounds: np.ndarray):
    least, most = lookup_tables(centroids, bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                codes = np.frombuffer(b"".join(batch.column("cells").to_pylist()), np.uint8).reshape(len(batch), -1)
                now = decide(codes, least, most)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(now.astype(np.int32))], [*batch.schema.names, "now"])

    return run


def _fetch(centroids: np.ndarray):
    """The exact centroid of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                now = nearest(_matrix(batch.column("q")), centroids)[0]
                columns = [batch.column(x) for x in ("row", "cells", "cluster", "q")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(now.astype(np.int32))], ["row", "cells", "cluster", "q", "now"])

    return run


def _moves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch: what its moves add to each cluster's number of vectors (i: -1) and to its sums (component i)."""
    for batch in batches:
        if len(batch):
            q, size = _matrix(batch.column("q")), np.ones((len(batch), 1), np.int64)
            q = np.concatenate((size, q), 1)
            was, now = (np.asarray(batch.column(x), np.int64) for x in ("cluster", "now"))
            total = np.zeros((int(max(was.max(), now.max())) + 1, q.shape[1]), np.int64)
            np.add.at(total, now, q)
            np.subtract.at(total, was[was >= 0], q[was >= 0])
            j, i = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(j.astype(np.int32)), pa.array((i - 1).astype(np.int32)), pa.array(total[j, i])], ["j", "i", "x"])


def _added(moved: DataFrame, sums: np.ndarray) -> None:
    """moved: rows (cluster, now, q). Their moves go into sums (number of vectors first)."""
    parts = moved.select("cluster", "now", "q").mapInArrow(_moves, "j int, i int, x long")
    for j, i, x in parts.groupBy("j", "i").agg(F.sum(F.col("x").cast("decimal(20,0)"))).collect():
        sums[j, i + 1] += int(x)


def _with_distance(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                q, cluster = _matrix(batch.column("q")), np.asarray(batch.column("cluster"), np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("cluster"), pa.array(((q - centroids[cluster]) ** 2).sum(1))], ["row", "cluster", "distance"])

    return run


def va_clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, dimensions: int = 64, seed: int = 3) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector; fetched: see `clustered`."""
    return clustered(vectors, k, rounds, dimensions, seed)[0]


def clustered(vectors: DataFrame, k: int = 8, rounds: int = 10, dimensions: int = 64, seed: int = 3) -> tuple[DataFrame, list[int]]:
    """The result, and how many full vectors each round after the first assignment fetched."""
    spark = vectors.sparkSession
    rows = stored(whole_vectors(vectors, dimensions).withColumn("row", F.monotonically_increasing_id()), "va-rows")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = [r["q"] for r in rows.select(order.alias("h"), "q").orderBy("h", "q").limit(k).collect()]
    if not first:
        return rows.select("vec_id", *(F.lit(0).cast(kind).alias(c) for c, kind in _RESULT)).limit(0), []
    centroids = np.array(first, np.int64)
    buckets = max(-(-rows.count() // BUCKET), int(spark.conf.get("spark.sql.shuffle.partitions")))
    name, folder = f"va_{uuid.uuid4().hex}", new_folder(spark, "va-full")
    rows.select("row", "q").repartition(buckets, "row").write.bucketBy(buckets, "row").sortBy("row").option("path", folder).format("parquet").saveAsTable(name)
    full = spark.table(name)
    bounds, sums, fetched = cell_bounds(full), np.zeros((len(first), dimensions + 1), object), []
    state = stored(full.mapInArrow(_begin(centroids, bounds), _STATE), "va-state")
    _added(full.join(state, "row").select(F.lit(-1).alias("cluster"), F.col("cluster").alias("now"), "q"), sums)
    tables = [state]
    for _ in range(rounds):
        centroids = np.array([[x // s[0] for x in s[1:]] if s[0] else list(c) for s, c in zip(sums, centroids, strict=True)], np.int64)
        scanned = stored(state.mapInArrow(_scan(centroids, bounds), f"{_STATE}, now int"), "va-scan")
        stays = F.col("now") == F.col("cluster")
        asked = scanned.filter(~stays).select("row", "cells", "cluster")
        got = stored(asked.join(full, "row").mapInArrow(_fetch(centroids), f"{_STATE}, q array<int>, now int"), "va-fetched")
        _added(got.filter(~stays), sums)
        fetched.append(got.count())
        discard(*tables)
        tables = [scanned, got]
        state = scanned.filter(stays).select("row", "cells", "cluster").unionByName(got.select("row", "cells", F.col("now").alias("cluster")))
    found = stored(full.join(state.select("row", "cluster"), "row").mapInArrow(_with_distance(centroids), "row long, cluster int, distance long"), "va-found")
    spark.sql(f"DROP TABLE {name}")
    discard(*tables, spark.read.parquet(folder))
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    total = lambda c: F.least(F.sum(F.col(c).cast("decimal(38,0)")), most).cast("long")
    each = found.groupBy("cluster").agg(total("distance").alias("cluster_inertia"))
    whole = each.agg(total("cluster_inertia").alias("inertia"))
    hashes = spark.createDataFrame([(j, ",".join(map(str, c.tolist()))) for j, c in enumerate(centroids)], "cluster int, centroid string")
    each = each.crossJoin(whole).join(hashes.select("cluster", F.sha2("centroid", 256).alias("centroid_sha256")), "cluster")  # k rows, with one row
    result = rows.select("row", "vec_id").join(found, "row").join(F.broadcast(each), "cluster")
    return result.select("vec_id", *(c for c, _ in _RESULT)), fetched


_RESULT = [("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string")]


def oracle_sql(k: int = 8, rounds: int = 10, dimensions: int = 64, seed: int = 3) -> str:
    """The same in DuckDB's SQL, a step a round."""
    steps = [
        f"v AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS r, [floor(x * 1024)::BIGINT FOR x IN embedding::DOUBLE[]] AS q FROM embeddings WHERE len(embedding) = {dimensions}"
        " AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding))",
        "x AS (SELECT r, unnest(range(1, len(q) + 1)) AS i, unnest(q) AS x FROM v)",
        f"c0 AS (SELECT j, i, x AS m FROM (SELECT r, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), q) - 1 AS j FROM v QUALIFY j < {k}) JOIN x USING (r))",
    ]
    for n in range(rounds + 1):
        steps.append(f"d{n} AS (SELECT r, j, sum((x - m) * (x - m))::BIGINT AS d FROM x JOIN c{n} USING (i) GROUP BY r, j)")
        steps.append(f"a{n} AS (SELECT r, j, d FROM d{n} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, j) = 1)")
        if n < rounds:
            steps.append(f"m{n} AS (SELECT j, i, floor(sum(x)::DOUBLE / count(*))::BIGINT AS m FROM a{n} JOIN x USING (r) GROUP BY j, i)")
            steps.append(f"c{n + 1} AS (SELECT c.j, c.i, coalesce(m.m, c.m) AS m FROM c{n} c LEFT JOIN m{n} m USING (j, i))")
    return (
        f"WITH {', '.join(s.replace(' AS (', ' AS MATERIALIZED (', 1) for s in steps)} SELECT vec_id, j::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY j))::BIGINT AS cluster_inertia,"
        f" (sum(d) OVER ())::BIGINT AS inertia, s AS centroid_sha256 FROM a{rounds} JOIN v USING (r) JOIN (SELECT j, sha256(string_agg(m::VARCHAR, ',' ORDER BY i)) AS s FROM c{rounds} GROUP BY j) USING (j)"
    )
