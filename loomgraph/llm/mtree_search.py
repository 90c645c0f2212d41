"""Exact top-k search by inner product in M-trees, best first.

Vectors become integers floor(SCALE * x). The inner product is no metric, so a shard with largest squared length R
adds to each vector x the component sqrt(R - |x|^2) and to a query 0: |q' - x'|^2 = |q|^2 + R - 2 q.x, and the
nearest by this distance have the highest products. Candidates are dealt to shards of a bounded size by hash; each
shard is bulk-loaded once into an M-tree of pages, which are rows of a stored table: a page's entries have a routing
vector, a covering radius, the page below, and the distance to the routing vector of the page itself; leaves hold ids and
vectors. Sets of queries meet every shard's pages (a stated query set against all rows); a query walks a
tree best first, by the least distance that an entry's ball allows. Before an entry's distance is computed, the stored
parent distances bound it from below by the triangle inequality, and entries that can't beat the k-th best yet are
passed over without a computation. Products are sums of integers, so scores and ties are exact as long as they are
below 2^53 (components of up to about 3e5 in 64 dimensions); floors beyond 2^63 saturate. The bounds have
a margin for the rounding of distances.

Vectors that are null or empty or hold null, NaN or infinite components, and rows without vec_id, take no part.
Queries meet candidates of their own dimension. Rows with a query's vec_id count as the query's own; equal rows count
once; of different vectors with one vec_id each is a candidate, and the smallest is the query. Without candidates a
query has no rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .vectors import best, dealt, from_binary, matrix, meet, query_sets, usable

SCALE, PAGE, QUERIES = 256, 256, 2048
#: Vectors in a shard, and components (which make shards of long vectors smaller).
SHARD, COMPONENTS = 16384, 1 << 22
MARGIN = 1e-6


@dataclass
class Page:
    """Entries with their distances (`away`) to the page's own routing vector: vectors of a leaf, or routing vectors with radii and pages."""

    away: np.ndarray
    points: np.ndarray
    ids: np.ndarray | None = None
    radii: np.ndarray | None = None
    pages: np.ndarray | None = None


def _distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((points - centre) ** 2).sum(1), 0))


class MTree:
    """Pages, the root first; points have the further component, `centre` is the root's routing vector."""

    def __init__(self, pages: list[Page], centre: np.ndarray, largest: float):
        self.pages, self.centre, self.largest = pages, centre, largest

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, page: int = PAGE) -> MTree:
        """Bulk loading: up to `page` sampled routing vectors, every row to the nearest, and so on within each."""
        squares = (vectors**2).sum(1)
        largest = float(squares.max())
        points, random = np.column_stack((vectors, np.sqrt(largest - squares))), np.random.default_rng(7)
        tree = cls([], points.mean(0), largest)
        tree._load(ids, points, np.arange(len(ids)), tree.centre, page, random)
        return tree

    def _load(self, ids: np.ndarray, points: np.ndarray, rows: np.ndarray, centre: np.ndarray, page: int, random: np.random.Generator) -> int:
        number, away = len(self.pages), _distances(points[rows], centre)
        if len(rows) <= page:
            self.pages.append(Page(away, points[rows], ids=ids[rows]))
            return number
        parts = min(page, -(-len(rows) // page) + 1)
        seeds = points[random.choice(rows, parts, replace=False)]
        nearest = np.argmin((seeds**2).sum(1) - 2 * points[rows] @ seeds.T, 1)
        groups = [rows[nearest == k] for k in range(parts)]
        if max(map(len, groups)) > 0.9 * len(rows):  # many equal vectors: cut by distance instead
            groups = np.array_split(rows[np.argsort(away, kind="stable")], parts)
            seeds = np.stack([points[g[len(g) // 2]] for g in groups])
        kept = [k for k, g in enumerate(groups) if len(g)]
        radii = np.array([_distances(points[groups[k]], seeds[k]).max() for k in kept])
        self.pages.append(own := Page(_distances(seeds[kept], centre), seeds[kept], radii=radii))
        own.pages = np.array([self._load(ids, points, groups[k], seeds[k], page, random) for k in kept], np.int32)
        return number

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[list[tuple[int, int]], int]:
        """(score, vec_id), best first; and the number of distances computed."""
        point = np.append(query, 0.0)
        whole = float((query**2).sum()) + self.largest
        found: list[tuple[float, int]] = []  # a heap of (score, -vec_id): the worst first
        computed, count = 1, 1
        start = float(np.sqrt(((point - self.centre) ** 2).sum()))
        queue: list[tuple[float, int, float, int]] = [(0.0, 0, start, 0)]
        reach = np.inf
        while queue:
            least, _, parent, number = heapq.heappop(queue)
            if least > reach + MARGIN:
                break
            page = self.pages[number]
            if page.ids is not None:
                near = np.flatnonzero(np.abs(parent - page.away) <= reach + MARGIN)
                computed += len(near)
                products = page.points[near] @ point  # the further component meets a 0
                if len(found) == k:
                    better = products >= found[0][0]
                    near, products = near[better], products[better]
                for score, vec_id in zip(products.tolist(), page.ids[near].tolist(), strict=True):
                    if vec_id != own:
                        entry = (score, -vec_id)
                        if len(found) < k:
                            heapq.heappush(found, entry)
                        elif entry > found[0]:
                            heapq.heapreplace(found, entry)
                if len(found) == k:
                    reach = max(whole - 2 * found[0][0], 0.0) ** 0.5
            else:
                near = np.flatnonzero(np.abs(parent - page.away) - page.radii <= reach + MARGIN)
                computed += len(near)
                for j, d in zip(near.tolist(), _distances(page.points[near], point).tolist(), strict=True):
                    low = max(0.0, d - page.radii[j])
                    if low <= reach + MARGIN:
                        heapq.heappush(queue, (low, count, d, int(page.pages[j])))
                        count += 1
        return [(int(s), -i) for s, i in sorted(found, key=lambda x: (-x[0], -x[1]))], computed

    def table(self, dim: int, shard: int) -> pa.Table:
        """A row for each page."""
        raw = lambda x: None if x is None else np.ascontiguousarray(x).tobytes()
        columns = {c: pa.array([raw(getattr(p, c)) for p in self.pages], pa.binary()) for c in ("away", "points", "ids", "radii", "pages")}
        n = len(self.pages)
        return pa.table({"dim": pa.array([dim] * n, pa.int32()), "shard": pa.array([shard] * n, pa.int32()), "page": pa.array(range(n), pa.int32()), "largest": pa.array([self.largest] * n), "centre": pa.array([self.centre.tobytes(), *[None] * (n - 1)], pa.binary()), **columns})

    @classmethod
    def from_table(cls, table: pa.Table) -> MTree:
        table = table.sort_by("page")
        centre = np.frombuffer(table["centre"][0].as_py(), float)
        array = lambda row, c, kind: None if row[c] is None else np.frombuffer(row[c], kind)
        pages = [Page(array(r, "away", float), array(r, "points", float).reshape(-1, len(centre)), array(r, "ids", np.int64), array(r, "radii", float), array(r, "pages", np.int32)) for r in table.select(["away", "points", "ids", "radii", "pages"]).to_pylist()]
        return cls(pages, centre, table["largest"][0].as_py())


def _build(group: pa.Table) -> pa.Table:
    return MTree.build(*matrix(group["vec_id"], group["v"])).table(group["dim"][0].as_py(), group["shard"][0].as_py())


def _search(k: int):
    def run(pages: pa.Table, asked: pa.Table) -> pa.Table:
        tree, (ids, queries) = MTree.from_table(pages), from_binary(asked, "query_ids", "queries")
        out = [(q, i, s, n) for q, v in zip(ids.tolist(), queries, strict=True) for found, n in [tree.search(v, q, k)] for s, i in found]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 4)], ["query_id", "vec_id", "score", "distances"])

    return run


def mtree_search(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k highest integer inner products."""
    whole = F.transform("v", lambda x: F.floor(F.lit(float(SCALE)) * x).cast("double"))
    rows = stored(usable(vectors).withColumn("v", whole).dropDuplicates().withColumn("dim", F.size("v")), "mtree-vectors")
    asked = stored(rows.filter(is_query).groupBy("vec_id", "dim").agg(F.min("v").alias("v")).select("vec_id", "v"), "mtree-queries")
    size = F.greatest(F.lit(1024.0), F.least(F.lit(float(SHARD)), F.lit(float(COMPONENTS)) / F.col("dim")))
    pages = dealt(rows, ["dim"], size, "shard").groupBy("dim", "shard").applyInArrow(_build, "dim int, shard int, page int, largest double, centre binary, away binary, points binary, ids binary, radii binary, pages binary")
    found = meet(stored(pages, "mtree-pages"), ["dim", "shard"], query_sets(asked, QUERIES), _search(k), "query_id long, vec_id long, score long, distances long")
    return best(found, k)


ORACLE_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings),
     p AS (SELECT q.vec_id AS query_id, e.vec_id, CAST(list_dot_product(q.v, e.v) AS BIGINT) AS score FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0),
     r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 5
"""
