"""Approximate nearest neighbours by inner product in robust-pruned directed graphs.

Vectors are dealt by hash to shards of a bounded size and of norms that differ by less than a factor of four; every vector
is indexed. A shard's vectors are divided by the largest norm, and a further component makes their Euclidean order (from a
query with 0 there) that of the inner product; as long and short vectors don't share a shard, single precision is enough
to lead a search. A shard's graph starts at random.
Then, in batches and two passes, a greedy search from the medoid proposes the vectors it visited as neighbours; pruning
goes through them nearest first and drops those that are nearer to a kept neighbour, times a relaxation (1 in the first
pass, RELAXED in the second), than to the vector itself. Edges back are added and pruned likewise where a node has half as
many again as it may keep, and at the end.
Graphs are built once and stored, a row for each shard. Sets of queries meet every shard.
A search keeps the BEAM nearest vectors met so far and expands the nearest one that isn't expanded yet, for many queries
at a time; the results of the shards are merged by the products of the original vectors, in double precision.

Vectors of a shard that are equal in single precision are one node: pruning would cut off all but one of them. A found
node stands for all its vectors, of which the products decide; of equal ones the smallest ids go in, as many as can count.

Vectors that are null, zero or empty, or hold null, NaN or infinite components, and rows without vec_id, take no part.
Queries meet candidates of their own dimension. Rows with a query's vec_id count as its own; equal rows count once; of
different vectors with one vec_id each is a candidate and the smallest is the query. Ties go to the smaller vec_id. Shards
of no more than BEAM nodes are searched whole. Without candidates a query has no rows. Extra columns are ignored.
Products beyond a double's range are infinite.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .vectors import as_binary, best, dealt, from_binary, matrix, meet, query_sets, usable

#: Vectors in a shard, and components (which make shards of long vectors smaller).
SHARD, COMPONENTS = 16384, 1 << 22
DEGREE, BUILD_BEAM, BEAM, RELAXED, BATCH = 28, 40, 160, 1.2, 512
#: Queries in a set.
QUERIES = 4096
#: Products of found vectors and queries that are computed at a time.
PAIRS = 1 << 16


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Divided by the largest norm, by way of the largest component: no square leaves a double's range."""
    vectors = vectors / np.abs(vectors).max()
    return vectors / np.sqrt((vectors**2).sum(1).max())


class Nodes:
    """The distinct points of a shard and the vectors that each stands for: one for all that are equal in single precision."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        same = np.unique(vectors, axis=0, return_inverse=True)[1].ravel()
        order = np.argsort(same, kind="stable")  # by id within equal ones
        place = np.arange(len(order)) - np.searchsorted(same[order], same[order])
        kept = np.sort(order[place <= k])  # one of them may be the query's own
        ids, vectors = ids[kept], vectors[kept]
        scaled = _scaled(vectors)
        _, first, node = np.unique(scaled.astype(np.float32), axis=0, return_index=True, return_inverse=True)
        order = np.argsort(node.ravel(), kind="stable")
        self.ids, self.vectors, self.points = ids[order], vectors[order], scaled[first]
        self.edges = np.searchsorted(node.ravel()[order], np.arange(len(first) + 1))

    def best(self, found: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of the vectors of each query's found nodes (-1: none): query, id and product of the k first, for some queries at a time."""
        size = np.where(found >= 0, np.diff(self.edges)[found], 0)
        total = np.cumsum(size.sum(1))
        at = 0
        while at < len(found):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
            n = size[at:end].ravel()
            line = np.repeat(np.arange(at, end), size[at:end].sum(1))
            member = np.repeat(self.edges[found[at:end].ravel()], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            keep = self.ids[member] != own[line]
            line, member = line[keep], member[keep]
            score = np.einsum("ij,ij->i", self.vectors[member], queries[line])
            order = np.lexsort((self.ids[member], -score, line))
            line, member, score = line[order], member[order], score[order]
            keep = np.arange(len(line)) - np.searchsorted(line, line) < k
            yield line[keep], self.ids[member[keep]], score[keep]
            at = end


class Graph:
    def __init__(self, vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relaxed: float = RELAXED, edges: np.ndarray | None = None):
        """vectors: of norms up to 1. edges: of a graph of these vectors that was built before."""
        squares = (vectors**2).sum(1)
        self.points = np.column_stack((vectors, np.sqrt(np.maximum(squares.max() - squares, 0)))).astype(np.float32)
        self.squares = (self.points**2).sum(1)
        n = len(vectors)
        self.entry = int(np.argmin(self.squares - 2 * self.points @ self.points.mean(0)))
        random = np.random.default_rng(11)
        self.degree = min(degree, n - 1)
        self.edges = np.full((n, self.degree + self.degree // 2), -1, np.int64)
        self.distances = 0
        if edges is not None:
            self.edges = edges.reshape(n, self.degree)
        if n <= BEAM or edges is not None:
            self.edges = self.edges[:, : self.degree]
            return
        self.edges[:, : self.degree] = random.integers(0, n, (n, self.degree))
        for slack in (1.0, relaxed):
            order = random.permutation(n)
            for at in range(0, n, BATCH):
                self._insert(order[at : at + BATCH], beam, slack)
        many = np.flatnonzero((self.edges >= 0).sum(1) > self.degree)
        for at in range(0, len(many), BATCH):
            self._prune(many[at : at + BATCH], self.edges[many[at : at + BATCH]], relaxed)
        self.edges = -np.sort(-self.edges, 1)[:, : self.degree]

    def beam_search(self, queries: np.ndarray, width: int, visits: bool = False) -> np.ndarray:
        """The `width` nearest nodes found for each query, nearest first (-1: fewer), or all those expanded."""
        m, n = len(queries), len(self.points)
        lines = np.arange(m)
        nodes, far = np.full((m, width), -1, np.int64), np.full((m, width), np.inf, np.float32)
        done = np.ones((m, width), bool)
        nodes[:, 0], done[:, 0] = self.entry, False
        far[:, 0] = self.squares[self.entry] - 2 * queries @ self.points[self.entry]
        met = np.zeros((m, n), bool)
        met[:, self.entry] = True
        expanded: list[np.ndarray] = []
        while True:
            open_ = np.where(done, np.inf, far)
            at = open_.argmin(1)
            live = np.flatnonzero(open_[lines, at] < np.inf)
            if not len(live):
                break
            node = nodes[live, at[live]]
            done[live, at[live]] = True
            if visits:
                step = np.full(m, -1, np.int64)
                step[live] = node
                expanded.append(step)
            near = self.edges[node]
            fresh = (near >= 0) & ~met[live[:, None], near]
            near = np.sort(np.where(fresh, near, -1), 1)
            fresh = near >= 0
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            row, col = np.nonzero(fresh)
            self.distances += len(row)
            flat = near[row, col]
            met[live[row], flat] = True
            away = np.full(near.shape, np.inf, np.float32)
            away[row, col] = self.squares[flat] - 2 * np.einsum("ij,ij->i", self.points[flat], queries[live[row]])
            all_far = np.concatenate((far[live], away), 1)
            all_nodes = np.concatenate((nodes[live], np.where(fresh, near, -1)), 1)
            all_done = np.concatenate((done[live], ~fresh), 1)
            keep = np.argpartition(all_far, width - 1, 1)[:, :width]
            far[live], nodes[live], done[live] = (np.take_along_axis(x, keep, 1) for x in (all_far, all_nodes, all_done))
        if visits:
            return np.stack(expanded, 1)
        order = np.argsort(far, 1, kind="stable")
        return np.take_along_axis(np.where(np.isinf(far), -1, nodes), order, 1)

    def _prune(self, nodes: np.ndarray, proposed: np.ndarray, slack: float) -> None:
        """Robust pruning of the proposed neighbours (-1: none) of these nodes, all nodes at a time."""
        proposed = np.sort(np.where(proposed == nodes[:, None], -1, proposed), 1)
        proposed[:, 1:][proposed[:, 1:] == proposed[:, :-1]] = -1
        # Seen from the node, in double precision: near copies of it are not drowned by the length of the vectors.
        centre = self.points[nodes].astype(float)
        apart = self.points[proposed] - centre[:, None]
        away = np.where(proposed >= 0, np.einsum("ijk,ijk->ij", apart, apart), np.inf)
        order = np.argsort(away, 1, kind="stable")[:, : 3 * self.degree]
        proposed, away = np.take_along_axis(proposed, order, 1), np.take_along_axis(away, order, 1)
        apart = np.take_along_axis(apart, order[:, :, None], 1)
        squares = np.einsum("ijk,ijk->ij", apart, apart)
        between = squares[:, :, None] + squares[:, None, :] - 2 * (apart @ apart.transpose(0, 2, 1))
        alive = np.isfinite(away)
        kept = np.full((len(nodes), self.degree), -1, np.int64)
        lines = np.arange(len(nodes))
        for k in range(self.degree):
            first = alive.argmax(1)
            some = alive[lines, first]
            if not some.any():
                break
            kept[some, k] = proposed[lines[some], first[some]]
            alive &= ~(slack * slack * between[lines, first] <= away)
            alive[lines, first] = False
        self.edges[nodes] = -1
        self.edges[nodes, : self.degree] = kept

    def _insert(self, nodes: np.ndarray, beam: int, slack: float) -> None:
        visited = self.beam_search(self.points[nodes], beam, visits=True)
        self._prune(nodes, np.concatenate((visited, self.edges[nodes]), 1), slack)
        source, target = np.repeat(nodes, self.edges.shape[1]), self.edges[nodes].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        ends, first, count = np.unique(target, return_index=True, return_counts=True)
        for at in range(0, len(ends), BATCH):
            some, number = ends[at : at + BATCH], count[at : at + BATCH]
            back = np.full((len(some), int(number.max())), -1, np.int64)
            line = np.repeat(np.arange(len(some)), number)
            place = np.arange(len(line)) - np.repeat(np.cumsum(number) - number, number)
            back[line, place] = source[first[at] : first[at] + len(line)]
            both = -np.sort(-np.concatenate((self.edges[some], back), 1), 1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            both = -np.sort(-both, 1)
            room = self.edges.shape[1]
            full = (both >= 0).sum(1) > room
            self.edges[some[~full]] = both[~full, :room]
            if full.any():
                self._prune(some[full], both[full], slack)


def _build(k: int):
    def run(group: pa.Table) -> pa.Table:
        ids, vectors = matrix(group["vec_id"], group["v"])
        graph = Graph(Nodes(ids, vectors, k).points)
        edges = np.where(graph.edges < 0, np.iinfo(np.uint16).max, graph.edges).astype(np.uint16)
        return pa.table({**{x: group[x][:1] for x in ("dim", "band", "shard")}, **as_binary(ids, vectors, "ids", "vectors"), "edges": pa.array([edges.tobytes()], pa.binary())})

    return run


def _search(k: int):
    def run(shard: pa.Table, asked: pa.Table) -> pa.Table:
        nodes = Nodes(*from_binary(shard, "ids", "vectors"), k)
        edges = np.frombuffer(shard["edges"][0].as_py(), np.uint16).astype(np.int64)
        edges[edges == np.iinfo(np.uint16).max] = -1
        graph = Graph(nodes.points, edges=edges)
        query_ids, queries = from_binary(asked, "query_ids", "queries")
        out: list[tuple[np.ndarray, ...]] = []
        for at in range(0, len(query_ids), BATCH):
            some, own = queries[at : at + BATCH], query_ids[at : at + BATCH]
            if len(nodes.points) <= BEAM:
                found = np.tile(np.arange(len(nodes.points)), (len(own), 1))
            else:
                found = graph.beam_search(np.column_stack([_directions(some), np.zeros(len(some))]).astype(np.float32), BEAM)
            out += [(own[line], ids, score) for line, ids, score in nodes.best(found, some, own, k)]
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    return run


def _directions(queries: np.ndarray) -> np.ndarray:
    """The queries with a norm of 1: their lengths don't change the order of the products."""
    queries = queries / np.abs(queries).max(1, keepdims=True)
    return queries / np.sqrt((queries**2).sum(1, keepdims=True))


def graph_search(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found for each query."""
    rows = usable(vectors, zero=False).dropDuplicates().withColumn("dim", F.size("v"))
    largest = F.array_max(F.transform("v", F.abs))
    squares = F.aggregate(F.transform("v", lambda x: F.pow(x / largest, 2)), F.lit(0.0), lambda a, x: a + x)
    rows = stored(rows.withColumn("band", F.floor((F.log2(largest) + F.log2(squares) / 2 + 1) / 2).cast("int")), "graph-vectors")
    asked = stored(rows.filter(is_query).groupBy("vec_id", "dim").agg(F.min("v").alias("v")).select("vec_id", "v"), "graph-queries")
    size = F.greatest(F.lit(1024.0), F.least(F.lit(float(SHARD)), F.lit(float(COMPONENTS)) / F.col("dim")))
    shards = dealt(rows, ["dim", "band"], size, "shard").groupBy("dim", "band", "shard")
    index = stored(shards.applyInArrow(_build(k), "dim int, band int, shard int, ids binary, vectors binary, edges binary"), "graph-index")
    found = meet(index, ["dim", "band", "shard"], query_sets(asked, QUERIES), _search(k), "query_id long, vec_id long, score double")
    return best(found, k)
