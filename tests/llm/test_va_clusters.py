"""Clustering against plain Lloyd rounds on integers."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from loomgraph.llm import va_clusters as V

SCHEMA = "vec_id long, embedding array<double>, cluster string, row int, q double"


def brute(rows, k=8, rounds=10, dimensions=64):
    kept = []
    for key, v in rows:
        if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v):
            kept.append((key, [math.floor(min(max(x * 1024, -V.LARGEST), V.LARGEST)) for x in v]))
    digest = lambda key: hashlib.sha256(f"3:{'' if key is None else key}".encode()).hexdigest()
    centroids = [q for _, q in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    for n in range(rounds + 1):
        far = [[sum((x - c) ** 2 for x, c in zip(q, m, strict=True)) for m in centroids] for _, q in kept]
        best = [min(range(len(f)), key=lambda j: (f[j], j)) for f in far]
        if n < rounds:
            for j in set(best):
                own = [q for (_, q), b in zip(kept, best, strict=True) if b == j]
                centroids[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    each = [sum(f[b] for f, b in zip(far, best, strict=True) if b == j) for j in range(len(centroids))]
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((-1 if key is None else key), b, f[b], each[b], sum(each), hashes[b]) for (key, _), f, b in zip(kept, far, best, strict=True))


def got(df):
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in df.collect())


def vectors(seed, n, spread):
    r = random.Random(seed)
    centres = [[r.gauss(0, 0.2) for _ in range(64)] for _ in range(5)]
    rows = [(k, [c + r.gauss(0, spread) for c in r.choice(centres)]) for k in range(n)]
    bad = list(rows[0][1])
    rows += [(900, None), (901, []), (902, [1.0] * 63), (903, [*bad[:63], None]), (904, [*bad[:63], math.nan]), (905, [*bad[:63], math.inf])]
    return rows + [(None, rows[1][1]), (None, rows[2][1]), rows[3], rows[3], (3, rows[4][1])]


@pytest.mark.parametrize(("seed", "n", "spread"), [(1, 120, 0.15), (2, 60, 0.01)])
def test_clusters_against_plain_rounds(spark, seed, n, spread):
    rows = vectors(seed, n, spread)
    found, fetched = V.clustered(spark.createDataFrame([(*x, "c", 1, 0.5) for x in rows], SCHEMA).repartition(3))
    assert got(found) == brute(rows)
    assert len(fetched) == 10
    if spread < 0.1:
        assert fetched[-1] < 45  # intervals decide the rest


@pytest.mark.parametrize("n", [0, 3])
def test_few_vectors(spark, n):
    rows = [(k, [float(k % 2)] * 64) for k in range(n)]
    assert got(V.va_clusters(spark.createDataFrame([(*x, "c", 1, 0.5) for x in rows], SCHEMA))) == brute(rows)


def test_equal_and_huge_vectors(spark):
    """All vectors equal (clusters stay empty), and components beyond what is kept."""
    for rows in ([(k, [0.25] * 64) for k in range(30)], [(k, [(-1.0) ** k * 1e9 * (k % 3)] * 64) for k in range(20)]):
        assert got(V.va_clusters(spark.createDataFrame([(*x, "c", 1, 0.5) for x in rows], SCHEMA))) == brute(rows)


def test_intervals_hold_the_distance():
    r = np.random.default_rng(5)
    q = np.floor(r.normal(0, 120, (500, 64))).astype(np.int64)
    bounds = np.stack([np.array([x.min(), *sorted(r.integers(x.min(), x.max(), (1 << V.BITS) - 1)), x.max() + 1]) for x in q.T])
    centroids = np.floor(r.normal(0, 60, (8, 64))).astype(np.int64)
    least, most = V.lookup_tables(centroids, bounds)
    codes, place = V.cells(q, bounds), np.arange(64)
    middle = ((q - centroids.sum(0) // 8) ** 2).sum(1)
    for j, c in enumerate(centroids):
        away = ((q - c) ** 2).sum(1) - middle
        assert (least[j][place, codes].sum(1) <= away).all() and (away <= most[j][place, codes].sum(1)).all()
    decided = V.decide(codes, least, most)
    assert ((decided == -1) | (decided == V.nearest(q, centroids)[0])).all()
