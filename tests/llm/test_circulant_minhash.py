"""Near-duplicates by circulant signatures against comparing all pairs."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from loomgraph.llm import bitmaps
from loomgraph.llm import circulant_minhash as M
from loomgraph.llm.jaccard_join import shingle_sets
from tests.llm.test_operators import brute_components, documents, prose


def found(df):
    rows = df.collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows)


def expected(texts, length=3, percent=85):
    return sorted((k, *x) for k, x in brute_components(texts, length, percent).items())


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_all_pairs(spark, seed):
    texts = prose(seed, n=70)
    assert found(M.circulant_minhash(documents(spark, texts).repartition(5))) == expected(texts)


def test_families_and_chains(spark, monkeypatch):
    """A large family of near copies, of which most don't link with the first one, and texts a word apart in a chain."""
    monkeypatch.setattr("loomgraph.llm.jaccard_join.BLOCK", 8)
    r = random.Random(7)
    base = [f"w{r.randint(0, 9999)}" for _ in range(80)]
    texts = []
    for _ in range(150):
        near = list(base)
        for _ in range(r.randint(0, 4)):
            near[r.randrange(80)] = f"x{r.randint(0, 9999)}"
        texts.append(" ".join(near))
    chain = list(base[:60])
    for k in range(40):
        chain[k] = f"y{k}"
        texts.append(" ".join(chain))
    assert found(M.circulant_minhash(documents(spark, texts))) == expected(texts)


def test_odd_rows(spark):
    assert found(M.circulant_minhash(documents(spark, []))) == []
    rows = [(None, "a b c d"), (None, "a b c d"), (5, "A b\tc d"), (7, None), (7, ""), (9, "a b"), (9, "a b"), (None, "zz"), (3, "x " * 50_000)]
    docs = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, row int, class_id int")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in M.circulant_minhash(docs).collect()), key=str)
    assert got == sorted([(None, 2, None, True)] * 2 + [(5, 2, None, False), (7, 0, 7, True), (7, 0, 7, True), (9, 1, 9, True), (9, 1, 9, True), (None, 1, None, True), (3, 1, 3, True)], key=str)


def test_coordinates_are_shifted_permutations():
    """Each coordinate is the least of one permutation, shifted by its number; equal coordinates estimate the similarity."""
    tokens, sizes = shingle_sets(pa.array(["a b c d e f g", "", "h i j k l"]), 3)
    got = M.signatures(tokens, sizes, 16)
    first = M._permuted((tokens ^ tokens >> np.uint64(32)).astype(np.uint32), (0x2C1B3C6D, 0x297A2D39))
    for k in range(16):
        second = M._permuted(first + np.uint32(k), (0x85EBCA6B, 0xC2B2AE35))
        assert got[0, k] == second[: sizes[0]].min() and got[2, k] == second[sizes[0] :].min() and got[1, k] == (1 << 32) - 1
    assert len(np.unique(M._permuted(np.arange(1 << 16, dtype=np.uint32), (0x85EBCA6B, 0xC2B2AE35)))) == 1 << 16
    r = np.random.default_rng(3)
    for share in (0.5, 0.85):
        both = r.integers(0, 1 << 63, 4000, dtype=np.uint64)
        common = int(4000 * 2 * share / (1 + share) / 2)
        one, two = np.concatenate((both[:common], both[common : 2000])), np.concatenate((both[:common], both[2000 : 4000 - common]))
        x = M.signatures(np.concatenate((one, two)), np.array([len(one), len(two)]), 1000)
        assert abs((x[0] == x[1]).mean() - common / (len(one) + len(two) - common)) < 0.06


def test_bitmap(spark):
    hashes = [1, -5, 2**62, 64, 65]
    bitmap = bitmaps.bitmap_of(spark.createDataFrame([(h,) for h in hashes], "h long"), 1 << 16)
    assert bitmaps.marked(bitmap, np.array(hashes).view(np.uint64)).all()
    assert not bitmaps.marked(bitmap, np.array([2, 66, 12345], np.uint64)).any()
