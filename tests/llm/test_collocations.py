"""Phrase mining against plain counting on small tables."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from loomgraph.llm import collocations as C
from tests.llm.test_operators import documents


def brute(rows, least, percent, limit):
    """rows (lang, text); the result as {(lang, rank): (phrase, a, l, r, n, score)}."""
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for k in (1, 2, 3, 4):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = {}
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        covered = {
            q[i : i + m]
            for q, a in candidates.items()
            for m in range(2, len(q))
            for i in range(len(q) - m + 1)
            if 100 * a >= percent * candidates[q[i : i + m]]
        }
        best = []
        for p, a in candidates.items():
            if p not in covered:
                score, _, left, right = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(best)[:limit], 1):
            out[lang, rank] = (phrase.decode(), -a, left, right, total[lang], -score)
    return out


def got(df):
    rows = df.collect()
    found = {(r["lang"], r["rank"]): (r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in rows}
    assert len(found) == len(rows)
    return found


def texts(seed, n=150):
    r = random.Random(seed)
    vocabulary = ["la", "Mo", "ti", "é", "xx", "q", "Ünd", "z" * 300]
    passage = [r.choice(vocabulary) + str(r.randint(0, 30)) for _ in range(70)]
    out = [None, "", " \t ", ". , \n", "la", "la.la la", "la " * 3000, "la mo " * 500 + "ti", "É É É é"]
    for _ in range(n):
        own = [r.choice(vocabulary) for _ in range(r.randint(1, 60))]
        if r.random() < 0.4:
            at = r.randint(0, 50)
            own += passage[at : at + r.randint(1, 70)]
        out.append("".join(w + r.choice([" ", " ", "  ", "\t", ", ", ".\n", "\r", "\x0b", " "]) for w in own))
    return out + out[:5] + [out[-1]] * 40


@pytest.mark.parametrize(("seed", "least", "ranges"), [(1, 5, 100), (2, 12, 1 << 20), (3, 30, 7)])
def test_collocations_against_counting(spark, monkeypatch, seed, least, ranges):
    monkeypatch.setattr(C, "RANGE", ranges)
    r = random.Random(seed)
    rows = [(r.choice(["en", "en", "de", None, "und"]), t) for t in texts(seed)]
    docs = spark.createDataFrame([(k, x, t, 1.0, "k", 2) for k, (x, t) in enumerate(rows)], "doc_id long, lang string, text string, score double, phrase string, n int").repartition(3)
    for limit in (2000, 3):
        assert got(C.collocations(docs, least=least, limit=limit)) == brute(rows, least, 80, limit)


def test_hot_pairs_are_dealt_by_three_words(spark, monkeypatch):
    """A pair that begins nearly all edges: its edges are in many ranges, and the counts stay right."""
    monkeypatch.setattr(C, "RANGE", 50)
    rows = [("en", f"of the w{k % 37} v{k % 11}. of the end") for k in range(600)]
    docs = documents(spark, [t for _, t in rows])
    assert got(C.collocations(docs, least=10)) == brute(rows, 10, 80, 2000)
    ids, follow, before = C._pieces(docs.select("text").toArrow()["text"].combine_chunks())
    pair = C._edges(ids, follow, np.arange(len(ids)), "en")[0]
    pairs, counts = np.unique(pair, return_counts=True)
    top = pairs[[counts.argmax()]]
    cells = C._cells(ids, follow, np.arange(len(ids)), "en", 64, top)
    plain = C._cells(ids, follow, np.arange(len(ids)), "en", 64, top[:0])
    assert max(len(x) for _, x in cells) < max(len(x) for _, x in plain)


def test_paths_are_compacted(spark):
    """A passage of 100 words, repeated: one path holds all its edges; a branch ends it."""
    words = [f"w{k}" for k in range(100)]
    rows = [" ".join(words)] * 6 + [" ".join(words[:50] + ["other"])] * 5
    docs = documents(spark, rows).select("lang", "text")
    phrases = C.frequent_phrases(docs, 5, 1000, [])
    paths, inner = C.unary_paths(phrases)
    assert sorted((len(r["path"]), r["f"]) for r in paths.collect()) == [(4, 5), (50, 11), (53, 6)]
    assert inner.count() == 46 + 49
    kept = C.uncovered(phrases, 80)
    assert kept.filter("w4 = 0").count() == 0


def test_empty_and_odd_tables(spark):
    docs = documents(spark, [])
    assert C.collocations(docs).count() == 0
    assert C.collocations(documents(spark, [None, "", "."])).count() == 0
    one = documents(spark, ["a b " * 40_000])
    assert got(C.collocations(one)) == brute([("en", "a b " * 40_000)], 30, 80, 2000)


def test_large_counts_are_exact(spark):
    """Products beyond 64 bits."""
    a, left, right = 9 * 10**12, 9 * 10**12 + 7, 10**13 + 1
    phrases = spark.createDataFrame([("en", 1, 2, 0, 0, a), ("en", 1, 0, 0, 0, left), ("en", 2, 0, 0, 0, right)], "lang string, w1 long, w2 long, w3 long, w4 long, f long")
    row = C.scored(phrases.filter("w2 > 0"), phrases).first()
    assert (row["l"], row["r"], row["score"]) == (left, right, 2000000 * a // (left + right))
