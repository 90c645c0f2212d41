"""Phrases whose words occur together, counted in a weighted de Bruijn graph.

The graph's nodes are three following words of a piece, its edges four, weighted by how often they occur. Only edges are
aggregated over the corpus. An edge whose last word is END (0) says that a piece ends at its node, so a node's count is
the flow out of it: the sum of its edges' weights. The count of two words is the sum of the nodes that begin with them and
of the pieces that end with them; that of a word follows likewise.

1. A survey counts words and edges for each language, and finds the pairs of words with more than a thousandth of all edges:
   at most a thousand hot pairs.
2. Each batch of documents sums up its edges and deals them out by ranges of the hash of their first two words, packed as
   binary columns; edges of hot pairs go by their first three words. A range's task adds up edges, nodes and pairs, and
   returns those that occur `least` times or more. Pairs that are hot come as parts and are added up behind that.
3. What remains is at most a `least`-th of the corpus for each length. Of it, unary paths are compacted: a node
   through which all flow comes from one edge and goes on to one edge is inside a path of one weight. Paths are found by
   pointer doubling. Each path's windows say which shorter phrases lie in a longer one, and how often that occurs.
4. Candidates that no longer one covers look up both parts of each cut, in one join; the lowest score counts.
5. The last scores that can be among the first `limit` of a language are found from counts of equal scores; the words
   of phrases that reach them are spelled out by one more scan of the texts, behind a bitmap of fixed size.

Words stand as 56 bits of their hash; within a phrase, all its words' bits must agree for it to be taken for another.
Null texts are empty, a null lang is `und`. A lang without candidates has no rows. Ties go as the contract says, to the
smaller cut and the smaller phrase. Repeated rows count each. An empty table gives an empty result. Extra columns
are ignored. A text is held whole by one task, of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bitmaps import bitmap_of, marked
from .common import discard, join_hot, stored, text_or_empty
from .words import scramble, slices, text_bytes, words

END = 0
#: Edges in one range of the exchange.
RANGE = 3 << 19
#: A pair of words with more than a HOT-th of all edges is hot. A batch names those with more than a NOTED-th of its own, so none is missed.
HOT, NOTED = 1000, 2048
#: Bits of the bitmap of words that are spelled out.
BITMAP = 1 << 24
_BREAKS = np.zeros(256, bool)
_BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_APART = _BREAKS.copy()
_APART[[0x20, 0x09]] = True
_FACTORS = np.random.default_rng(11).integers(1, 1 << 62, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
WORDS = ["w1", "w2", "w3", "w4"]
GRAM = ["lang", *WORDS]


def _word_ids(hashes: np.ndarray) -> np.ndarray:
    return np.maximum(hashes >> np.uint64(8), np.uint64(1))


def _pieces(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: each word's id, how many words follow in its piece, and the number of words before each text."""
    data, offsets = text_bytes(column)
    hashes, starts, ends, before = words(data, offsets, _APART)
    n = len(hashes)
    last = np.zeros(n, bool)
    if n:
        breaks = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_BREAKS[data], out=breaks[1:])
        last[:-1] = breaks[starts[1:]] > breaks[ends[:-1]]
        last[before[1:][np.diff(before) > 0] - 1] = True
    at = np.flatnonzero(last)
    follow = np.repeat(at, np.diff(np.append(-1, at))) - np.arange(n)
    return _word_ids(hashes), follow, before


def _languages(batch: pa.RecordBatch, before: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
    """Each language of a batch and the places of its words."""
    codes = batch.column("lang").dictionary_encode()
    of_word = np.repeat(np.asarray(codes.indices), np.diff(before))
    for k, lang in enumerate(codes.dictionary.to_pylist()):
        yield lang, np.flatnonzero(of_word == k)


def _salt(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(lang.encode()[:4096], "little") % ((1 << 61) - 1))


def _edges(ids: np.ndarray, follow: np.ndarray, own: np.ndarray, lang: str) -> tuple[np.ndarray, ...]:
    """Pair hash and words of each edge, and those of each pair that ends a piece (third and fourth word END)."""
    at = own[follow[own] >= 1]
    a, b, c, d = ids[at], ids[at + 1], np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    for column, k in ((c, 2), (d, 3)):
        more = follow[at] >= k
        column[more] = ids[at[more] + k]
    with np.errstate(over="ignore"):
        return scramble(a * _FACTORS[0] + b * _FACTORS[1] + _salt(lang) * _FACTORS[2]), a, b, c, d


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, pair, n): of each language its words (pair null); of all, the number of edges (both null) and the pairs that have many."""
    for batch in slices(batches, "text"):
        ids, follow, before = _pieces(batch.column("text"))
        rows, pairs = [], [np.zeros(0, np.uint64)]
        for lang, own in _languages(batch, before):
            rows.append((lang, None, len(own)))
            pairs.append(_edges(ids, follow, own, lang)[0])
        pairs, counts = np.unique(np.concatenate(pairs), return_counts=True)
        rows.append((None, None, int(counts.sum())))
        many = counts > counts.sum() // NOTED
        rows += [(None, p, n) for p, n in zip(pairs[many].view(np.int64).tolist(), counts[many].tolist(), strict=True)]
        kinds = [pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], ["lang", "pair", "n"])


def _pack(ids: np.ndarray) -> bytes:
    return np.ascontiguousarray(ids.view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


class _Reader:
    """The columns of a packed cell, in the order in which they were written."""

    def __init__(self, cell: bytes):
        self.cell, self.at = cell, 0

    def numbers(self, kind: type, n: int) -> np.ndarray:
        self.at += (size := n * np.dtype(kind).itemsize)
        return np.frombuffer(self.cell, kind, n, self.at - size)

    def ids(self, n: int) -> np.ndarray:
        out = np.zeros((n, 8), np.uint8)
        out[:, :7] = self.numbers(np.uint8, 7 * n).reshape(n, 7)
        return out.view(np.uint64)[:, 0]


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin in ordered columns."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _part(keys: np.ndarray, ranges: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _deal(ranges: int, hot: np.ndarray):
    """Rows (part, lang, cell): the batch's edges of a language in a range of pairs, summed up, and its words' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids, follow, before = _pieces(batch.column("text"))
            for lang, own in _languages(batch, before):
                cells = _cells(ids, follow, own, lang, ranges, hot)
                for at in range(0, len(cells), 1024):
                    some = cells[at : at + 1024]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k for k, _ in some], pa.int32()), pa.array([lang] * len(some), pa.string()), pa.array([x for _, x in some], pa.binary())],
                        ["part", "lang", "cell"],
                    )

    return run


def _cells(ids: np.ndarray, follow: np.ndarray, own: np.ndarray, lang: str, ranges: int, hot: np.ndarray) -> list[tuple[int, bytes]]:
    pair, a, b, c, d = _edges(ids, follow, own, lang)
    with np.errstate(over="ignore"):
        node = scramble(pair + c * _FACTORS[2])
        edge = np.where(c == END, np.uint64(0), scramble(node + d * _FACTORS[3]) | np.uint64(1))  # an end comes first
    key = np.where(np.isin(pair, hot) & (c != END), node, pair)
    order = np.lexsort((edge, key))
    key, edge = key[order], edge[order]
    firsts = _firsts(key, edge)
    counts = np.diff(np.append(firsts, len(key)))
    key, ends, order = key[firsts], edge[firsts] == 0, order[firsts]
    groups = _firsts(key)
    word, flow = np.unique(ids[own], return_counts=True)  # what goes out of each word within the batch, and its piece ends
    word_order = np.argsort(_part(scramble(word), ranges), kind="stable")
    word, flow = word[word_order], flow[word_order]
    group_part, word_part = _part(key[groups], ranges), _part(scramble(word), ranges)
    bounds = np.append(groups, len(key))
    some = np.union1d(group_part, word_part)
    group_cuts, word_cuts = (np.searchsorted(x, np.append(some, ranges)).tolist() for x in (group_part, word_part))
    found = []
    for i, k in enumerate(some.tolist()):
        (g0, g1), (w0, w1) = group_cuts[i : i + 2], word_cuts[i : i + 2]
        low, high = bounds[g0], bounds[g1]
        begins, end = bounds[g0:g1], ends[low:high]
        has_end, inner = ends[begins], order[low:high][~end]
        size = np.diff(bounds[g0 : g1 + 1]) - has_end
        head = np.array([g1 - g0, len(inner), w1 - w0], np.int64)
        numbers = [size, np.where(has_end, counts[begins], 0), counts[low:high][~end], flow[w0:w1]]
        columns = [a[order[begins]], b[order[begins]], c[inner], d[inner], word[w0:w1]]
        found.append((k, b"".join([head.tobytes(), *(x.astype(np.uint32).tobytes() for x in numbers), *map(_pack, columns)])))
    return found


def _add_up(least: int, hot: np.ndarray):
    """Of one range: phrases (lang, w1 to w4: absent ones 0, f) that occur often, and whatever there is of hot pairs."""

    def run(group: pa.Table) -> pa.Table:
        langs = group.column("lang").to_pylist()
        cells = group.column("cell").to_pylist()
        out = []
        for lang in sorted(set(langs)):
            out += [(lang, *x) for x in _flows([_Reader(x) for x, own in zip(cells, langs, strict=True) if own == lang], lang, least, hot)]
        columns = [np.concatenate([x[k].view(np.int64) for x in out]) for k in range(1, 6)]
        names = [x[0] for x in out for _ in range(len(x[1]))]
        return pa.table([pa.array(names, pa.string()), *map(pa.array, columns)], names=[*GRAM, "f"])

    return run


def _flows(readers: list[_Reader], lang: str, least: int, hot: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    heads = [r.numbers(np.int64, 3).tolist() for r in readers]
    column = lambda read: np.concatenate([read(r, *h) for r, h in zip(readers, heads, strict=True)])
    size, ended = (column(lambda r, g, e, w: r.numbers(np.uint32, g)).astype(np.int64) for _ in range(2))
    counts = column(lambda r, g, e, w: r.numbers(np.uint32, e)).astype(np.int64)
    word_flow = column(lambda r, g, e, w: r.numbers(np.uint32, w)).astype(np.int64)
    a, b = (column(lambda r, g, e, w: r.ids(g)) for _ in range(2))
    c, d = (column(lambda r, g, e, w: r.ids(e)) for _ in range(2))
    word = column(lambda r, g, e, w: r.ids(w))
    order = np.lexsort((b, a))
    firsts = _firsts(a[order], b[order])
    pair = np.zeros(len(a), np.int64)
    pair[order] = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, len(a))))
    a, b = a[order][firsts], b[order][firsts]
    total = np.zeros(len(a), np.int64)
    np.add.at(total, pair, ended)
    pair = np.repeat(pair, size)
    order = np.lexsort((d, c, pair))
    pair, c, d, counts = pair[order], c[order], d[order], counts[order]
    none = np.zeros(0, np.int64)
    firsts = _firsts(pair, c, d)
    edges = np.add.reduceat(counts, firsts) if len(firsts) else none
    pair, c, d = pair[firsts], c[firsts], d[firsts]
    much = (edges >= least) & (d != END)
    yield a[pair[much]], b[pair[much]], c[much], d[much], edges[much]
    firsts = _firsts(pair, c)
    nodes = np.add.reduceat(edges, firsts) if len(firsts) else none
    pair, c = pair[firsts], c[firsts]
    much = nodes >= least
    yield a[pair[much]], b[pair[much]], c[much], np.zeros(much.sum(), np.int64), nodes[much]
    np.add.at(total, pair, nodes)
    with np.errstate(over="ignore"):
        name = scramble(a * _FACTORS[0] + b * _FACTORS[1] + _salt(lang) * _FACTORS[2])
    much = (total >= least) | np.isin(name, hot)
    yield a[much], b[much], *(np.zeros(much.sum(), np.int64) for _ in range(2)), total[much]
    word, place = np.unique(word, return_inverse=True)
    flow = np.zeros(len(word), np.int64)
    np.add.at(flow, place, word_flow)
    much = flow >= least
    yield word[much], *(np.zeros(much.sum(), np.int64) for _ in range(3)), flow[much]


def frequent_phrases(docs: DataFrame, least: int, edges: int, hot: list[int]) -> DataFrame:
    """(lang, w1, w2, w3, w4, f): phrases of one to four words that occur `least` times or more; stored."""
    ranges, hot = max(1, -(-edges // RANGE)), np.array(sorted(hot), np.int64).view(np.uint64)
    dealt = docs.mapInArrow(_deal(ranges, hot), "part int, lang string, cell binary")
    parts = dealt.groupBy("part").applyInArrow(_add_up(least, hot), "lang string, w1 long, w2 long, w3 long, w4 long, f long")
    parts = stored(parts, "phrase-parts")
    found = stored(parts.groupBy(*GRAM).agg(F.sum("f").alias("f")).filter(F.col("f") >= least), "phrases")
    discard(parts)
    return found


def unary_paths(phrases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, path array<long>, f): the compacted edges, each in one path; and (lang, w1, w2, w3): the nodes inside paths. Stored."""
    edges, nodes = phrases.filter(F.col("w4") != END), phrases.filter((F.col("w3") != END) & (F.col("w4") == END)).drop("w4")
    edge, node = F.struct(*GRAM), ["lang", "w1", "w2", "w3", "f"]
    into = edges.select(edge.alias("before"), "lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), F.col("w4").alias("w3"), "f")
    inner = stored(nodes.join(into, node).join(edges.withColumn("edge", edge), node).select(*node[:4], "edge", "before"), "phrase-inner")
    # Each edge behind an inner node points to one `steps` edges earlier, until that is the first of its path.
    pointers = stored(inner.select("edge", F.col("before").alias("head"), F.lit(1).cast("long").alias("steps"), F.lit(True).alias("moved")), "phrase-pointers")
    while not pointers.filter("moved").isEmpty():
        ahead = pointers.select(F.col("edge").alias("head"), F.col("head").alias("further"), F.col("steps").alias("more"))
        moved = F.col("further").isNotNull()
        step = pointers.join(ahead, "head", "left").select("edge", F.coalesce("further", "head").alias("head"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), moved.alias("moved"))
        before, pointers = pointers, stored(step, "phrase-pointers")
        discard(before)
    placed = edges.withColumn("edge", edge).join(pointers, "edge", "left").select(F.coalesce("head", "edge").alias("head"), F.coalesce("steps", F.lit(0)).alias("steps"), "w4", "f")
    paths = placed.groupBy("head").agg(F.transform(F.array_sort(F.collect_list(F.struct("steps", "w4"))), lambda x: x["w4"]).alias("rest"), F.first("f").alias("f"))
    paths = stored(paths.select("head.lang", F.concat(F.array(*(F.col(f"head.{w}") for w in WORDS[:3])), "rest").alias("path"), "f"), "phrase-paths")
    discard(pointers)
    return paths, inner


def _windows(path: Column, length: int) -> Column:
    """All runs of `length` words of a path, as (w1, w2, w3)."""
    at = F.sequence(F.lit(0), F.size(path) - length)
    return F.transform(at, lambda i: F.struct(*((F.get(path, i + k) if k < length else F.lit(END).cast("long")).alias(WORDS[k]) for k in range(3))))


def uncovered(phrases: DataFrame, percent: int) -> DataFrame:
    """The phrases of two to four words that don't lie in a longer one which occurs percent of the times that they do; stored."""
    paths, inner = unary_paths(phrases)
    outer = phrases.filter((F.col("w3") != END) & (F.col("w4") == END)).join(inner.select("lang", "w1", "w2", "w3"), ["lang", "w1", "w2", "w3"], "left_anti")
    long = paths.select("lang", "f", F.explode(F.concat(_windows(F.col("path"), 3), _windows(F.col("path"), 2))).alias("x"))
    long = long.unionByName(outer.select("lang", "f", F.explode(_windows(F.array("w1", "w2", "w3"), 2)).alias("x")))
    most = long.groupBy("lang", "x.w1", "x.w2", "x.w3").agg(F.max("f").alias("most"))
    short = phrases.filter((F.col("w2") != END) & (F.col("w4") == END)).join(most, ["lang", "w1", "w2", "w3"], "left")
    kept = short.filter(F.col("most").isNull() | (100 * F.col("most") < percent * F.col("f"))).drop("most")
    kept = stored(kept.unionByName(phrases.filter(F.col("w4") != END).select(*kept.columns)), "phrase-candidates")
    discard(paths, inner)
    return kept


def scored(candidates: DataFrame, phrases: DataFrame) -> DataFrame:
    """(lang, w1 to w4, a, l, r, score): of each candidate the cut with the lowest score, the smallest one of equals; stored."""
    part = lambda some: [F.col(w) for w in some] + [F.lit(END).cast("long")] * (3 - len(some))
    lookups = []
    for n in (2, 3, 4):
        whole = F.lit(True) if n == 4 else F.col(WORDS[n]) == END
        whole = whole & (F.col(WORDS[n - 1]) != END)
        for k in range(1, n):
            for side, some in (("l", WORDS[:k]), ("r", WORDS[k:n])):
                lookups.append(F.when(whole, F.struct(F.lit(f"{side}{k}").alias("slot"), *(x.alias(f"p{i}") for i, x in enumerate(part(some), 1)))))
    asked = candidates.select(*GRAM, F.col("f").alias("a"), F.explode(F.array_compact(F.array(*lookups))).alias("x")).select(*GRAM, "a", "x.*")
    key = ["lang", "p1", "p2", "p3"]
    counts = phrases.filter(F.col("w4") == END).select("lang", *(F.col(w).alias(p) for w, p in zip(WORDS, key[1:], strict=False)), "f")
    counts = counts.join(asked.groupBy(*key).agg(F.count("*").alias("asked")), key)
    slots = [f"{side}{k}" for k in (1, 2, 3) for side in "lr"]
    found = join_hot(asked, counts, key, "asked").groupBy(*GRAM, "a").agg(*(F.max(F.when(F.col("slot") == s, F.col("f"))).alias(s) for s in slots))
    score = lambda k: F.expr(f"cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0)) div (cast(l{k} as decimal(20,0)) + cast(r{k} as decimal(20,0)))")
    cuts = [F.when(F.col(f"l{k}").isNotNull(), F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in (1, 2, 3)]
    return stored(found.withColumn("cut", F.array_min(F.array(*cuts))).select(*GRAM, "a", "cut.l", "cut.r", "cut.score"), "phrase-scores")


def _spelled(bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = text_bytes(batch.column("text"))
            hashes, starts, ends, _ = words(data, offsets, _APART)
            ids, at = np.unique(_word_ids(hashes), return_index=True)
            some = marked(bitmap.value, ids)
            ids, at = ids[some], at[some]
            spelled = [data[a:b].tobytes().lower().decode(errors="replace") for a, b in zip(starts[at], ends[at], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(spelled, pa.string())], ["id", "word"])

    return run


def collocations(docs: DataFrame, least: int = 30, percent: int = 80, limit: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first phrases."""
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_or_empty().alias("text"))
    survey = stored(docs.mapInArrow(_survey, "lang string, pair long, n long").groupBy("lang", "pair").agg(F.sum("n").alias("n")), "phrase-survey")
    edges = survey.filter("lang IS NULL AND pair IS NULL").agg(F.sum("n")).first()[0] or 0
    hot = [r["pair"] for r in survey.filter(F.col("pair").isNotNull() & (F.col("n") > edges // HOT)).select("pair").collect()]
    phrases = frequent_phrases(docs, least, edges, hot)
    candidates = uncovered(phrases, percent)
    scores = scored(candidates, phrases)
    discard(phrases, candidates)
    first = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    # Of equal scores there may be any number; at most `limit` different ones count, and those before which there are fewer rows.
    levels = scores.groupBy("lang", "score", "a").agg(F.count("*").alias("rows")).withColumn("place", F.row_number().over(first)).filter(F.col("place") <= limit)
    levels = levels.withColumn("before", F.sum("rows").over(first.rowsBetween(Window.unboundedPreceding, -1))).filter(F.coalesce("before", F.lit(0)) < limit)
    reach = stored(join_hot(scores, levels.select("lang", "score", "a", "rows"), ["lang", "score", "a"], "rows").drop("rows"), "phrase-first")
    spelling = reach.select(*GRAM, "a", "l", "r", "score", F.posexplode(F.array(*WORDS)).alias("at", "id")).filter(F.col("id") != END)
    bitmap = docs.sparkSession.sparkContext.broadcast(bitmap_of(spelling.select("id"), BITMAP))
    known = stored(docs.select("text").mapInArrow(_spelled(bitmap), "id long, word string").groupBy("id").agg(F.min("word").alias("word")), "phrase-words")
    known = known.join(spelling.groupBy("id").agg(F.count("*").alias("uses")), "id")
    phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ")
    whole = join_hot(spelling, known, ["id"], "uses").groupBy(*GRAM, "a", "l", "r", "score").agg(phrase.alias("phrase"))
    ranked = whole.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")).filter(F.col("rank") <= limit)
    return ranked.join(survey.filter("lang IS NOT NULL").select("lang", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: DuckDB.
ORACLE_SQL = """
WITH pieces AS MATERIALIZED (
    SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^ \\t]+') AS ws FROM (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
places AS MATERIALIZED (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM pieces),
phrases AS MATERIALIZED (
    SELECT lang, k, ws[i:i + k - 1] AS x, count(*) AS f FROM places, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(ws) GROUP BY ALL),
candidates AS MATERIALIZED (SELECT * FROM phrases WHERE k >= 2 AND f >= 30),
longer AS MATERIALIZED (
    SELECT lang, x[i:i + m - 1] AS x, max(f) AS most FROM (SELECT lang, x, f, k, m, unnest(range(1, k - m + 2)) AS i FROM candidates, (SELECT unnest([2, 3]) AS m) WHERE m < k) GROUP BY ALL),
kept AS (SELECT c.* FROM candidates c LEFT JOIN longer USING (lang, x) WHERE most IS NULL OR 100 * most < 80 * f),
cuts AS (SELECT lang, x, f AS a, k, unnest(range(1, k)) AS cut FROM kept),
scores AS (
    SELECT c.lang, c.x, c.a, cut, l.f AS l, r.f AS r, (2000000::HUGEINT * c.a // (l.f + r.f))::BIGINT AS score FROM cuts c
    JOIN phrases l ON l.lang = c.lang AND l.x = c.x[1:cut] JOIN phrases r ON r.lang = c.lang AND r.x = c.x[cut + 1:c.k]),
best AS (SELECT lang, array_to_string(x, ' ') AS phrase, a, l, r, score FROM scores QUALIFY row_number() OVER (PARTITION BY lang, x ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best
JOIN (SELECT lang, sum(f)::BIGINT AS n FROM phrases WHERE k = 1 GROUP BY lang) USING (lang) QUALIFY rank <= 2000
"""
