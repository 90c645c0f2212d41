"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is good or bad. A line's features are shares of its bytes and words (upper case, symbols, repeated words,
...), each with steps at a few thresholds, and the same of the line before and the line behind it. The chain's
weights are fitted by maximum likelihood to documents whose label stands for each of their lines. A document's score
is the mean, weighted by the lines' lengths, of the lines' marginals from a forward-backward pass.

The fit uses a bounded sample of the labelled rows, whole texts of any size: of the `sample` doc_ids with the smallest hashes among
those that have a text, as many of each label as `lines` allows, one text each (of several texts of a doc_id the smallest). Scores use every line of
every text. Labels, lang, source and doc_id are no inputs of a score.

Null and empty texts have one empty line. With no label, or labels of one kind, scores are 0.5 or that label.
Labels other than 0 and 1 are ignored; of several labels of a doc_id the smallest counts. Repeated rows get equal
scores. An empty table gives an empty result. Extra columns stay; one with the name of the score gives way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import slices, text_bytes, words

SAMPLE, SAMPLE_LINES, STEPS = 3000, 400_000, 120
LEVELS = (0.02, 0.08, 0.2, 0.4)
_KINDS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "loud": b"!?", "bar": b"|", "stop": b".,;:", "symbol": b"#$%&*+=<>@^_~{}[]\\/"}
#: The shares, then the logarithms of the bytes in a line and in a word.
FEATURES = [*_KINDS, "other", "again", "again2", "single", "long", "size", "word"]


@dataclass(frozen=True)
class Chain:
    """weights: for good against bad, of the features of the three lines and a constant; links: good-good and bad-bad against a change."""

    weights: np.ndarray
    links: np.ndarray


def _tables() -> np.ndarray:
    kind = np.full(256, len(_KINDS), np.uint8)
    for k, members in enumerate(_KINDS.values()):
        kind[list(members)] = k
    plain = [*range(ord("a"), ord("z") + 1), *range(128, 256), 0x20, *range(0x09, 0x0E), ord("'"), ord("-"), ord('"')]
    kind[plain] = len(_KINDS) + 1
    return kind


_KIND = _tables()


def line_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines (float32), the bytes of each line with its end, and the number of lines before each text."""
    data, offsets = text_bytes(column)
    ends = np.flatnonzero(data == 0x0A) + 1
    firsts = np.unique(np.concatenate((offsets[:-1][np.diff(offsets) > 0], ends[ends < len(data)]))) if len(data) else np.zeros(0, np.int64)
    edges = np.concatenate((firsts, [len(data)])).astype(np.int64)
    size = np.diff(edges)
    shares = []
    kinds = _KIND[data]
    hit = np.zeros(len(data) + 1, np.int32)
    for k in range(len(_KINDS) + 1):
        np.cumsum(kinds == k, out=hit[1:])
        shares.append((hit[edges[1:]] - hit[edges[:-1]]) / np.maximum(size, 1))
    hashes, starts, stops, _ = words(data, offsets)
    lower, upper = np.searchsorted(starts, edges[:-1]), np.searchsorted(starts, edges[1:])
    count = upper - lower
    line = np.repeat(np.arange(len(size)), count)

    def equal(lag: int) -> np.ndarray:
        same = np.zeros(len(hashes) + 1, np.int32)
        if len(hashes) > lag:
            np.cumsum((hashes[lag:] == hashes[:-lag]) & (line[lag:] == line[:-lag]), out=same[lag + 1 :])
        return (same[upper] - same[lower]) / np.maximum(count, 1)

    length = stops - starts
    sums = np.zeros(len(length) + 1, np.int64)
    np.cumsum(length, out=sums[1:])
    ones, longs = np.zeros(len(length) + 1, np.int32), np.zeros(len(length) + 1, np.int32)
    np.cumsum(length == 1, out=ones[1:])
    np.cumsum(length > 25, out=longs[1:])
    some = np.maximum(count, 1)
    shares += [equal(1), equal(2), (ones[upper] - ones[lower]) / some, (longs[upper] - longs[lower]) / some]
    table = np.stack([np.asarray(s, np.float32) for s in shares], 1) if len(size) else np.zeros((0, len(_KINDS) + 5), np.float32)
    stepped = [table, *((table > level).astype(np.float32) for level in LEVELS)]
    more = np.stack((np.log1p(size) / 8, np.log1p((sums[upper] - sums[lower]) / some) / 3), 1).astype(np.float32) if len(size) else np.zeros((0, 2), np.float32)
    features = np.concatenate([*stepped, more], 1)
    before = np.searchsorted(firsts, offsets)
    before[-1] = len(size)
    empty = np.flatnonzero(np.diff(before) == 0)  # one line without bytes each
    if len(empty):
        features, size = np.insert(features, before[empty], 0, axis=0), np.insert(size, before[empty], 0)
        before = before + np.concatenate(([0], np.cumsum(np.diff(before) == 0)))
    return features, size + 1, before


def with_neighbours(features: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Each line's features, those of the line before and the line behind (0 at the ends), two flags for the ends, and 1."""
    n, width = features.shape
    out = np.zeros((n, 3 * width + 3), np.float32)
    out[:, :width] = features
    out[1:, width : 2 * width] = features[:-1]
    out[:-1, 2 * width : 3 * width] = features[1:]
    first, last = before[:-1], before[1:] - 1
    out[first, width : 2 * width] = 0
    out[last, 2 * width : 3 * width] = 0
    out[first, -3], out[last, -2], out[:, -1] = 1, 1, 1
    return out


def marginals(scores: np.ndarray, links: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of every line; expected good-good and bad-bad links; the sum of log normalisers. scores: good against bad.

    The state of a chain of two labels is one number, the log odds. All documents advance together, line by line.
    """
    counts = np.diff(before)
    order = np.argsort(-counts, kind="stable")
    starts, counts = before[:-1][order], counts[order]
    n, gg, bb = len(scores), links[0], links[1]
    forward, backward, norm = np.zeros(n), np.zeros(n), np.zeros(n)
    longest = int(counts[0]) if len(counts) else 0
    active = np.searchsorted(-counts, -np.arange(longest), "left")  # documents with more than t lines
    for t in range(longest):
        at = starts[: active[t]] + t
        if t:
            a = forward[at - 1]
            good, bad = np.logaddexp(a + gg, 0.0), np.logaddexp(a, bb)
            forward[at] = good - bad + scores[at]
            norm[at] = norm[at - 1] + bad  # with the bad label's score as 0
        else:
            forward[at] = scores[at]
    for t in range(longest - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        b = backward[at + 1] + scores[at + 1]
        backward[at] = np.logaddexp(b + gg, 0.0) - np.logaddexp(b, bb)
    p = 1 / (1 + np.exp(-np.clip(forward + backward, -60, 60)))
    inner = np.ones(n, bool)
    inner[before[1:] - 1] = False
    i = np.flatnonzero(inner)
    a, b = forward[i], backward[i + 1] + scores[i + 1]
    parts = np.stack((a + b + gg, a, b, np.full(len(i), bb)))
    parts = np.exp(parts - parts.max(0, initial=-np.inf)) if len(i) else parts
    parts /= parts.sum(0)
    last = before[1:] - 1
    return p, np.array([parts[0].sum(), parts[3].sum()]), float((norm[last] + np.logaddexp(forward[last], 0.0)).sum())


def fit(rows: np.ndarray, before: np.ndarray, labels: np.ndarray, steps: int = STEPS) -> Chain:
    """Maximum likelihood with a Gaussian prior, by Adam; each document counts as much as any other."""
    width = rows.shape[1]
    counts = np.diff(before)
    y = np.repeat(labels, counts).astype(float)
    share = np.repeat(1 / counts, counts)
    w, m, v = np.zeros(width + 2), np.zeros(width + 2), np.zeros(width + 2)
    w[-2:] = 1.0
    good, bad = (labels * (counts - 1)).sum(), ((1 - labels) * (counts - 1)).sum()
    scale = max(1, counts.sum())
    for step in range(1, steps + 1):
        p, links, _ = marginals(rows @ w[:-2], w[-2:], before)
        slope = np.concatenate((((p - y) * share) @ rows / len(labels), (links - (good, bad)) / scale)) + 1e-4 * w
        slope[-2:] += 0.02 * w[-2:]  # holds the links, which labels of whole documents drive up
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        w = w - 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Chain(w[:-2].astype(np.float32), w[-2:])


def document_scores(chain: Chain, column: pa.Array) -> np.ndarray:
    features, size, before = line_features(column)
    p, _, _ = marginals((with_neighbours(features, before) @ chain.weights).astype(float), chain.links, before)
    sums = np.concatenate(([0.0], np.cumsum(p * size)))
    total = np.concatenate(([0.0], np.cumsum(size.astype(float))))
    return np.clip((sums[before[1:]] - sums[before[:-1]]) / (total[before[1:]] - total[before[:-1]]), 0.0, 1.0)


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        features, _, before = line_features(batch.column("text"))
        blobs, counts = [], []
        for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
            blobs.append(features[a:b].astype(np.float16).tobytes())
            counts.append(b - a)
        yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(counts, pa.int32()), pa.array(blobs, pa.binary())], ["quality", "lines", "features"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lines: int = SAMPLE_LINES) -> Chain | float:
    """The chain, or the only score that there is to give.

    Fitted to whole texts of at most `sample` labelled rows, in an order of hashes of their doc_ids: of each label as many rows as
    bring its lines to half of `lines`, and the first in any case. So rows are left out by their place in that order, never by
    their size, and what the driver holds is bounded by `lines` and one text of each label.
    """
    known = labels.filter("quality in (0, 1)").groupBy(F.col("doc_id").alias("_labelled")).agg(F.min("quality").cast("int").alias("quality"))
    count = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    sizes = docs.select("doc_id", F.coalesce(count, F.lit(1)).alias("_lines")).groupBy("doc_id").agg(F.max("_lines").alias("_lines"))
    there = known.join(sizes, F.col("_labelled") == F.col("doc_id")).select("_labelled", "quality", "_lines", F.xxhash64("_labelled").alias("_at"))
    picked = there.orderBy("_at", "_labelled").limit(sample)  # bounded, as are the windows on it
    before = F.sum("_lines").over(Window.partitionBy("quality").orderBy("_at", "_labelled").rowsBetween(Window.unboundedPreceding, -1))
    picked = picked.withColumn("_before", F.coalesce(before, F.lit(0))).filter(F.col("_before") < lines // 2).select("_labelled", "quality")
    fitting = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_labelled"))
    texts = fitting.groupBy("_labelled").agg(F.min("quality").alias("quality"), F.min("text").alias("text"))
    rows = texts.select("quality", "text").mapInArrow(_sample, "quality int, lines int, features binary").collect()  # of `sample` rows at most
    if not rows:
        return 0.5
    y = np.array([r["quality"] for r in rows])
    if len(set(y.tolist())) < 2:
        return float(y[0])
    before = np.concatenate(([0], np.cumsum([r["lines"] for r in rows])))
    features = np.concatenate([np.frombuffer(r["features"], np.float16).reshape(r["lines"], -1) for r in rows]).astype(np.float32)
    return fit(with_neighbours(features, before), before, y)


def score_documents(docs: DataFrame, model: Chain | float, score: str = "score") -> DataFrame:
    """The columns of docs with a score (0 to 1) in place of a column of that name."""
    docs = docs.drop(score)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = np.full(len(batch), model) if isinstance(model, float) else document_scores(model, batch.column("text"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*names, score])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())]))
