"""Scoring by a hidden Markov language model: Baum-Welch counts summed across partitions, exact forward likelihoods.

Tokens are a text's words and one end. The FREQUENT most frequent training words and the end are symbols of their
own; all other words share CLASSES symbols by the hash of their last three bytes (A-Z lower-cased, as in words). A state emits a symbol, a symbol a
word: p(word | symbol) = (c - 0.5) / C with c the word's training count and C the symbol's, and what that leaves,
0.5 V / C for V distinct words, is the probability of the symbol's words that training has not seen. So the model sums
to one over the known words and one unknown word per class, and no table that grows with the vocabulary is held
anywhere: counts of all words are gathered over all training documents by an exchange of packed arrays.

1. Each slice of documents becomes a block: local word numbers, and the block's distinct words with their counts,
   dealt out by ranges of the hash. A range's task sums the counts and returns each block its words' totals.
2. Blocks turn into sequences of symbols (two bytes a token), with what doesn't depend on states summed per document.
3. Every round, all blocks' training sequences give expected counts by forward-backward over each whole text; they are
   summed over the partitions in two levels and make the next model. Forward messages of more than ROWS tokens are kept
   at checkpoints only and computed again from there, so memory is bounded at any length of text.
4. The scaled forward recursion runs over each whole text.

Words are told apart by 64-bit hashes. A null text is an empty text: the end alone. Without training documents
nothing is known, and every token has the probability 1 of the single unknown word. Repeated rows count and score
like any other; a null doc_id is the text "" to the fold. doc_id is a number, or text that holds one. Of equally frequent
words the smaller hash is a symbol of its own. An empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_or_empty
from .words import scramble, slices, text_bytes, words

STATES, FREQUENT, CLASSES, ROUNDS = 8, 4096, 1024, 6
#: Tokens whose forward and backward messages are held at a time, and steps between two scalings.
ROWS, SCALED = 400_000, 8
#: Tokens of texts that advance together: the steps of a few long ones are then shared by many texts.
TOGETHER = 4_000_000
#: Distinct words of blocks in one range of the exchange.
RANGE = 1_500_000
END = np.uint64(0x0D15EA5E0D15EA5E)
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[ord("A") : ord("Z") + 1] += np.uint64(32)
SLICES = 32


def pack_numbers(x: np.ndarray) -> bytes:
    """Small numbers in two bytes and as many packed bits as the largest needs beyond them."""
    more = max(0, int(x.max(initial=0)).bit_length() - 16)
    return bytes([more]) + x.astype(np.uint16).tobytes() + b"".join(np.packbits(x >> (16 + k) & 1).tobytes() for k in range(more))


def unpack_numbers(data: bytes, n: int) -> np.ndarray:
    x, at = np.frombuffer(data, np.uint16, n, 1).astype(np.uint32), 1 + 2 * n
    for k in range(data[0]):
        bits = np.frombuffer(data, np.uint8, -(-n // 8), at)
        x |= np.unpackbits(bits, count=n).astype(np.uint32) << np.uint32(16 + k)
        at += len(bits)
    return x


@dataclass(frozen=True)
class Lexicon:
    """What the driver knows of the vocabulary: totals, the frequent words and the classes' counts."""

    tokens: int
    distinct: int
    frequent: np.ndarray  # hashes, sorted; END among them
    symbol: np.ndarray  # of each of those
    counts: np.ndarray  # training tokens of each symbol
    kinds: np.ndarray  # distinct training words of each symbol

    def symbols(self, hashes: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        if not len(self.frequent):
            return suffix.astype(np.int64)
        at = np.minimum(np.searchsorted(self.frequent, hashes), len(self.frequent) - 1)
        return np.where(self.frequent[at] == hashes, self.symbol[at], suffix)


@dataclass(frozen=True)
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbol x state


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for name, batch in enumerate(slices(batches, "text"), TaskContext.get().partitionId() << 32):
        data, offsets = text_bytes(batch.column("text"))
        hashes, starts, ends, before = words(data, offsets)
        tail = np.zeros(len(hashes), np.uint64)
        for k in (3, 2, 1):
            at = ends - k
            tail = tail * np.uint64(257) + np.where(at >= starts, _LOWER[data[np.maximum(at, 0)]], np.uint64(0)) if len(data) else tail
        suffix = scramble(tail) % np.uint64(CLASSES)
        hashes, suffix = np.insert(hashes, before[1:], END), np.insert(suffix, before[1:], 0)
        lengths = np.diff(before) + 1
        train = np.array(batch.column("train").to_pylist(), bool)
        known, first, local = np.unique(hashes, return_index=True, return_inverse=True)
        count = np.bincount(local[np.repeat(train, lengths)], minlength=len(known))
        row = [[name], [batch.column("doc_id").to_pylist()], [train.tobytes()], [lengths.tobytes()], [pack_numbers(local)], [known.tobytes()], [suffix[first].astype(np.uint16).tobytes()], [count.astype(np.uint32).tobytes()]]
        yield pa.RecordBatch.from_arrays([pa.array(row[0]), pa.array(row[1], pa.list_(pa.int64())), *(pa.array(x, pa.binary()) for x in row[2:])], ["block", "doc_ids", "train", "lengths", "local", "words", "suffix", "counts"])


def _deal(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, known, suffix, count in zip(*(batch.column(x).to_pylist() for x in ("block", "words", "suffix", "counts")), strict=True):
                known, suffix, count = np.frombuffer(known, np.uint64), np.frombuffer(suffix, np.uint16), np.frombuffer(count, np.uint32)
                part = (known >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)  # any number of ranges
                full, edges = np.unique(part, return_index=True)
                full, cut = full.tolist(), [slice(*x) for x in zip(edges.tolist(), [*edges[1:].tolist(), len(part)], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int32()), pa.array([block] * len(full), pa.int64()), *(pa.array([x[c].tobytes() for c in cut], pa.binary()) for x in (known, suffix, count))],
                    ["part", "block", "words", "suffix", "counts"],
                )

    return run


def _totals(group: pa.Table) -> pa.Table:
    """For each block its words' totals; and, in a row without a block, the range's classes and most frequent words."""
    arrays = {x: [np.frombuffer(v.as_py(), kind) for v in group.column(x)] for x, kind in (("words", np.uint64), ("suffix", np.uint16), ("counts", np.uint32))}
    known, first, local = np.unique(np.concatenate(arrays["words"]), return_index=True, return_inverse=True)
    total = np.bincount(local, np.concatenate(arrays["counts"]).astype(float)).astype(np.int64)
    suffix = np.concatenate(arrays["suffix"])[first]
    edges = np.cumsum([0, *map(len, arrays["words"])]).tolist()
    own = [total[local[a:b]].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
    seen = total > 0
    classes = np.stack((np.bincount(suffix, total.astype(float), CLASSES), np.bincount(suffix[seen], minlength=CLASSES).astype(float)))
    top = np.argsort(-total, kind="stable")[:FREQUENT]
    top = top[total[top] > 0]
    part = group.column("part")[0].as_py()
    n = len(own)
    return pa.table(
        {
            "part": pa.array([part] * (n + 1), pa.int32()),
            "block": pa.array([*group.column("block").to_pylist(), None], pa.int64()),
            "totals": pa.array([*own, total[top].tobytes()], pa.binary()),
            "words": pa.array([*[None] * n, known[top].tobytes()], pa.binary()),
            "suffix": pa.array([*[None] * n, suffix[top].tobytes()], pa.binary()),
            "classes": pa.array([*[None] * n, classes.tobytes()], pa.binary()),
        }
    )


def _unpack_top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for w, s, c in zip(*(batch.column(x).to_pylist() for x in ("words", "suffix", "totals")), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(w, np.int64)), pa.array(np.frombuffer(s, np.uint16).astype(np.int32)), pa.array(np.frombuffer(c, np.int64))], ["word", "suffix", "n"])


def _unpack_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, CLASSES))
    for batch in batches:
        for x in batch.column("classes").to_pylist():
            total += np.frombuffer(x, float).reshape(2, CLASSES)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES, dtype=np.int32)), pa.array(total[0].astype(np.int64)), pa.array(total[1].astype(np.int64))], ["suffix", "n", "kinds"])


def _lexicon(totals: DataFrame) -> Lexicon:
    own = totals.filter("block is null")
    classes = own.select("classes").mapInArrow(_unpack_classes, "suffix int, n long, kinds long").groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds")).collect()
    top = own.select("words", "suffix", "totals").mapInArrow(_unpack_top, "word long, suffix int, n long").orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    counts, kinds = np.zeros(CLASSES + len(top), np.int64), np.ones(CLASSES + len(top), np.int64)
    kinds[:CLASSES] = 0
    for r in classes:
        counts[r["suffix"]], kinds[r["suffix"]] = r["n"], r["kinds"]
    tokens, distinct = int(counts.sum()), int(kinds[:CLASSES].sum())
    for k, r in enumerate(top):
        counts[r["suffix"]] -= r["n"]
        kinds[r["suffix"]] -= 1
        counts[CLASSES + k] = r["n"]
    hashes = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return Lexicon(tokens, distinct, hashes[order], CLASSES + order, counts, kinds)


def _encode(lexicon):
    """Blocks with their words' totals to documents' constants and sequences of symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lexicon.value
        for batch in batches:
            for row in batch.to_pylist():
                total = np.concatenate([np.frombuffer(x["totals"], np.int64) for x in sorted(row["parts"], key=lambda x: x["part"])])
                symbol = known.symbols(np.frombuffer(row["words"], np.uint64), np.frombuffer(row["suffix"], np.uint16))
                size, kinds = known.counts[symbol], known.kinds[symbol]
                alone = symbol >= CLASSES
                chance = np.where(total > 0, total - 0.5, 0.5 * np.maximum(kinds, 1)) / np.maximum(size, 1)
                inner = np.where(alone | (size == 0), 0.0, np.log10(np.maximum(chance, 1e-300)))
                base = np.log10((total + 0.5) / (known.tokens + 0.5 * (known.distinct + 1)))
                lengths = np.frombuffer(row["lengths"], np.int64)
                local = unpack_numbers(row["local"], int(lengths.sum()))
                starts = np.cumsum(lengths) - lengths
                sums = [np.add.reduceat(x[local], starts) for x in ((total > 0).astype(np.int64), base, inner)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["doc_ids"]], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in (row["train"], row["lengths"], *(s.tobytes() for s in sums), symbol.astype(np.uint16)[local].tobytes()))],
                    ["doc_ids", "train", "lengths", "known", "base", "inner", "symbols"],
                )

    return run


def expected_counts(model: Model, symbols: np.ndarray, lengths: np.ndarray, rows: int = ROWS) -> tuple[np.ndarray, ...]:
    """Expected starts, moves and emissions of these sequences, by scaled forward-backward over each whole sequence.

    All sequences advance together, the longest first, so those that are not over yet are the first ones. Messages are
    known up to a factor each (emissions are divided by their symbol's mean), which goes where shares are made. Only
    `rows` tokens' messages are held at a time; forward messages before them are made again from the last checkpoint.
    """
    states, kinds = len(model.start), len(model.emit)
    emit = model.emit / model.emit.mean(1, keepdims=True)
    order = np.argsort(-lengths, kind="stable")
    starts, longest = (np.cumsum(lengths) - lengths)[order], int(lengths.max(initial=0))
    active = np.searchsorted(-lengths[order], -np.arange(longest + 1), "left")
    before = np.concatenate(([0], np.cumsum(active)))
    cuts = [0]
    while cuts[-1] < longest:
        cuts.append(min(longest, max(cuts[-1] + 1, int(np.searchsorted(before, before[cuts[-1]] + rows, "right")) - 1)))

    def forward(a: int, b: int, last: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols, emissions and forward messages from step a to b, one step after the other."""
        at = np.arange(before[b] - before[a]) - np.repeat(before[a:b] - before[a], active[a:b])
        found = symbols[starts[at] + np.repeat(np.arange(a, b), active[a:b])]
        seen = emit[found]
        alphas = np.empty_like(seen)
        for t in range(a, b):
            low, n = before[t] - before[a], active[t]
            now = alphas[low : low + n]
            if t:
                np.matmul(last[:n], model.move, out=now)
            else:
                now[:] = model.start
            now *= seen[low : low + n]
            if t % SCALED == 0:
                now /= now.sum(1, keepdims=True)
            last = now
        return found, seen, alphas

    checkpoints: list[np.ndarray | None] = [None]
    for a, b in zip(cuts[:-2], cuts[1:-1], strict=True):
        alphas = forward(a, b, checkpoints[-1])[2]
        checkpoints.append(alphas[before[b - 1] - before[a] :].copy())
    first, moves, uses = np.zeros(states), np.zeros((states, states)), np.zeros((kinds, states))
    ahead = np.empty((0, states))  # what the emission and the backward message of the next step are together
    back = np.ascontiguousarray(model.move.T)
    for a, b in zip(cuts[-2::-1], cuts[:0:-1], strict=True):
        found, seen, alphas = forward(a, b, checkpoints.pop())
        betas = np.ones_like(seen)
        later = ahead
        for t in range(b - 1, a - 1, -1):
            low, n, more = before[t] - before[a], active[t], active[t + 1]
            now = betas[low : low + n]
            if more:
                np.matmul(later, back, out=now[:more])
                if t % SCALED == 0:
                    now[:more] /= now[:more].sum(1, keepdims=True)
            seen[low : low + n] *= now
            later = seen[low : low + n]
        shares = alphas * betas
        shares /= shares.sum(1, keepdims=True)
        for s in range(states):
            uses[:, s] += np.bincount(found, shares[:, s], kinds)
        if a == 0:
            first = shares[: active[0]].sum(0)
        # A step and the one behind it: rows of a text that goes on, in the same order as the rows of the steps behind.
        goes_on = np.arange(len(seen)) - np.repeat(before[a:b] - before[a], active[a:b]) < np.repeat(active[a + 1 : b + 1], active[a:b])
        behind = np.concatenate((seen[active[a] :], ahead))
        here = alphas[goes_on]
        here /= (here * (behind @ back)).sum(1, keepdims=True)
        moves += here.T @ behind
        ahead = later.copy()
    return first, moves * model.move, uses


def _count(model, states: int, kinds: int, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(states + states * states + kinds * states)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def count() -> None:
            own, lengths = (np.concatenate(x) for x in zip(*waiting, strict=True))
            total[:] += np.concatenate([x.ravel() for x in expected_counts(model.value, own, lengths)])
            waiting.clear()

        for batch in batches:
            for symbols, lengths, train in zip(*(batch.column(x).to_pylist() for x in ("symbols", "lengths", "train")), strict=True):
                lengths, train = np.frombuffer(lengths, np.int64), np.frombuffer(train, bool)
                if train.any():
                    waiting.append((np.frombuffer(symbols, np.uint16)[np.repeat(train, lengths)], lengths[train]))
                    if sum(len(x) for x, _ in waiting) >= TOGETHER:
                        count()
        if waiting:
            count()
        if total.any():
            parts = np.array_split(total, SLICES)
            group = TaskContext.get().partitionId() % groups
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES, dtype=np.int32)), pa.array([group] * SLICES, pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], ["slice", "group", "counts"])

    return run


def _added(group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), float) for x in group.column("counts"))
    return pa.table({"slice": group.column("slice")[:1], "group": group.column("group")[:1], "counts": pa.array([total.tobytes()], pa.binary())})


def first_model(lexicon: Lexicon, states: int, seed: int = 5) -> Model:
    """Symbols' shares, shaken at random so that the states can part; a state mostly stays."""
    noise = np.random.default_rng(seed).gamma(2.0, 0.5, (len(lexicon.counts), states))
    emit = (lexicon.counts[:, None] + 0.5) * noise
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    even = np.full(states, 1 / states)
    return Model(even, move, emit / emit.sum(0))


def next_model(total: np.ndarray, lexicon: Lexicon, states: int) -> Model:
    kinds = len(lexicon.counts)
    first, move, emit = np.split(total, np.cumsum([states, states * states]))
    share = (lexicon.counts + 0.5) / (lexicon.counts + 0.5).sum()
    emit = emit.reshape(kinds, states) + 10 * share[:, None]
    move = move.reshape(states, states) + 0.1
    return Model((first + 0.1) / (first + 0.1).sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def train(encoded: DataFrame, lexicon: Lexicon, states: int = STATES, rounds: int = ROUNDS) -> Model:
    spark, kinds = encoded.sparkSession, len(lexicon.counts)
    model = first_model(lexicon, states)
    groups = math.isqrt(max(1, encoded.rdd.getNumPartitions())) + 1
    for _ in range(rounds if lexicon.tokens else 0):
        sent = spark.sparkContext.broadcast(model)  # of a fixed size
        counts = encoded.select("symbols", "lengths", "train").mapInArrow(_count(sent, states, kinds, groups), "slice int, group int, counts binary")
        for keys in (("slice", "group"), ("slice",)):
            counts = counts.groupBy(*keys).applyInArrow(_added, "slice int, group int, counts binary")
        rows = sorted(counts.collect(), key=lambda r: r["slice"])  # SLICES rows, as large as the model
        model = next_model(np.concatenate([np.frombuffer(r["counts"], float) for r in rows]), lexicon, states)
    return model


def likelihoods(model: Model, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 of each sequence's probability: the scaled forward recursion, all sequences one token at a time."""
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    longest = int(lengths.max()) if len(lengths) else 0
    active = np.searchsorted(-lengths[order], -np.arange(longest + 1), "left")
    alpha, total = np.tile(model.start, (len(lengths), 1)), np.zeros(len(lengths))
    product, scale = 1.0, np.ones(len(lengths))
    for t in range(longest):
        n = active[t]
        alpha = (alpha if t == 0 else alpha[:n] @ model.move) * model.emit[symbols[starts[:n] + t]]
        product = alpha.sum(1)
        alpha /= product[:, None]
        scale[:n] *= product
        if t % 16 == 15:  # no product of 16 factors of a symbol's probability leaves a double's range
            total += np.log10(scale)
            scale[:] = 1.0
    total += np.log10(scale)
    out = np.empty(len(lengths))
    out[order] = total
    return out


def _score(model, tokens: int, most: int = 2_000_000):
    def flush(rows: list[dict]) -> pa.RecordBatch:
        joined = lambda x, kind: np.concatenate([np.frombuffer(r[x], kind) for r in rows])
        lengths, inner = joined("lengths", np.int64), joined("inner", float)
        score = likelihoods(model.value, joined("symbols", np.uint16), lengths) + inner if tokens else np.zeros(len(lengths))
        ids = pa.array([x for r in rows for x in r["doc_ids"]], pa.int64())
        arrays = [pa.array(~joined("train", bool)), pa.array(lengths), pa.array(joined("known", np.int64)), pa.array(np.full(len(lengths), tokens)), pa.array(joined("base", float)), pa.array(score)]
        return pa.RecordBatch.from_arrays([ids, *arrays], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                rows.append(row)
                size += len(row["symbols"]) // 2
                if size >= most:
                    yield flush(rows)
                    rows, size = [], 0
        if rows:
            yield flush(rows)

    return run


def score_documents(docs: DataFrame, training: Column, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document; training: which ones to learn from."""
    spark = docs.sparkSession
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), F.coalesce(training, F.lit(False)).alias("train"))
    blocks = stored(columns.mapInArrow(_blocks, "block long, doc_ids array<bigint>, train binary, lengths binary, local binary, words binary, suffix binary, counts binary"), "hmm-blocks")
    distinct = blocks.agg(F.sum(F.octet_length("counts"))).first()[0] or 0
    ranges = max(1, -(-distinct // (4 * RANGE)))
    dealt = blocks.select("block", "words", "suffix", "counts").mapInArrow(_deal(ranges), "part int, block long, words binary, suffix binary, counts binary")
    totals = stored(dealt.groupBy("part").applyInArrow(_totals, "part int, block long, totals binary, words binary, suffix binary, classes binary"), "hmm-totals")
    lexicon = _lexicon(totals)
    sent = spark.sparkContext.broadcast(lexicon)  # of a fixed size
    parts = totals.filter("block is not null").groupBy("block").agg(F.collect_list(F.struct("part", "totals")).alias("parts"))
    whole = blocks.drop("counts").join(parts, "block")
    encoded = stored(whole.mapInArrow(_encode(sent), "doc_ids array<bigint>, train binary, lengths binary, known binary, base binary, inner binary, symbols binary"), "hmm-encoded")
    model = train(encoded, lexicon, states, rounds)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return encoded.mapInArrow(_score(spark.sparkContext.broadcast(model), lexicon.tokens), schema)
