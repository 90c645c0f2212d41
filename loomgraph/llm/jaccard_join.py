"""N-gram Jaccard join by token-combination prefixes.

A document's set holds its distinct shingles (five words; all words where there are fewer). Documents with the
same set form one class; everything below works on classes, so copies are never compared with one another.

1. Token exchange. Each batch of documents deals its shingle hashes out by ranges of the hash, packed as binary
   columns. A range's task counts in how many classes (of all batches) each shingle occurs and returns those in two
   or more, with that count, to their batches. A shingle that more than HEAVY classes of a batch hold goes out once,
   with its number of holders; who they are stays with the batch. So a range gets at most HEAVY entries of a shingle
   from a batch, however common it is. A shingle of one class only can't take part in a link, but comes first
   in the global order (count, hash), so its number is all that is needed of it.
2. Prefixes. Two sets with Jaccard >= t share at least ceil(t * size) shingles for either size; hence the first
   size - ceil(t * size) + q shingles of both sets have q in common (where so many are shared). Shingles of up to
   RARE classes are indexed alone. The frequent ones are dealt into token classes by their hash and indexed
   as pairs within such a class. With q one more than the token classes, the common ones hold a rare one or two of one
   token class. Token classes grow with the size, in levels of fourfold sizes, so the pairs of a set are about as many
   as its shingles at any length. Sets of up to SMALL shingles, for which q may be too many, use q = 1 and single
   shingles. A set that could link with one of the next level is indexed in that one too, so no link is missed.
3. Verification on the returned shingles (which hold every common one), first of each class against one centre
   of each index entry. Connected components of these links contract the index entries; in entries that still hold
   several components, pairs across components are verified as well, but for those that can't have enough in common
   by what each has in common with the entry's centre. These pairs are joined by (entry, band of sizes, salt): only
   sizes that could link by the numbers of shared shingles meet, and an entry of very many members is split over
   tasks, as are the pairs of a centre of very many. No link between different texts is lost.
4. The components' nodes are (null flag, first doc_id, class), so a component's smallest node holds its name.

Batches are named by their partition and their number in it, so a partition that is run again after a lost executor
deals the same rows under the same names. Should docs give other rows then (an unordered source), the job says so
and stops instead of losing links.

Nulls and texts without words have empty sets, linked with nothing. Extra columns are ignored, whatever their names.
Repeated rows are documents with equal sets. doc_id is a number, or text that holds one. A null doc_id is the smallest
in its component. An empty table gives an empty result. A text is held whole by one task, of any length.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, join_hot, stored, text_or_empty, unused
from .components import connected_components
from .words import scramble, slices, text_bytes, words

RARE, SMALL, BITS = 16, 24, 512
#: Token classes of frequent shingles for sets of up to 4 x SMALL shingles; four times as many for up to 16 x SMALL, and so on.
GROUPS = 3
#: A shingle of more classes of a batch than this is dealt once.
HEAVY = 8
#: Shingles in one range of the exchange.
RANGE = 500_000
#: Of an index entry's members, those that are paired in one task; and how much sizes in one band differ.
BLOCK, BAND = 512, 1.05
_PLACES = np.random.default_rng(777).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text as sorted hashes, one after the other, and their numbers."""
    data, offsets = text_bytes(column)
    hashes, _, _, before = words(data, offsets)
    counts = np.diff(before)
    n = len(hashes)
    full = np.zeros(n, np.uint64)
    for k in range(length):
        full[: n - k] += hashes[k:] * _PLACES[k]
    full = scramble(full)
    sizes, out = np.zeros(len(counts), np.int64), []
    for k, (a, m) in enumerate(zip(before[:-1].tolist(), counts.tolist(), strict=True)):
        if m >= length:
            got = np.sort(full[a : a + m - length + 1])
            if (same := got[1:] == got[:-1]).any():
                got = got[np.concatenate(([True], ~same))]
        elif m:
            got = scramble(np.append(hashes[a : a + m] * _PLACES[:m], _PLACES[length + m]).sum(keepdims=True))
        else:
            continue
        sizes[k] = len(got)
        out.append(got)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), sizes


def class_ids(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set that isn't empty (0 for those)."""
    sums = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(scramble(tokens + np.uint64(0x5851F42D4C957F2D)), out=sums[1:])
    ends = np.cumsum(sizes)
    ids = scramble(sums[ends] - sums[ends - sizes] + scramble(sizes.astype(np.uint64)))
    return np.where(sizes > 0, ids, np.uint64(0))


def _sets(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            tokens, sizes = shingle_sets(batch.column("text"), length)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(class_ids(tokens, sizes).view(np.int64))], ["doc_id", "n_shingles", "class_id"])

    return run


def _deal(length: int, ranges: int):
    """Rows (part, batch, content, owner, low, high, tops) of the batch's shingles in a range; one of them also holds its classes and their sizes.

    A shingle is sent whole: its last 48 bits as low and high, its first 16 as counts over the range's sorted shingles (see `_tops`).
    Owners are numbers of classes within the batch, in as many bits as they need, so a shingle has at most 8 bytes at any scale,
    and a batch 64 KiB more at most. It comes back in the same form.
    Ranges go by the first 32 bits of the hash, so there may be as many as the number of shingles asks for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text"):
            tokens, sizes = shingle_sets(batch.column("text"), length)
            ids = class_ids(tokens, sizes)
            _, firsts = np.unique(ids, return_index=True)  # copies within a batch go once
            keep = np.zeros(len(ids), bool)
            keep[firsts] = True
            keep &= sizes > 0
            tokens, ids, sizes = tokens[np.repeat(keep, sizes)], ids[keep], sizes[keep]
            if not len(ids):
                continue
            for at in range(0, len(ids), 1 << 16):
                yield _dealt(name, ids[at : at + (1 << 16)], sizes[at : at + (1 << 16)], tokens[sizes[:at].sum() : sizes[: at + (1 << 16)].sum()], ranges)
                name += 1

    return run


_DEALT = "part int, batch long, content long, owner binary, low binary, high binary, tops binary, heavy binary, classes binary, sizes binary, held binary, held_by binary"
_SHARED = "part int, batch long, content long, owner binary, low binary, high binary, tops binary, counts binary, heavy binary, classes binary, sizes binary, held binary, held_by binary"
#: A shingle and how many classes hold it.
_HEAVY = np.dtype([("token", "<u8"), ("count", "<u4")])


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal numbers begin, and how long they are."""
    edges = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, np.int64)
    return edges, np.diff(np.append(edges, len(ordered)))


def _lowest(part: int, ranges: int) -> int:
    """The first 16 bits of the smallest hash in a range."""
    return -(-(part << 32) // ranges) >> 16


def _tops(first: np.ndarray) -> bytes:
    """Sorted small numbers as how often 0, 1, 2, ... occur: a byte each, after as many bytes of 255 as go into it."""
    counts = np.bincount(first)
    reps = counts // 255 + 1
    out = np.full(reps.sum(), 255, np.uint8)
    out[np.cumsum(reps) - 1] = counts % 255
    return out.tobytes()


def _from_tops(packed: bytes) -> np.ndarray:
    """The numbers that `_tops` has packed."""
    counts = np.frombuffer(packed, np.uint8)
    return np.repeat(np.cumsum(counts != 255) - (counts != 255), counts).astype(np.uint64)


def _few_bits(x: np.ndarray) -> bytes:
    """16-bit numbers in as many bits as the largest one has, behind a byte that says how many."""
    bits = int(x.max()).bit_length() if len(x) else 0
    spread = (x[:, None] >> np.arange(bits, dtype=np.uint16) & 1).astype(np.uint8)
    return bytes([bits]) + np.packbits(spread).tobytes()


def _from_few_bits(packed: bytes, n: int) -> np.ndarray:
    """The n numbers that `_few_bits` has packed."""
    bits = packed[0]
    spread = np.unpackbits(np.frombuffer(packed[1:], np.uint8), count=n * bits).reshape(n, bits).astype(np.uint16)
    return (spread << np.arange(bits, dtype=np.uint16)).sum(axis=1, dtype=np.uint16)


def _hashes(tokens: np.ndarray, cut: list[slice], parts: list[int], ranges: int) -> dict[str, list[bytes]]:
    """The columns low, high and tops of slices of sorted shingles, each within one range."""
    top = (tokens >> np.uint64(48)).astype(np.int64)
    low, high = (tokens & np.uint64(0xFFFFFFFF)).astype(np.uint32), (tokens >> np.uint64(32) & np.uint64(0xFFFF)).astype(np.uint16)
    tops = [_tops(top[c] - _lowest(k, ranges)) for c, k in zip(cut, parts, strict=True)]
    return {"low": [low[c].tobytes() for c in cut], "high": [high[c].tobytes() for c in cut], "tops": tops}


def _from_hashes(group: pa.Table, ranges: int) -> list[np.ndarray]:
    """The shingles of each row of low, high and tops."""
    rows = zip(*(group.column(x).to_pylist() for x in ("part", "low", "high", "tops")), strict=True)
    return [
        _from_tops(tops) + np.uint64(_lowest(part, ranges)) << np.uint64(48) | np.frombuffer(high, np.uint16).astype(np.uint64) << np.uint64(32) | np.frombuffer(low, np.uint32)
        for part, low, high, tops in rows
    ]


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers by their first, second, third and fourth bytes: of small ones the last three are zeros in a row."""
    return x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def _dealt(name: int, ids: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, ranges: int) -> pa.RecordBatch:
    owner = np.repeat(np.arange(len(ids), dtype=np.uint16), sizes)
    order = np.argsort(tokens, kind="stable")  # by range as well, as ranges are intervals
    tokens, owner = tokens[order], owner[order]
    part = (tokens >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
    firsts, count = _runs(tokens)
    common = count > HEAVY
    heavy, heavy_part = np.zeros(int(common.sum()), _HEAVY), part[firsts[common]]
    heavy["token"], heavy["count"] = tokens[firsts[common]], count[common]
    light = ~np.repeat(common, count)
    held_by = owner[~light]
    tokens, owner, part = tokens[light], owner[light], part[light]
    own = int(scramble(np.array([name], np.uint64))[0]) % ranges
    content = int(scramble(ids + scramble(np.arange(len(ids), dtype=np.uint64))).sum(dtype=np.uint64)) >> 1
    full = np.unique(np.concatenate((part, heavy_part, np.array([own], np.uint64))))
    cut, heavy_cut = ([slice(*x) for x in zip(np.searchsorted(p, full).tolist(), np.searchsorted(p, full, "right").tolist(), strict=True)] for p in (part, heavy_part))
    full = full.tolist()
    whole = [ids.tobytes(), sizes.astype(np.uint32).tobytes(), heavy.tobytes(), held_by.tobytes()]
    columns = [[_few_bits(owner[c]) for c in cut], *_hashes(tokens, cut, full, ranges).values()]
    columns += [[heavy[c].tobytes() for c in heavy_cut]] + [[x if k == own else None for k in full] for x in whole]
    return pa.RecordBatch.from_arrays(
        [pa.array(full, pa.int32()), pa.array([name] * len(full), pa.int64()), pa.array([content] * len(full), pa.int64()), *(pa.array(c, pa.binary()) for c in columns)],
        ["part", "batch", "content", "owner", "low", "high", "tops", "heavy", "classes", "sizes", "held", "held_by"],
    )


def _shared(ranges: int):
    """Of one range: for each batch the shingles that others hold too, with the number of holders."""

    def run(group: pa.Table) -> pa.Table:
        each_tokens = _from_hashes(group, ranges)
        each_owner = [_from_few_bits(v, len(x)) for v, x in zip(group.column("owner").to_pylist(), each_tokens, strict=True)]
        each_heavy = [np.frombuffer(v, _HEAVY) for v in group.column("heavy").to_pylist()]
        rows, heavy_rows = (np.repeat(np.arange(len(group), dtype=np.uint32), [len(x) for x in each]) for each in (each_tokens, each_heavy))
        tokens, owner, heavy = (np.concatenate(x) for x in (each_tokens, each_owner, each_heavy))
        every = np.concatenate((tokens, heavy["token"]))
        order = np.argsort(every, kind="stable")
        firsts, number = _runs(every[order])
        holders = np.concatenate((np.ones(len(tokens), np.int64), heavy["count"]))[order]
        total = np.add.reduceat(holders, firsts) if len(firsts) else holders
        each = np.zeros(len(every), np.uint32)
        each[order] = np.repeat(np.minimum(total, (1 << 32) - 1), number)
        heavy = heavy.copy()
        heavy["count"], each = each[len(tokens) :], each[: len(tokens)]
        kept = each > 1
        tokens, owner, rows, each = tokens[kept], owner[kept], rows[kept], each[kept]
        edges, heavy_edges = (np.searchsorted(x, np.arange(len(group) + 1)).tolist() for x in (rows, heavy_rows))
        cut, heavy_cut = ([slice(a, b) for a, b in zip(e[:-1], e[1:], strict=True)] for e in (edges, heavy_edges))
        packed = {"owner": [_few_bits(owner[c]) for c in cut], **_hashes(tokens, cut, group.column("part").to_pylist(), ranges), "counts": [_planes(each[c]) for c in cut]}
        packed = {x: pa.array(v, pa.binary()) for x, v in packed.items()}
        packed["heavy"] = pa.array([heavy[c].tobytes() for c in heavy_cut], pa.binary())
        out = pa.table({"part": group.column("part"), "batch": group.column("batch"), "content": group.column("content"), **packed, **{x: group.column(x) for x in ("classes", "sizes", "held", "held_by")}})
        some = [c.start < c.stop or h.start < h.stop for c, h in zip(cut, heavy_cut, strict=True)]
        return out.filter(pa.array([x or c for x, c in zip(some, group.column("classes").is_valid().to_pylist(), strict=True)]))

    return run


def _in_classes(tokens: np.ndarray, groups: int) -> np.ndarray:
    """Keys of all pairs of these shingles that fall into one of the token classes."""
    group = (scramble(tokens + np.uint64(99)) % np.uint64(groups)).astype(np.int64)
    order = np.lexsort((tokens, group))
    tokens, group = tokens[order], group[order]
    found, apart = [], 1
    while apart < len(tokens) and (same := group[apart:] == group[:-apart]).any():
        found.append(scramble(tokens[:-apart][same] * np.uint64(3) + scramble(tokens[apart:][same])))
        apart += 1
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def signatures(tokens: np.ndarray, counts: np.ndarray, n: int, percent: int) -> np.ndarray:
    """The index keys of a set of n shingles, of which tokens are those that other sets have too."""
    order = np.lexsort((tokens, counts))
    tokens, counts = tokens[order], counts[order]
    alone = n - len(tokens)
    prefix, found = n - -(-percent * n // 100) - alone, []
    if n <= SMALL:
        found.append(scramble(tokens[: max(0, prefix + 1)] ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
    least, groups = SMALL, GROUPS  # a level: sizes over least, up to four times that, and those that could link with them
    while 100 * n >= percent * (least + 1):
        if n <= 4 * least:
            head = slice(0, max(0, prefix + 1 + groups))
            rare = counts[head] <= RARE
            found += [tokens[head][rare], _in_classes(tokens[head][~rare], groups)]
        least, groups = 4 * least, 4 * groups
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def _candidates(percent: int, ranges: int):
    """Of one batch: the classes that could have index keys, with their shingles that others hold and the numbers of holders."""

    def run(group: pa.Table) -> pa.Table:
        if len(group.column("content").unique()) > 1 or group.column("classes").null_count != len(group) - 1:
            raise RuntimeError("a batch of documents was dealt twice with different rows: give jaccard_join a stored table")
        group = group.sort_by("part")  # in the order in which the batch was dealt
        joined = lambda x, kind: np.concatenate([np.frombuffer(v, kind) for v in group.column(x).to_pylist() if v is not None])
        classes, sizes = joined("classes", np.int64), joined("sizes", np.uint32).astype(np.int64)
        each = _from_hashes(group, ranges)
        owner = np.concatenate([_from_few_bits(v, len(x)) for v, x in zip(group.column("owner").to_pylist(), each, strict=True)])
        tokens, counts = np.concatenate(each), np.concatenate([_from_planes(v) for v in group.column("counts").to_pylist()])
        held, total = joined("held", _HEAVY), joined("heavy", _HEAVY)
        if not np.array_equal(total["token"], held["token"]):
            raise RuntimeError("a batch of documents was dealt twice with different rows: give jaccard_join a stored table")
        owner = np.concatenate((owner, joined("held_by", np.uint16)))
        tokens, counts = np.concatenate((tokens, np.repeat(held["token"], held["count"]))), np.concatenate((counts, np.repeat(total["count"], held["count"])))
        order = np.argsort(owner, kind="stable")
        owner, tokens, counts = owner[order], tokens[order], counts[order]
        edges = np.searchsorted(owner, np.arange(len(classes) + 1))
        few = -(-percent * sizes // 100)  # with fewer shared shingles than that there is no link
        kept = np.flatnonzero(np.diff(edges) >= few)
        cut = [slice(edges[k], edges[k + 1]) for k in kept]
        return pa.table({"class_id": pa.array(classes[kept]), "n": pa.array(sizes[kept]), "tokens": pa.array([tokens[c].tobytes() for c in cut], pa.binary()), "counts": pa.array([counts[c].tobytes() for c in cut], pa.binary())})

    return run


def _index(percent: int):
    """A row for each class that has index keys: its shingles that other classes have too, sorted, their number, the keys,
    and its rank as a centre: how many holders its shingles have on average, which is most for the text that a family stems from.

    holders: in how many batches the class itself is; a shingle with no more holders is no other class's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for cls, n, tokens, counts, holders in zip(*(batch.column(x) for x in ("class_id", "n", "tokens", "counts", "holders")), strict=True):
                n, tokens, counts = n.as_py(), np.frombuffer(tokens.as_py(), np.uint64), np.frombuffer(counts.as_py(), np.uint32)
                shared = counts > holders.as_py()
                tokens, counts = tokens[shared], counts[shared]
                if 100 * len(tokens) >= percent * n and len(keys := signatures(tokens, counts, n, percent)):
                    rows.append((cls.as_py(), n, len(tokens), float(counts.sum() / n), np.sort(tokens).tobytes(), keys.view(np.int64)))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], ["class_id", "n", "s", "central", "tokens", "keys"])

    return run


_NAME = "struct<named: int, first: bigint, class_id: bigint>"


def _bits(tokens: np.ndarray) -> tuple[np.ndarray, int]:
    """These shingles as BITS bits, and how many of them share a bit with another."""
    bits = np.zeros(BITS, bool)
    bits[(scramble(tokens) % np.uint64(BITS)).astype(np.int64)] = True
    return bits, len(tokens) - int(bits.sum())


def _verify(percent: int):
    """Also which of the first set's shingles the second misses and which it has besides, as bits (see _bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [batch.column(k) for k in ("a", "b", "name_a", "name_b")]
            n, m, s, t = (batch.column(k) for k in ("n_a", "n_b", "tokens_a", "tokens_b"))
            linked, common, double = np.zeros(len(batch), bool), np.zeros(len(batch), np.int64), np.zeros((2, len(batch)), np.int64)
            bits = np.zeros((2, len(batch), BITS), bool)
            for k, (size, other) in enumerate(zip(n.to_pylist(), m.to_pylist(), strict=True)):
                x, y = np.frombuffer(s[k].as_py(), np.uint64), np.frombuffer(t[k].as_py(), np.uint64)
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                absent, besides = y[at] != x, np.ones(len(y), bool)
                besides[at[~absent]] = False
                common[k] = len(x) - absent.sum()
                linked[k] = 100 * common[k] >= percent * (size + other - common[k])
                for side, tokens in enumerate((x[absent], y[besides])):
                    bits[side, k], double[side, k] = _bits(tokens)
            words = np.packbits(bits, axis=2).view(np.int64)
            lists = [pa.ListArray.from_arrays(np.arange(0, w.size + 1, BITS // 64, dtype=np.int32), w.ravel()) for w in words]
            columns = [*names, pa.array(linked), pa.array(common), lists[0], pa.array(double[0]), lists[1], pa.array(double[1])]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "name_a", "name_b", "linked", "common", *_HELD])

    return run


#: What the first set has and the second misses, and the reverse; see _bits.
_HELD = ["missing", "double", "besides", "besides_double"]


def _verified(pairs: DataFrame, index: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b): distinct and stored; the result also says whether they link, and what a and b have and haven't in common.

    A class that is `a` of very many pairs stands in the join once for each BLOCK of them, so its pairs are spread over tasks.
    """
    side = lambda x: index.select(F.col("class_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("tokens").alias(f"tokens_{x}"), F.col("name").alias(f"name_{x}"))
    counts, salts = pairs.groupBy("a").agg(F.count("*").alias("near")), F.ceil(F.col("near") / BLOCK).cast("int")
    salted = join_hot(pairs, counts, ["a"], "near").select("a", "b", F.pmod(F.xxhash64("b"), salts).cast("int").alias("salt"))
    left = side("a").join(counts, "a").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("near")
    both = salted.join(left, ["a", "salt"]).drop("salt").join(side("b"), "b")
    return both.mapInArrow(_verify(percent), f"a long, b long, name_a {_NAME}, name_b {_NAME}, linked boolean, common long, missing array<bigint>, double long, besides array<bigint>, besides_double long")


def _possible(n: str, shared: str, m: str, other: str, percent: int):
    """Whether sets of n and m shingles could link, of which that many occur in other sets at all: no more can be common."""
    return (100 + percent) * F.least(shared, other) >= percent * (F.col(n) + F.col(m))


def _band(n: Column) -> Column:
    return F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / math.log(BAND)).cast("int")


def _across(part: DataFrame, percent: int) -> DataFrame:
    """(a, b): of each entry, pairs of different components that could link. part: an entry's members without its centre.

    The larger of two sets looks for the smaller one in the bands of sizes that could link with it: no smaller than
    percent of its own, and together with it no larger than its shared shingles allow. What u and v have in common is
    in the centre h (all of h but what u or v misses), or outside of h; BITS bits bound how much they miss and have together.
    """
    large, blocks = part.withColumn("low", F.ceil(F.col("n") * percent / 100)), F.ceil(F.col("members") / BLOCK).cast("int")
    large = large.withColumn("high", F.least("n", F.floor((100 + percent) * F.col("s") / percent) - F.col("n"))).filter("low <= high")
    large = large.withColumn("salt", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("band", F.explode(F.sequence(_band(F.col("low")), _band(F.col("high")))))
    small = part.select(
        "key", F.pmod(F.xxhash64("class_id"), blocks).cast("int").alias("salt"), _band(F.col("n")).alias("band"), F.col("class_id").alias("b"),
        *(F.col(c).alias(f"{c}_b") for c in ("n", "s", "component", "common", *_HELD)),
    )
    shared = lambda x, double: sum((F.bit_count(F.get(x, F.lit(k)).bitwiseAND(F.get(f"{x}_b", F.lit(k)))) for k in range(BITS // 64)), F.least(double, f"{double}_b"))
    within = F.col("common") + F.col("common_b") - F.col("s_a") + F.least(shared("missing", "double"), F.col("s_a") - F.col("common"), F.col("s_a") - F.col("common_b"))
    most = within + F.least(shared("besides", "besides_double"), F.col("s") - F.col("common"), F.col("s_b") - F.col("common_b"))
    near = F.coalesce((100 + percent) * most >= percent * (F.col("n") + F.col("n_b")), F.lit(True))
    ordered = (F.col("n") > F.col("n_b")) | (F.col("n") == F.col("n_b")) & (F.col("class_id") < F.col("b"))
    met = large.join(small, ["key", "band", "salt"]).filter(ordered & (F.col("component") != F.col("component_b")) & _possible("n", "s", "n_b", "s_b", percent) & near)
    return met.select(F.least("class_id", "b").alias("a"), F.greatest("class_id", "b").alias("b")).distinct()


def verified_links(entries: DataFrame, index: DataFrame, percent: int) -> DataFrame:
    """(a, b): the names of classes that share an index entry and link: enough of them to connect all that are connected.

    entries (class_id, n, s, central, key): stored. index (class_id, n, tokens, name), of the same classes: stored.
    """
    centres = entries.groupBy("key").agg(F.max(F.struct("central", "class_id", "n", "s")).alias("centre"), F.count("*").alias("members")).filter("members > 1")
    centres = centres.select("key", F.col("centre.class_id").alias("a"), F.col("centre.n").alias("n_a"), F.col("centre.s").alias("s_a"), "members")
    before, entries = entries, stored(join_hot(entries.drop("central"), centres, ["key"], "members"), "jaccard-entries")
    discard(before)
    stars = entries.filter(F.col("class_id") != F.col("a")).filter(_possible("n", "s", "n_a", "s_a", percent))
    stars = stored(stars.select("a", F.col("class_id").alias("b")).distinct(), "jaccard-pairs")
    tested = stored(_verified(stars, index, percent), "jaccard-stars")
    links = tested.filter("linked")
    found = connected_components(links.select("a", "b")).withColumnRenamed("node", "class_id")
    # What is still apart within an entry: pairs across its components. The centre has met all that could link with it.
    part = entries.join(found, "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    mixed = part.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n_key")).filter("low < high").select("key", "n_key")
    held = tested.select("a", F.col("b").alias("class_id"), "common", *_HELD)
    part = join_hot(part.filter(F.col("class_id") != F.col("a")), mixed, ["key"], "n_key").drop("n_key")
    part = stored(part.join(held, ["a", "class_id"], "left"), "jaccard-rest")
    rest = _across(part, percent).join(tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    rest = stored(rest, "jaccard-pairs")
    more = _verified(rest, index, percent).filter("linked")
    ends = [F.col(f"name_{x}").alias(x) for x in "ab"]
    all_links = stored(links.select(*ends).unionByName(more.select(*ends)), "jaccard-links")
    discard(entries, stars, tested, part, rest)
    return all_links


def class_components(docs: DataFrame, classes: DataFrame, length: int = 5, percent: int = 75) -> DataFrame:
    """(node, component): the classes that link with others, as (named, first, class_id). classes: (class_id, n, name)."""
    total = classes.agg(F.sum("n")).first()[0] or 0
    ranges = max(1, -(-total // RANGE))
    dealt = docs.select(text_or_empty().alias("text")).mapInArrow(_deal(length, ranges), _DEALT)
    back = dealt.groupBy("part").applyInArrow(_shared(ranges), _SHARED)
    rows = back.groupBy("batch").applyInArrow(_candidates(percent, ranges), "class_id long, n long, tokens binary, counts binary")
    once = rows.groupBy("class_id").agg(*(F.first(x).alias(x) for x in ("n", "tokens", "counts")), F.count("*").alias("holders"))
    index = once.mapInArrow(_index(percent), "class_id long, n long, s long, central double, tokens binary, keys array<long>").join(classes.select("class_id", "name"), "class_id")
    index = stored(index, "jaccard-index")
    entries = stored(index.select("class_id", "n", "s", "central", F.explode("keys").alias("key")), "jaccard-keys")
    links = verified_links(entries, index, percent)
    discard(index)
    return connected_components(links)


def with_components(sets: DataFrame, *more: Column) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The classes (class_id, n, copies, name, more aggregates) of sets (doc_id, n_shingles, class_id; stored), and a function
    that makes (doc_id, n_shingles, component_id) of each document from connected components of the classes' names."""
    filled, empty = sets.filter("n_shingles > 0"), sets.filter("n_shingles = 0")
    named, first = F.min(F.col("doc_id").isNotNull().cast("int")), F.coalesce(F.min("doc_id"), F.lit(0).cast("long"))
    name = F.struct(named.alias("named"), first.alias("first"), F.col("class_id").alias("class_id"))
    classes = filled.groupBy("class_id").agg(F.max("n_shingles").alias("n"), F.count("*").alias("copies"), name.alias("name"), *more)
    classes = stored(classes, "jaccard-classes")

    def finish(components: DataFrame) -> DataFrame:
        linked, component = components.select(F.col("node.class_id").alias("class_id"), "component"), F.coalesce("component", "name")
        names = classes.join(linked, "class_id", "left").select("class_id", "copies", F.when(component["named"] == 1, component["first"]).alias("component_id"))
        rows = join_hot(filled, stored(names, "jaccard-names"), ["class_id"], "copies")
        return rows.select("doc_id", "n_shingles", "component_id").unionByName(empty.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))

    return classes, finish


def jaccard_join(docs: DataFrame, length: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links, itself included) of each document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    sets = stored(docs.mapInArrow(_sets(length), "doc_id long, n_shingles long, class_id long"), "jaccard-sets")
    classes, named = with_components(sets)
    return named(class_components(docs, classes, length, percent))


def one_of_each(docs: DataFrame, length: int = 5, percent: int = 75) -> DataFrame:
    """The documents that are the first of their component. Rows of one doc_id are one document and stay or go together."""
    kept = unused("kept", docs)
    first = jaccard_join(docs, length, percent).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(kept)).distinct()
    return docs.join(first, docs["doc_id"].cast("long").eqNullSafe(F.col(kept)), "left_semi")
