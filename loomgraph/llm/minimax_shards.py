"""Minimax contiguous partition of documents into shards, by DataFrame functions only.

Documents with equal texts are one atomic group. Groups are ordered by the SHA-1 of their text; a shard takes a
contiguous run of groups. The smallest capacity for which a greedy filling needs no more than the given number of
shards is searched for, and the cuts are made where the greedy filling makes them; no partition into contiguous runs
has a smaller largest shard.

The driver holds the ordered groups as parts, each of the groups whose digests begin alike, with their sizes summed up.
A filling that may cut between parts only bounds the capacity from above, one that may cut anywhere within a part of
several groups bounds it from below. While the bounds differ, the parts in which a cut could lie (AT_ONCE of them at
most) are opened in one job, each into as many as 16 ** DEEPER smaller ones; a part of one group is exact. So a job
brings a bounded number of rows to the driver, and a few jobs do for any number of groups. No window is needed for sums.

Slots number the documents of a shard within ranges of the hash of their doc_id, as a group may have any number of them:
about ROWS documents a range, in RANGES ranges at most.

Null texts are empty texts (size 1). Ties don't exist: equal texts are one group. Repeated rows are documents of
one group. An empty table gives an empty result. Extra columns don't matter.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored, text_or_empty

#: Digits of the digests of the first parts, by how many an opened part's are longer, and how many parts one job opens.
FIRST, DEEPER, AT_ONCE = 3, 2, 256
#: Documents in one range of slots; and ranges, the fewest and the most.
ROWS, RANGES = 1 << 20, (512, 1 << 16)


class Parts:
    """Consecutive parts of the ordered groups as (prefix, weight, groups), by prefix."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.rows = sorted(rows)
        self.ends = list(accumulate(weight for _, weight, _ in self.rows))
        self.total = self.ends[-1] if self.ends else 0

    def cuts(self, capacity: int, shards: int, hopeful: bool) -> list[int]:
        """Where a greedy filling ends each shard: no later than it truly would, or, if hopeful, no earlier."""
        cut, cuts = 0, []
        for _ in range(shards):
            target = cut + capacity
            at = bisect.bisect_right(self.ends, target)
            if at == len(self.ends):
                cut = self.total
            elif hopeful and self.rows[at][2] > 1:
                cut = target
            else:
                cut = self.ends[at - 1] if at else 0
            cuts.append(cut)
        return cuts

    def least(self, low: int, high: int, shards: int, hopeful: bool) -> int:
        """The smallest capacity that takes all; high is one."""
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if self.cuts(middle, shards, hopeful)[-1] >= self.total else (middle + 1, high)
        return high

    def doubtful(self, low: int, high: int, shards: int) -> list[tuple[str, int, int]]:
        """The parts of several groups in which a cut could lie for these capacities, largest first."""
        found = set()
        for a, b in zip([0, *self.cuts(low, shards, False)[:-1]], [0, *self.cuts(high, shards, True)[:-1]], strict=True):
            found.update(range(bisect.bisect_right(self.ends, a + low), bisect.bisect_right(self.ends, b + high) + 1))
        several = [self.rows[k] for k in found if k < len(self.rows) and self.rows[k][2] > 1]
        return sorted(several, key=lambda row: (-row[1], row[0]))


def minimax_cuts(rows: list[tuple[str, int, int]], largest: int, shards: int, opened: Callable[[list[str]], list[tuple[str, int, int]]]) -> list[str]:
    """The prefixes after which a shard ends (all but the last shard). rows: the first parts; opened: the parts within those of these prefixes."""
    parts = Parts(rows)
    low, high = max(-(-parts.total // shards), largest), parts.total
    while True:
        high = parts.least(low, high, shards, False)
        low = parts.least(low, high, shards, True)
        cuts = parts.cuts(high, shards, False)
        if low == high and cuts == parts.cuts(high, shards, True):
            break
        asked = {prefix for prefix, _, _ in parts.doubtful(low, high, shards)[:AT_ONCE]}
        parts = Parts([row for row in parts.rows if row[0] not in asked] + opened(sorted(asked)))
    return [parts.rows[bisect.bisect_left(parts.ends, c)][0] for c in dict.fromkeys(cuts) if 0 < c < parts.total]


def _opened(groups: DataFrame, prefixes: list[str]) -> list[tuple[str, int, int]]:
    lengths = sorted({len(p) for p in prefixes})
    begins = {n: F.substring("digest", 1, n).isin([p for p in prefixes if len(p) == n]) for n in lengths}
    longer = F.coalesce(*(F.when(begins[n], F.substring("digest", 1, n + DEEPER)) for n in lengths))
    near = F.col("first").isin(sorted({p[:FIRST] for p in prefixes}))
    sums = groups.filter(near).select(longer.alias("prefix"), "weight").filter("prefix IS NOT NULL").groupBy("prefix")
    return [(r["prefix"], r["weight"], r["n"]) for r in sums.agg(F.sum("weight").alias("weight"), F.count("*").alias("n")).collect()]


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null: this law has no growth) of each document."""
    text = text_or_empty()
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.sha1(text.cast("binary")).alias("digest"))
    rows = stored(rows, "shard-rows")
    groups = rows.groupBy("digest").agg(F.sum("size").alias("weight"), F.count("*").alias("copies"))
    # In order within a file, so that opening a part reads few pages of it.
    groups = stored(groups.withColumn("first", F.substring("digest", 1, FIRST)).sortWithinPartitions("digest"), "shard-groups")
    parts = groups.groupBy("first").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"), F.max("weight").alias("largest"), F.sum("copies").alias("copies")).collect()
    largest, documents = max((r["largest"] for r in parts), default=0), sum(r["copies"] for r in parts)
    last = minimax_cuts([(r["first"], r["weight"], r["n"]) for r in parts], largest, shards, lambda prefixes: _opened(groups, prefixes))
    discard(groups)
    shard = sum((F.when(F.substring("digest", 1, len(p)) > p, 1).otherwise(0) for p in last), F.lit(0)).cast("int")
    ranges = min(max(RANGES[0], -(-documents // (shards * ROWS))), RANGES[1])
    placed = rows.withColumn("shard", shard).withColumn("cell", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(ranges)).cast("int"))
    # Slots: the rows of each (shard, cell) follow one another.
    counts = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))  # shards * RANGES[1] rows at most
    before = counts.select("shard", "cell", (F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("before"))
    numbered = placed.withColumn("k", F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "digest")) - 1)
    return numbered.join(F.broadcast(before), ["shard", "cell"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("k")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
