"""MinHash near-duplicates with circulant signatures: two permutations give every coordinate.

Shingles (three words) are numbers below 2**32 for the signature. A first permutation breaks up whatever structure they
have; a second one, shifted circularly by k, gives coordinate k: the least value over the set of second(first(x) + k).
Shifting is adding modulo 2**32, so coordinates need no table. Both permutations are invertible mixes of 32 bits.

ROWS coordinates make a band's key, BANDS bands a signature. Two sets of similarity J share a band with a probability of
1 - (1 - J**ROWS)**BANDS: at 0.85 all but one pair in ten million. Documents with equal sets are one class; classes that
share a key are compared on their full sets of 64-bit shingles (verified_links of the Jaccard join: stars around the
member that shares most keys, then pairs across what is still apart, by sizes and salts), and links make components.
So a link is confirmed exactly; a band that two similar sets miss costs a link only if no other links connect them.

Sets are made anew for classes that share a key, from one document of each: those documents pass a bitmap of fixed size,
made of their hashes, and then a join. A bitmap that is full lets others pass too, which changes no result.

Nulls and texts without words have empty sets, linked with nothing. Fewer than three words make one shingle. Extra columns
are ignored. Repeated rows are documents with equal sets. A null doc_id is the smallest in its component. An empty table
gives an empty result. A text is held whole by one task, of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmaps import bitmap_of, marked
from .common import discard, stored, text_or_empty
from .components import connected_components
from .jaccard_join import class_ids, shingle_sets, verified_links, with_components
from .words import scramble, slices

ROWS, BANDS = 5, 28
#: Shingles whose coordinates are computed at a time, so that they stay in a processor's cache.
AT_ONCE = 1 << 15
#: Bits of the bitmap that documents of classes with a shared key pass.
BITMAP = 1 << 26


def _permuted(x: np.ndarray, odd: tuple[int, int]) -> np.ndarray:
    """An invertible mix of 32 bits, in place."""
    for factor, shift in zip(odd, (15, 13), strict=True):
        x ^= x >> np.uint32(shift)
        x *= np.uint32(factor)
    x ^= x >> np.uint32(16)
    return x


def signatures(tokens: np.ndarray, sizes: np.ndarray, coordinates: int) -> np.ndarray:
    """A row of coordinates for each set; sets stand in tokens one after the other. Empty sets have rows of the largest value."""
    out = np.full((len(sizes), coordinates), (1 << 32) - 1, np.uint32)
    filled = np.flatnonzero(sizes)
    starts = np.cumsum(sizes)[filled] - sizes[filled]
    first = _permuted((tokens ^ tokens >> np.uint64(32)).astype(np.uint32), (0x2C1B3C6D, 0x297A2D39))
    at = 0
    while at < len(filled):
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + AT_ONCE)))
        last = starts[end] if end < len(filled) else len(tokens)
        some, edges = first[starts[at] : last], starts[at:end] - starts[at]
        for k in range(coordinates):
            out[filled[at:end], k] = np.minimum.reduceat(_permuted(some + np.uint32(k), (0x85EBCA6B, 0xC2B2AE35)), edges)
        at = end
    return out


def band_keys(coordinates: np.ndarray, rows: int) -> np.ndarray:
    """For each set one 64-bit key a band of that many coordinates."""
    bands = coordinates.reshape(len(coordinates), -1, rows).astype(np.uint64)
    keys = np.arange(bands.shape[1], dtype=np.uint64) + np.uint64(1) << np.uint64(40)
    for k in range(rows):
        keys = scramble(keys + bands[:, :, k])
    return keys


def _signed(length: int, rows: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            tokens, sizes = shingle_sets(batch.column("text"), length)
            ids = class_ids(tokens, sizes)
            _, firsts, place = np.unique(ids, return_index=True, return_inverse=True)
            new = np.zeros(len(ids), bool)  # copies within a batch are signed once
            new[firsts] = True
            keys = np.zeros((len(ids), bands), np.int64)
            keys[new] = band_keys(signatures(tokens[np.repeat(new, sizes)], sizes[new], rows * bands), rows).view(np.int64)
            lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, bands, dtype=np.int32), keys[firsts[place.ravel()]].ravel())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(sizes), pa.array(ids.view(np.int64)), lists], ["doc_id", "row", "n_shingles", "class_id", "bands"])

    return run


def _sets(length: int, bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = bitmap.value
        for batch in slices(batches, "text"):
            batch = batch.filter(pa.array(marked(marks, np.asarray(batch.column("row")).view(np.uint64))))
            if len(batch):
                tokens, sizes = shingle_sets(batch.column("text"), length)
                edges = np.cumsum(np.append(0, sizes))
                packed = [tokens[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(class_ids(tokens, sizes).view(np.int64)), pa.array(packed, pa.binary())], ["row", "class_id", "tokens"])

    return run


def minhash_components(docs: DataFrame, classes: DataFrame, bands: DataFrame, length: int, percent: int) -> DataFrame:
    """(node, component): the classes that link with others. classes: (class_id, n, copies, name, row); bands: (class_id, n, key).

    The member of an entry that shares most keys is its centre: most of its family are near it.
    """
    counts = bands.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    shared = stored(bands.join(counts, "key"), "minhash-shared")
    central = shared.groupBy("class_id").agg(F.sum(F.log2("members")).alias("central"))
    entries = stored(shared.join(central, "class_id").select("class_id", "n", F.col("n").alias("s"), "central", "key"), "minhash-keys")
    asked = stored(classes.join(central.select("class_id"), "class_id", "left_semi").select("class_id", "row", "n", "name"), "minhash-asked")
    discard(shared)
    bitmap = docs.sparkSession.sparkContext.broadcast(bitmap_of(asked.select("row"), BITMAP))
    sets = docs.select("row", "text").mapInArrow(_sets(length, bitmap), "row long, class_id long, tokens binary")
    # Two documents of one class with one hash of the row have equal sets.
    index = stored(sets.join(asked, ["row", "class_id"]).dropDuplicates(["row", "class_id"]).select("class_id", "n", "tokens", "name"), "minhash-sets")
    links = verified_links(entries, index, percent)
    discard(asked, index)
    bitmap.unpersist()
    return connected_components(links)


def circulant_minhash(docs: DataFrame, length: int = 3, percent: int = 85, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included) and kept (is it that one) of each document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    signed = docs.mapInArrow(_signed(length, rows, bands), "doc_id long, row long, n_shingles long, class_id long, bands array<long>")
    sets = stored(signed, "minhash-signatures")
    classes, named = with_components(sets, F.min_by("row", F.struct(F.col("doc_id").isNotNull(), "doc_id", "row")).alias("row"), F.any_value("bands").alias("bands"))
    entries = classes.select("class_id", "n", F.explode("bands").alias("key"))
    found = named(minhash_components(docs, classes.drop("bands"), entries, length, percent))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
