"""Bitmaps of a fixed size: a filter before a join. A full one lets others pass too, which the join then drops."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _words(column: str, size: int):
    """Of each batch: the words of 64 bits in which its hashes set any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.asarray(batch.column(column)).view(np.uint64) % np.uint64(size)
            word, at = np.unique(bits >> np.uint64(6), return_inverse=True)
            marks = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(marks, at, np.uint64(1) << (bits & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(marks.view(np.int64))], ["word", "bits"])

    return run


def bitmap_of(hashes: DataFrame, size: int) -> np.ndarray:
    """The bitmap of hashes (one long column without nulls). No more than size / 64 words come to the driver."""
    words = hashes.mapInArrow(_words(hashes.columns[0], size), "word long, bits long")
    words = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[np.asarray(words["word"], np.int64)] = np.asarray(words["bits"], np.int64).view(np.uint64)
    return out


def marked(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of these (unsigned) hashes the bitmap has a bit for."""
    bits = hashes % np.uint64(64 * len(bitmap))
    return (bitmap[bits >> np.uint64(6)] >> (bits & np.uint64(63)) & np.uint64(1)).astype(bool)
