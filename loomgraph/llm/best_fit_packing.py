"""Best-fit packing of tokenised documents into sequences of bounded length, by a linear grouping scheme.

A document is its ids and an end id. Only documents longer than a sequence are cut, into pieces of its length; the
last piece may be shorter. Texts are tokenised batch by batch: every distinct word of a worker goes through the
tokenizer once (white space parts words in this vocabulary, so ids of words are the ids of the text); texts with special
tokens or combining marks are tokenised as they are.

The histogram of piece lengths (as many numbers as a sequence has tokens, at most) gives a plan (linear_grouping.plan);
each piece's rank among those of its length tells its sequence and offset. Ranks are counted within (length, cell)
where a cell is a range of hashes, so a length that very many documents have is spread. Pieces that fill a sequence
take one each and need no rank.

Null texts are empty: the end id alone. Repeated rows are packed each for itself. Pieces of one length are ranked by
doc_id, piece and ids; rows that tie in all of these are alike, so any of their orders gives the same result. An empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .linear_grouping import plan
from .words import slices, text_bytes, words

CAPACITY, CELLS, KNOWN_WORDS = 2048, 256, 3_000_000
END = 0


def gather(flat: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The runs flat[starts[k] : starts[k] + length[k]], one after the other."""
    ends = np.cumsum(length)
    return flat[np.repeat(starts - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)]


class WordTokenizer:
    """Ids of words (two bytes each: vocabularies of up to 65536), each word tokenised once, for as many words as the bound allows at a time."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.final = np.zeros(max(vocabulary.values()) + 1, bool)
        self.final[[v for k, v in vocabulary.items() if k.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.keys, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.ids, self.ends = np.zeros(1 << 20, np.uint16), np.zeros(1, np.int64)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all in one array, and each one's place and number there. Words of letters alone are joined: the vocabulary marks their ends."""
        plain, rest = [k for k, x in enumerate(texts) if x.isalpha()], [k for k, x in enumerate(texts) if not x.isalpha()]
        order, flat, length = [], [], []
        for at in range(0, len(plain), 512):
            some = plain[at : at + 512]
            ids = np.array(self.tokenizer.encode(" ".join([texts[k] for k in some]), add_special_tokens=False).ids, np.uint16)
            ends = np.flatnonzero(self.final[ids]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                order += some
                flat.append(ids)
                length.append(np.diff(ends, prepend=0))
            else:
                rest += some
        own = self._encode([texts[k] for k in rest])
        flat.append(np.fromiter((i for x in own for i in x), np.uint16))
        length.append(np.array([len(x) for x in own], np.int64))
        size, starts = np.concatenate(length), np.zeros(len(texts), np.int64)
        order = np.array(order + rest, np.int64)
        starts[order] = np.cumsum(size) - size
        lengths = np.zeros(len(texts), np.int64)
        lengths[order] = size
        return np.concatenate(flat), starts, lengths

    def _learn(self, keys: np.ndarray, texts: list[bytes]) -> None:
        """keys: sorted and new. Letters or digits before final marks are tokenised apart from the marks."""
        parts: dict[bytes, int] = {b"": 0}
        which = np.zeros((len(texts), 2), np.int64)
        for k, text in enumerate(texts):
            body = text.rstrip(b".,;:!?")
            if not (body and len(body) < len(text) and (48 <= body[-1] <= 57 or 97 <= body[-1] <= 122)):
                body = text
            which[k, 0] = parts.setdefault(body, len(parts))
            if len(body) < len(text):
                which[k, 1] = parts.setdefault(text[len(body) :], len(parts))
        flat, starts, length = self._encode_words([x.decode("utf-8", "replace") for x in parts])
        new = gather(flat, starts[which.ravel()], length[which.ravel()])
        at = int(self.ends[-1])
        while at + len(new) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(len(self.ids), np.uint16)))
        self.ids[at : at + len(new)] = new
        where = np.searchsorted(self.keys, keys)
        self.places = np.insert(self.places, where, np.arange(len(self.keys), len(self.keys) + len(keys), dtype=np.int32))
        self.keys = np.insert(self.keys, where, keys)
        self.ends = np.concatenate((self.ends, at + np.cumsum(length[which].sum(1))))

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by END, and where each text's begin (one more entry for the end)."""
        data, offsets = text_bytes(column)
        odd = np.zeros(len(data), bool)
        if len(data):
            odd[:-1] = (data[:-1] == 0x3C) & (data[1:] == 0x7C)
            odd |= (data == 0xCC) | (data == 0xCD)
        odd = np.unique(np.searchsorted(offsets, np.flatnonzero(odd), "right") - 1)
        hashes, begins, ends, before = words(data, offsets)
        keys, firsts, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > KNOWN_WORDS:
            self.clear()
        at = np.searchsorted(self.keys, keys)
        missing = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] != keys) if len(self.keys) else np.arange(len(keys))
        if len(missing):
            raw = data.tobytes()
            self._learn(keys[missing], [raw[begins[f] : ends[f]].lower() for f in firsts[missing].tolist()])
        place = self.places[np.searchsorted(self.keys, keys)][inverse]
        starts, length = self.ends[place], self.ends[place + 1] - self.ends[place]
        flat = gather(self.ids, starts, length)
        edges = np.concatenate(([0], np.cumsum(length)))[before]
        out = np.insert(flat, edges[1:], END).astype(np.uint32)
        edges = edges + np.arange(len(edges))
        if len(odd):
            own = self._encode([bytes(data[offsets[k] : offsets[k + 1]]).decode("utf-8", "replace") for k in odd.tolist()])
            pieces = [out[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            for k, ids in zip(odd.tolist(), own, strict=True):
                pieces[k] = np.array([*ids, END], np.uint32)
            out, edges = np.concatenate(pieces), np.concatenate(([0], np.cumsum([len(x) for x in pieces])))
        return out, edges


_tokenizers: dict[str, WordTokenizer] = {}


def _pieces(path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizers.get(path) or _tokenizers.setdefault(path, WordTokenizer(path))
        for batch in slices(batches, "text"):
            ids, edges = tokenizer(batch.column("text"))
            size = np.diff(edges)
            number = -(-size // capacity)
            owner = np.repeat(np.arange(len(size)), number)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
            start = piece * capacity
            length = np.minimum(size[owner] - start, capacity)
            begin = edges[:-1][owner] + start
            view = memoryview(np.ascontiguousarray(ids).view(np.uint8))
            crc = [zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(begin.tolist(), length.tolist(), strict=True)]
            columns = [batch.column("doc_id").take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(np.concatenate((begin, edges[-1:])).astype(np.int32), ids.astype(np.int32)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _placed(rows, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rows.value
        keys = (table[:, 0] << 40) | table[:, 1]
        for batch in batches:
            length, rank = (batch.column(x).to_numpy() for x in ("length", "_rank"))
            run = np.searchsorted(keys, (length << 40) | rank, "right") - 1
            found = table[run]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(found[:, 3] + rank - found[:, 1]), pa.array(found[:, 4])], [*names, "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id and offset.

    tokenizer: the path of a vocabulary in which words stand for themselves; it must be there on every executor.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    pieces = stored(docs.select("doc_id", "text").mapInArrow(_pieces(path, capacity, with_ids), schema), "pack-pieces")
    full, part = pieces.filter(F.col("length") == capacity), pieces.filter(F.col("length") < capacity)
    part = part.withColumn("_cell", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(CELLS)).cast("int"))
    counts = stored(part.groupBy("length", "_cell").agg(F.count("*").alias("_n")), "pack-counts")  # capacity x CELLS rows at most
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    rows, _ = plan(histogram, capacity)
    before = counts.select("length", "_cell", (F.sum("_n").over(Window.partitionBy("length").orderBy("_cell")) - F.col("_n")).alias("_before"))
    ranked = part.withColumn("_k", F.row_number().over(Window.partitionBy("length", "_cell").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "_cell"]).withColumn("_rank", (F.col("_before") + F.col("_k")).cast("long"))
    names = pieces.columns
    placed = ranked.mapInArrow(_placed(docs.sparkSession.sparkContext.broadcast(rows), names), f"{schema}, sequence_id long, offset long")
    return placed.unionByName(full.withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")}))
