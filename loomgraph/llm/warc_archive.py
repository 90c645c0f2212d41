"""Dictionary-compressed WARC archives of pages, and their reader.

A writer takes records until an archive has ARCHIVE_BYTES of payload. From the archive's own records it trains a
Zstandard dictionary, which it puts, compressed, into a skippable frame at the head of the file; a warcinfo record and
each page's record then are frames of their own, compressed with the dictionary. A revisit names the response's record,
whose number follows from its page_id and digest. Archives go to the shared folder under a new name each, by a hidden
name first; the table of names that the writers return is written once, so that what a lost task left is never read.

Of pages with equal payloads of at least DUPLICATE_BYTES bytes, those with the largest page_id are responses, the others
revisits that refer to it. Payloads are told apart by their SHA-1. Sizes, digests and largest page_ids of repeated
payloads are found on narrow rows first; only the decision is joined to the pages.

A null html is an empty payload (a response); a null url is left out. A null page_id is smaller than any other; if
repeated payloads have null page_ids alone, all of them are responses. Rows that share the largest page_id of a payload
are all responses. An empty table gives no archive and an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, stored

ARCHIVE_BYTES, DUPLICATE_BYTES = 16 << 20, 1000
#: Of an archive's records, evenly spaced ones of so many bytes in all train a dictionary of so many bytes.
SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 3 << 20, 32 << 10, 3
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _digest32(digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id} {digest}')}>"


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in (*fields, ("Content-Length", str(len(block)))))
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def info_bytes(name: str, date: str) -> bytes:
    """The warcinfo record of an archive."""
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, name)}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
    return _record(fields, b"software: loomgraph\r\nformat: WARC File Format 1.1\r\n")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """A WARC/1.1 record; the page's number and the payload's size travel in fields of our own."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    name = "" if page_id is None else str(page_id)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id(page_id, digest)),
        ("WARC-Date", date),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", _digest32(digest)),
        ("X-Payload-Length", str(len(payload))),
        ("X-Page-ID", name),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers_to, digest)), ("X-Refers-To-Page-ID", "" if refers_to is None else str(refers_to))]
    return _record(fields, block)


def archive_bytes(records: list[bytes]) -> bytes:
    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    samples = records[::step]
    try:
        dictionary = zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 8), samples, k=256, d=8)
    except zstandard.ZstdError:  # too few records, or too small: their bytes are the dictionary
        dictionary = zstandard.ZstdCompressionDict(b"".join(samples)[:DICTIONARY_BYTES] or b"WARC/1.1", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary.as_bytes())
    writer = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
    return b"".join((struct.pack("<II", SKIPPABLE, len(packed)), packed, *map(writer.compress, records)))


def records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records' fields and blocks, in order, from the bytes of an archive."""
    magic, size = struct.unpack_from("<II", archive)
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame at the head of the archive")
    dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(archive[8 : 8 + size]))
    with zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(memoryview(archive)[8 + size :], read_across_frames=True) as raw:
        stream = io.BufferedReader(raw, 1 << 20)
        while line := stream.readline():
            if line.rstrip() != b"WARC/1.1":
                raise ValueError(f"no record where one should begin: {line[:40]!r}")
            fields = {}
            while (line := stream.readline().rstrip(b"\r\n")):
                name, _, value = line.decode().partition(":")
                fields[name.lower()] = value.strip()
            block = stream.read(int(fields["content-length"]))
            stream.read(4)
            yield fields, block


def _write(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = pyarrow.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        waiting: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(f"{path}/.{name}", compression=None) as out:
                out.write(archive_bytes([info_bytes(name, date), *waiting]))
            store.move(f"{path}/.{name}", f"{path}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(waiting)], pa.int64())], ["name", "records"])

        store.create_dir(path)
        for batch in batches:
            for page_id, url, html, digest, refers_to, revisit in zip(*(batch.column(x) for x in ("page_id", "url", "html", "digest", "refers_to", "revisit")), strict=True):
                payload = (html.as_py() or "").encode()
                record = record_bytes(page_id.as_py(), url.as_py(), payload, digest.as_py(), refers_to.as_py(), revisit.as_py(), date)
                waiting.append(record)
                size += len(record)
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    waiting, size = [], 0
        if waiting:
            yield flush()

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload_intact"]
    number = lambda x: int(x) if x else None
    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for fields, block in records(content.as_py()):
                if fields["warc-type"] == "warcinfo":
                    continue
                payload, said = block.partition(b"\r\n\r\n")[2], base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
                if fields["warc-type"] == "response":
                    size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                else:
                    size, digest = int(fields["x-payload-length"]), said
                rows.append((number(fields["x-page-id"]), size, digest, fields["warc-type"], number(fields.get("x-refers-to-page-id")), fields.get("warc-target-uri"), digest == said and size == int(fields["x-payload-length"])))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes every page to archives in that folder (a URI that all executors reach): their names and numbers of records."""
    html = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(html.cast("binary")).alias("digest"))
    meta = pages.select("page_id", F.octet_length(html).alias("size"), "digest").filter(F.col("size") >= DUPLICATE_BYTES)
    repeated = meta.groupBy("digest").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).filter("n > 1").select(F.col("digest").alias("_digest"), "largest")
    joined = pages.join(repeated, F.col("digest") == F.col("_digest"), "left")
    revisit = F.col("_digest").isNotNull() & F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    rows = joined.select("page_id", "url", "html", "digest", F.when(revisit, F.col("largest")).alias("refers_to"), revisit.alias("revisit"))
    date = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    return stored(rows.mapInArrow(_write(folder, date), "name string, records long"), "warc-names")


def read_archives(names: DataFrame, folder: str) -> DataFrame:
    """A row for each record of the archives with these names."""
    spark = names.sparkSession
    if not names.take(1):
        files = spark.createDataFrame([], "content binary")
    else:
        files = spark.read.format("binaryFile").load(folder).withColumn("name", F.element_at(F.split("path", "/"), -1)).join(names, "name", "left_semi").select("content")
    return files.mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload_intact boolean")


def archive_pages(pages: DataFrame) -> DataFrame:
    folder = new_folder(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder), folder)


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
     w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS largest FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {DUPLICATE_BYTES} AND page_id <> largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {DUPLICATE_BYTES} AND page_id <> largest THEN largest END AS refers_to
FROM w
"""
