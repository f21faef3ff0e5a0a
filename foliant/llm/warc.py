"""WARC archives compressed record by record with a shared Zstandard dictionary.

Pages are dealt to archives by a hash of their id, so many that an archive has about ARCHIVE_PAGES pages and ARCHIVE_BYTES
bytes. Each archive trains a dictionary on a bounded sample of its own records, writes it, compressed, into a leading
skippable frame (magic number 0x184D2A5D, as the WARC-zstd proposal says), and compresses every record as a frame of its
own, so that records can be read one by one. Records too few or too small to train on are the dictionary themselves.
Pages with equal payloads are written once: the least page_id is the response, others are revisit records without a body.

The archives go to the shared folder through pyarrow's file systems, first under another name, then renamed, so a task
that runs twice leaves one whole file. They are read back as streams, record by record, whatever their size.

Defined results: a null html is an empty payload. Rows of the same least page_id with the same payload are all
responses. A null page_id gets a record without an id; it refers to the least page_id of its payload if there is one and
is a response otherwise. Header values have line breaks replaced. Other columns are ignored. An empty table gives no
archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from itertools import batched
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import bounded_batches, columns, materialize, partitions_of, shared_dir

SKIPPABLE = 0x184D2A5D
#: Bytes of the dictionary, and of the records it is trained on, at most.
DICTIONARY, SAMPLE = 48 << 10, 2 << 20
LEVEL = 6
#: Pages and bytes of payload in an archive, about.
ARCHIVE_PAGES, ARCHIVE_BYTES = 2000, 64 << 20
#: Bytes read from an archive at a time.
READ = 1 << 20
#: A list of so many repeated payloads at most is broadcast; a longer one is joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Payloads with fewer bytes are never revisited.
LEAST_REVISIT = 0


def revisits(pages: DataFrame, least_bytes: int = LEAST_REVISIT) -> DataFrame:
    """(digest, first) for payloads that more than one page has."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes"))
    return keyed.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")


def _line(value: str | None) -> str:
    return (value or "").replace("\r", " ").replace("\n", " ")


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record or, if it refers to another, a revisit record. digest is in hexadecimal."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'none' if page_id is None else page_id}>"),
        ("WARC-Target-URI", _line(url)),
        ("WARC-Date", "2024-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
    ]
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return "".join(["WARC/1.1\r\n", *[f"{k}: {v}\r\n" for k, v in fields], "\r\n"]).encode() + block + b"\r\n\r\n"


def train(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary from records; where there is too little to train on, the end of the records themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY, records, k=512, d=8, level=LEVEL)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(records)[-DICTIONARY:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def frame_of(dictionary: zstandard.ZstdCompressionDict) -> bytes:
    """The leading skippable frame that holds the dictionary."""
    body = zstandard.ZstdCompressor(level=9).compress(dictionary.as_bytes())
    return struct.pack("<II", SKIPPABLE, len(body)) + body


class _Archive:
    """One archive being written: the first records wait until the dictionary is trained on them."""

    def __init__(self, system: pyarrow.fs.FileSystem, root: str, number: int):
        self.system, self.number, self.records = system, number, 0
        self.final, self.part = f"{root}/{number:06d}.warc.zst", f"{root}/_{number:06d}-{uuid.uuid4().hex}"
        self.stream = system.open_output_stream(self.part, compression=None)
        self.waiting: list[bytes] = []
        self.held, self.compressor = 0, None

    def add(self, record: bytes) -> None:
        self.records += 1
        if self.compressor is not None:
            self.stream.write(self.compressor.compress(record))
            return
        self.waiting.append(record)
        self.held += len(record)
        if self.held >= SAMPLE:
            self._begin()

    def _begin(self) -> None:
        dictionary = train(self.waiting)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary)
        self.stream.write(frame_of(dictionary))
        for r in self.waiting:
            self.stream.write(self.compressor.compress(r))
        self.waiting = []

    def close(self) -> tuple[int, str, int]:
        if self.compressor is None:
            self._begin()
        self.stream.close()
        self.system.move(self.part, self.final)
        return self.number, self.final, self.records


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pyarrow.fs.FileSystem.from_uri(folder)
        archive: _Archive | None = None
        done = []
        for batch in batches:
            for row in batch.to_pylist():
                if archive is None or row["archive"] != archive.number:
                    if archive is not None:
                        done.append(archive.close())
                    archive = _Archive(system, root, row["archive"])
                archive.add(_record(row["page_id"], row["url"], (row["html"] or "").encode(), row["digest"], row["first"]))
        if archive is not None:
            done.append(archive.close())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], k) for i, k in enumerate((pa.int64(), pa.string(), pa.int64()))], names=["archive", "path", "records"])

    return run


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = LEAST_REVISIT, archive_pages: int = ARCHIVE_PAGES, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Write pages (page_id, url, html) into archives; returns their folder."""
    spark = pages.sparkSession
    folder = folder or shared_dir(spark, "warc")
    bounded_batches(spark, 200)
    system, root = pyarrow.fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    pages = columns(pages, "page_id", "url", "html")
    first = materialize(revisits(pages, least_bytes), "warc-revisits")
    if first.count() <= BROADCAST_ROWS:
        first = F.broadcast(first)
    keyed = pages.withColumn("digest", F.sha1(F.coalesce(F.col("html"), F.lit("")))).join(first, "digest", "left")
    whole = pages.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("html")), F.lit(0)).alias("bytes")).first()
    archives = max(1, -(-whole["n"] // archive_pages), -(-whole["bytes"] // archive_bytes))
    keyed = keyed.withColumn("first", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
    dealt = keyed.withColumn("archive", F.pmod(F.xxhash64("page_id", "digest"), F.lit(archives)))
    dealt = dealt.select("archive", "page_id", "url", "html", "digest", "first").repartition(max(archives, 1) if archives < partitions_of(pages) else partitions_of(pages), "archive").sortWithinPartitions("archive", "page_id", "digest")
    written = materialize(dealt.mapInArrow(_write(folder), "archive long, path string, records long"), "warc-written")
    if (written.agg(F.sum("records")).first()[0] or 0) != whole["n"]:
        raise RuntimeError("archives don't hold every page")
    return folder


def records_of(stream: BinaryIO) -> Iterator[bytes]:
    """The decompressed records of an archive, one after another."""
    decompressor, fed = zstandard.ZstdDecompressor(), stream.read(8)
    if len(fed) == 8 and struct.unpack("<I", fed[:4])[0] == SKIPPABLE:
        raw = decompressor.decompress(stream.read(struct.unpack("<I", fed[4:])[0]))
        decompressor, fed = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)), b""
    while fed := fed or stream.read(READ):
        frame, parts = decompressor.decompressobj(), []
        while not frame.eof:
            fed = fed or stream.read(READ)
            if not fed:
                raise ValueError("an archive ends within a record")
            parts.append(frame.decompress(fed))
            fed = frame.unused_data if frame.eof else b""
        yield b"".join(parts)


def _page(urn: str | None) -> int | None:
    found = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(found) if found and found != "none" else None


def parse_record(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Header fields of a record, of the HTTP response in it, and the payload."""
    head, _, block = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def _read(folder: str):
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]

    def rows(stream: BinaryIO) -> Iterator[tuple]:
        for record in records_of(stream):
            fields, http, payload = parse_record(record)
            digest, kind, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"], int(http["Content-Length"])
            if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
            yield _page(fields["WARC-Record-ID"]), size, digest, kind, _page(fields.get("WARC-Refers-To")), fields["WARC-Target-URI"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch["path"].to_pylist():
                with system.open_input_stream(f"{root}/{path.rsplit('/', 1)[-1]}", compression=None) as stream:
                    for some in batched(rows(stream), 10_000):
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in some], k) for i, k in enumerate(kinds)], names=names)

    return run


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of every record; payloads are held against their digests."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path")
    return files.mapInArrow(_read(folder), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")
