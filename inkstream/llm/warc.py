"""WARC archives of Zstandard frames: one frame per record, the dictionary in a leading skippable frame.

An archive is bytes: [skippable frame 0x184D2A5D: dictionary, itself a frame] [record frame]*. Archives
travel as binary cells of bounded size, so any store that Spark can write and read holds them;
``archive_files`` also writes and ``read_files`` reads them as files.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, flagged, map_arrow, text_column

#: Frame magics of the format.
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
#: An archive is closed at so many bytes, and a dictionary is trained on so many bytes of its first records.
ARCHIVE_BYTES, TRAIN_BYTES, DICTIONARY_BYTES = 8 << 20, 1 << 20, 16 << 10
RECORD_LIMIT, DICTIONARY_LIMIT = 1 << 30, 16 << 20
TYPES = {"response": "application/http; msgtype=response", "revisit": "application/http; msgtype=response"}
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, uri string, payload binary"


class WarcError(ValueError):
    """An archive or record that breaks the format."""


def record_id(page_id: int | None) -> str:
    """A version 8 UUID that holds the 64 bits of the id; a null id has a mark instead."""
    if page_id is None:
        return "<urn:uuid:00000001-0000-8000-8000-000000000000>"
    n = page_id & (2**64 - 1)
    return f"<urn:uuid:{uuid.UUID(int=(8 << 76) | ((n >> 62) << 64) | (2 << 62) | (n & (2**62 - 1)))}>"


def page_of(rid: str) -> int | None:
    if not (rid.startswith("<urn:uuid:") and rid.endswith(">")):
        raise WarcError(f"record id {rid!r}")
    try:
        x = uuid.UUID(rid[10:-1]).int
    except ValueError as e:
        raise WarcError(f"record id {rid!r}") from e
    if x >> 96:
        return None
    n = ((x >> 64) & 3) << 62 | (x & (2**62 - 1))
    return n - 2**64 if n >> 63 else n


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def encode_record(page_id, uri: str | None, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """One record; a revisit has the HTTP head alone as its block, whose Content-Length tells the payload's."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if uri is not None:
        fields.append(("WARC-Target-URI", "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in uri)))
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to))]
    fields += [("WARC-Payload-Digest", _sha1(payload)), ("WARC-Block-Digest", _sha1(block)), ("Content-Type", TYPES["response"]), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def _headers(data: bytes, what: str) -> tuple[str, dict[str, str], int]:
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise WarcError(f"{what}: head doesn't end")
    try:
        first, *lines = data[:end].decode("utf-8").split("\r\n")
    except UnicodeDecodeError as e:
        raise WarcError(f"{what}: head is no UTF-8") from e
    out = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip() or name.lower() in out:
            raise WarcError(f"{what}: header line {line!r}")
        out[name.lower()] = value.strip()
    return first, out, end + 4


def _length(headers: dict[str, str], what: str) -> int:
    n = headers.get("content-length", "")
    if not n.isascii() or not n.isdigit():
        raise WarcError(f"{what}: Content-Length {n!r}")
    return int(n)


def decode_record(data: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, uri, payload); checks everything it reads."""
    version, headers, at = _headers(data, "record")
    if version not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError(f"version {version!r}")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise WarcError(f"no {name}")
    n = _length(headers, "record")
    if len(data) != at + n + 4 or data[-4:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length {n} doesn't fit a record of {len(data)} bytes")
    block = data[at : at + n]
    if headers.get("warc-block-digest", _sha1(block)) != _sha1(block):
        raise WarcError("block digest")
    kind = headers["warc-type"]
    if kind not in TYPES:
        raise WarcError(f"record type {kind!r}")
    _, http, body = _headers(block, "block")
    size, payload = _length(http, "block"), block[body:]
    digest = headers.get("warc-payload-digest", "")
    if kind == "response" and (len(payload) != size or digest != _sha1(payload)):
        raise WarcError("payload length or digest")
    if kind == "revisit" and payload:
        raise WarcError("a revisit with a payload")
    if not digest.startswith("sha1:"):
        raise WarcError(f"payload digest {digest!r}")
    if kind == "revisit" and "warc-refers-to" not in headers:
        raise WarcError("a revisit that refers to no record")
    refers = page_of(headers["warc-refers-to"]) if kind == "revisit" else None
    try:
        sha = base64.b32decode(digest[5:]).hex()
    except ValueError as e:
        raise WarcError(f"payload digest {digest!r}") from e
    return page_of(headers["warc-record-id"]), size, sha, kind, refers, headers.get("warc-target-uri"), payload if kind == "response" else None


def train(records: list[bytes]) -> bytes | None:
    """A dictionary from the first records of an archive, or none where they are too few."""
    if len(records) < 16 or sum(map(len, records)) < 8 * 1024:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records, level=3).as_bytes()
    except zstandard.ZstdError:
        return None


class Writer:
    """Collects records into archives of about ARCHIVE_BYTES."""

    def __init__(self):
        self.first: list[bytes] = []
        self.size = 0
        self.out: list[bytes] | None = None

    def add(self, record: bytes):
        if self.out is None:
            self.first.append(record)
            self.size += len(record)
            if self.size >= TRAIN_BYTES:
                self._open()
        else:
            self._put(record)
        if self.out is not None and self.size >= ARCHIVE_BYTES:
            yield self._take()

    def end(self):
        if self.first:
            self._open()
        if self.out:
            yield self._take()

    def _open(self):
        trained = train(self.first)
        self.out, self.size = [], 0
        if trained:
            packed = zstandard.ZstdCompressor(level=19).compress(trained)
            self.out.append(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None, write_checksum=True, write_content_size=True)
        first, self.first = self.first, []
        for x in first:
            self._put(x)

    def _put(self, record: bytes):
        frame = self.compressor.compress(record)
        self.out.append(frame)
        self.size += len(frame)

    def _take(self) -> bytes:
        out, self.out, self.size = b"".join(self.out), None, 0
        return out


def frames(archive: bytes):
    """The records of an archive, decoded one frame at a time."""
    view, at, dictionary = memoryview(archive), 0, None
    if len(view) >= 8 and struct.unpack_from("<I", view)[0] == DICTIONARY_MAGIC:
        size = struct.unpack_from("<I", view, 4)[0]
        if len(view) < 8 + size:
            raise WarcError("dictionary is cut off")
        packed, at = bytes(view[8 : 8 + size]), 8 + size
        if packed[:4] == struct.pack("<I", FRAME_MAGIC):
            try:
                packed = zstandard.ZstdDecompressor().decompress(packed, max_output_size=DICTIONARY_LIMIT)
            except zstandard.ZstdError as e:
                raise WarcError(f"dictionary: {e}") from e
        dictionary = zstandard.ZstdCompressionDict(packed)
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(view):
        if len(view) - at >= 8 and 0x184D2A50 <= struct.unpack_from("<I", view, at)[0] <= 0x184D2A5F:
            at += 8 + struct.unpack_from("<I", view, at + 4)[0]  # other skippable frames
            if at > len(view):
                raise WarcError("a skippable frame is cut off")
            continue
        d = decompressor.decompressobj(read_across_frames=False)
        out, start, size = [], at, 0
        while not d.eof:
            if at >= len(view):
                raise WarcError(f"frame at byte {start} is cut off")
            piece = view[at : at + (1 << 16)]
            try:
                out.append(d.decompress(piece))
            except zstandard.ZstdError as e:
                raise WarcError(f"frame at byte {start}: {e}") from e
            at, size = at + len(piece), size + len(out[-1])
            if size > RECORD_LIMIT:
                raise WarcError(f"frame at byte {start}: a record of more than {RECORD_LIMIT} bytes")
        at -= len(d.unused_data)
        yield b"".join(out)


def roles(pages: DataFrame, scratch: Scratch, least: int = 1000) -> DataFrame:
    """page_id, url, html, refers_to: non-null for revisits, whose payload goes unwritten but is still digested.

    Only digests and ids are grouped, with partial aggregation. Pages whose digest a bitmap of the repeated ones
    clears, small pages among them, are in no join; the others' join splits where a digest is hot.
    """
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), text_column("html").alias("html"))
    raw = F.encode("html", "utf-8")
    pages = pages.withColumn("digest", F.when(F.octet_length(raw) >= least, F.unhex(F.sha1(raw)))).withColumn("key", F.xxhash64("digest"))
    groups = pages.where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")
    groups = scratch.table(groups.withColumn("key", F.xxhash64("digest")))
    marked = flagged(pages, "key", groups, "key", "flag").withColumn("flag", F.col("flag") & F.col("digest").isNotNull())
    joined = marked.where("flag").join(groups.drop("key"), "digest", "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    joined = joined.select("page_id", "url", "html", F.when(revisit, F.col("keeper")).alias("refers_to"))
    return marked.where("not flag").select("page_id", "url", "html", F.lit(None).cast("long").alias("refers_to")).unionByName(joined)


def write_archives(rows: DataFrame) -> DataFrame:
    """archive binary: the records of ``roles`` in archives, some for each task."""

    def run(batches):
        writer = Writer()
        one = lambda a: pa.RecordBatch.from_arrays([pa.array([a], pa.binary())], ["archive"])
        for batch in batches:
            for page, url, html, refers in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                for done in writer.add(encode_record(page, url, html.encode(), refers, refers is not None)):
                    yield one(done)
        for done in writer.end():
            yield one(done)

    return map_arrow(rows, run, "archive binary")


def read_archives(archives: DataFrame, payload: bool = True) -> DataFrame:
    """A row per record of the ``archive`` column; a record that breaks the format fails the job."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows = []
                for x in frames(batch.column(0)[i].as_py()):
                    rows.append(decode_record(x) if payload else (*decode_record(x)[:6], None))
                    if len(rows) == 500:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    return map_arrow(archives.select("archive"), run, READ)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in READ.split(", ")])


def archive_files(archives: DataFrame, folder: str) -> DataFrame:
    """Write each archive as a file of a folder that all executors mount; file names come from the content, so reruns agree."""

    def run(batches):
        import os

        for batch in batches:
            for a in batch.column(0).to_pylist():
                name = f"{folder}/{hashlib.sha256(a).hexdigest()[:32]}.warc.zst"
                with open(part := f"{name}.{uuid.uuid4().hex}", "wb") as f:
                    f.write(a)
                os.replace(part, name)
                yield pa.RecordBatch.from_arrays([pa.array([name])], ["path"])

    return map_arrow(archives.select("archive"), run, "path string")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The records of ``*.warc.zst`` files below a path."""
    return read_archives(spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select(F.col("content").alias("archive")))


def round_trip(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Write a record per page and read the archives back: the records' columns without payloads.

    Nulls: null html is an empty payload; a page without id keeps none, and is a revisit of any page with
    an id that has its payload; a null url is not written. Rows that repeat the largest id of a group are
    all responses. An empty table has no archive and no row.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    archives = scratch.table(write_archives(roles(pages, scratch, least)))
    return read_archives(archives, payload=False).drop("payload")
