"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames of about a megabyte and frames into
bundles, one file each. Behind its frames a bundle has a skippable frame that maps record
identifiers to (frame, offset, length), and last a seek table with the size of every
frame, so that any Zstandard reader can unpack it and one record takes one frame.

Spark writes and reads the files, wherever they lie. A bundle is written as one line of
text whose line end is the seek table's closing magic number, which is what makes
the bytes come out unchanged.

Payloads that occur more than once are stored once, with the largest identifier; the
others become revisit records. What is joined for that is identifiers and digests, never payloads.
"""

import base64
import hashlib
import json
import struct
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agentmeter.llm.common import land, small_batches
from agentmeter.session import scratch_path

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 32 << 20
LEVEL = 3

#: Fixed values of the formats.
_MAGIC = 0x8F92EAB1
_SEEK_FRAME = 0x184D2A5E
_INDEX_FRAME = 0x184D2A50
_LINE_END = struct.pack("<I", _MAGIC).decode("latin-1")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:x-record:"


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record(key: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One WARC record; the HTTP head of a revisit still tells the payload's size."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{_urn(key)}>",
        f"WARC-Date: {date}",
        # Blanks and control characters of a URL would end the header.
        f"WARC-Target-URI: {quote(url or 'about:blank', safe=_URL_SAFE)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: <{_urn(refers_to)}>", f"WARC-Profile: {_PROFILE}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return b"".join(("\r\n".join(head).encode(), b"\r\n\r\n", block, b"\r\n\r\n"))


_URL_SAFE = ":/?#[]@!$&'()*+,;=%-._~"


def _urn(key: str | None) -> str:
    return _ID if key is None else _ID + "k" + quote(key, safe="")


def _key(urn: str | None) -> str | None:
    name = (urn or "")[1:-1].removeprefix(_ID)
    return unquote(name[1:]) if name else None


def parse(data: bytes) -> dict:
    """key, type, refers_to, digest, payload_bytes and payload (None for a revisit) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, body = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    sizes = [line.split(b": ")[1] for line in http.split(b"\r\n") if line.startswith(b"Content-Length: ")]
    revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and (len(body) != int(sizes[0]) or base32(hashlib.sha1(body).hexdigest()) != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} isn't the one that was archived")
    return {
        "key": _key(fields["WARC-Record-ID"]),
        "type": fields["WARC-Type"],
        "url": fields["WARC-Target-URI"],
        "refers_to": _key(fields.get("WARC-Refers-To")),
        "digest": digest,
        "payload_bytes": int(sizes[0]),
        "payload": None if revisit else body,
    }


class Bundle:
    """A bundle in the making; ``content`` ends it, less the closing magic number."""

    def __init__(self) -> None:
        self.packer = zstandard.ZstdCompressor(level=LEVEL)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.index: list[tuple[str | None, int, int, int]] = []
        self.open: list[bytes] = []
        self.held = self.raw = 0

    def add(self, key: str | None, data: bytes) -> None:
        self.index.append((key, len(self.frames), self.held, len(data)))
        self.open.append(data)
        self.held += len(data)
        self.raw += len(data)
        if self.held >= FRAME_BYTES:
            self._close()

    def _close(self) -> None:
        if self.open:
            frame = self.packer.compress(b"".join(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.held))
            self.open, self.held = [], 0

    def content(self) -> bytes:
        self._close()
        index = json.dumps(self.index, separators=(",", ":")).encode()
        frame = struct.pack("<II", _INDEX_FRAME, len(index)) + index
        sizes = [*self.sizes, (len(frame), 0)]
        table = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IB", len(sizes), 0)
        head = struct.pack("<II", _SEEK_FRAME, len(table) + 4)
        return b"".join((*self.frames, frame, head, table))


def open_bundle(content: bytes) -> tuple[list[tuple[int, int]], list[list]]:
    """(start, end) of each frame in the bundle, and its index."""
    count, flags, magic = struct.unpack("<IBI", content[-9:])
    if magic != _MAGIC:
        raise ValueError("not a seekable bundle: the closing magic number is missing")
    width = 12 if flags & 0x80 else 8
    at, spans = 0, []
    for k in range(count):
        entry = len(content) - 9 - width * (count - k)
        size, _ = struct.unpack("<II", content[entry : entry + 8])
        spans.append((at, at + size))
        at += size
    start, end = spans.pop()
    return spans, json.loads(content[start + 8 : end])


def _bundler(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bundle, date = Bundle(), datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def written(bundle: Bundle) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([bundle.content()], pa.binary())], names=["content"])

    for batch in batches:
        columns = (batch.column(c) for c in ("key", "url", "body", "sha1", "refers_to"))
        for key, url, body, sha1, refers_to in zip(*columns, strict=True):
            name = key.as_py()
            bundle.add(
                name, record(name, url.as_py(), body.as_py(), base32(sha1.as_py()), refers_to.as_py(), date)
            )
            if bundle.raw >= BUNDLE_BYTES:
                yield written(bundle)
                bundle = Bundle()
    if bundle.raw:
        yield written(bundle)


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Archive a record for each row of ``pages`` under ``path``.

    Of the rows with equal payloads those with the largest key are responses, the
    others revisits of it; a row without a key revisits any that has one. A null payload is an
    empty one, a null URL is about:blank. Rows that repeat are archived as often as they
    came. Other columns are ignored; no rows give no bundles.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(
        F.col(key).alias("key"),
        F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(html).cast("string").cast("binary"), F.lit(b"")).alias("body"),
    ).withColumn("sha1", F.sha1("body"))
    light = land(rows.select("key", "sha1"), "digests")
    kept = light.groupBy("sha1").agg(F.max("key").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    again = (
        light.join(kept.drop("n"), "sha1")
        .where(F.col("refers_to").isNotNull() & ~F.col("key").eqNullSafe(F.col("refers_to")))
        .select(F.col("key").alias("again"), F.col("sha1").alias("same"), "refers_to")
        .distinct()
    )
    # Landed, so that Spark knows its size when it chooses how to join.
    again = land(again, "revisits")
    match = F.col("key").eqNullSafe(F.col("again")) & (F.col("sha1") == F.col("same"))
    bundles = (
        rows.join(again, match, "left")
        .select(
            F.col("key").cast("string"),
            "url",
            "body",
            "sha1",
            F.col("refers_to").cast("string"),
        )
        .mapInArrow(_bundler, "content binary")
    )
    (
        bundles.select(F.col("content").cast("string"))
        .write.option("maxRecordsPerFile", 1)
        .option("encoding", "ISO-8859-1")
        .option("lineSep", _LINE_END)
        .text(path)
    )


_FIELDS = "key string, url string, type string, refers_to string, digest string, payload_bytes long, payload binary"


def _reader(wanted: frozenset[str] | None):
    names = [f.split()[0] for f in _FIELDS.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = [(n, kinds[f.split()[1]]) for n, f in zip(names, _FIELDS.split(", "), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for scalar in batch.column("content"):
                content = scalar.as_py()
                spans, index = open_bundle(content)
                of_frame: dict[int, list] = {}
                for name, frame, offset, length in index:
                    if wanted is None or name in wanted:
                        of_frame.setdefault(frame, []).append((offset, length))
                for frame, places in of_frame.items():
                    data = unpacker.decompress(content[slice(*spans[frame])])
                    found = [parse(data[offset : offset + length]) for offset, length in places]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[n] for r in found], kind) for n, kind in fields], names=names
                    )

    return run


def read(spark: SparkSession, path: str, wanted: list[str] | None = None) -> DataFrame:
    """(key, url, type, refers_to, digest, payload_bytes, payload) of every record, keys as text.

    With ``wanted``, a short list of keys, only the frames that hold those records are unpacked.
    """
    small_batches(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_reader(None if wanted is None else frozenset(wanted)), _FIELDS)


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Archive ``pages``, read the archives back and describe each record.

    (key, payload_bytes, payload_digest, record_type, refers_to). A stored payload whose
    size or digest isn't what its record says ends the job.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write(pages, path, key, url, html)
    kind = pages.schema[key].dataType
    found = read(spark, path)
    return found.select(
        F.col("key").cast(kind).alias(key),
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.col("refers_to").cast(kind).alias("refers_to"),
    )
