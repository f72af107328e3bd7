"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding a few records, closed by
a seek table: a skippable frame that lists the compressed and plain size of every frame,
as in the public seekable format. The index maps a record's identifier to its frame and
its offset and length inside the plain frame, so one record costs one frame's read.

Bundles lie in a folder that all executors share. A task writes its bundles under names of
its own and reports them in the index; the index is a table that a Spark job commits, so
files of failed or repeated attempts are never read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyrank.session import scratch

FRAME = 1 << 20  # plain bytes after which a frame is closed
BUNDLE = 256 << 20  # plain bytes after which a bundle is closed
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"  # records carry no clock of their own

# Fixed values of the seekable format: a skippable frame's magic number, the table's magic number.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

INDEX = ("record_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, "
         "bundle string, frame int, frame_at long, frame_size long, frame_plain long, offset long, length long")
RECORD = "record_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, url string, payload binary"


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(record_id: int) -> str:
    return f"<urn:page:{record_id}>"


def record(record_id: int, url: str, payload: bytes, payload_digest: str, size: int, refers_to: int | None) -> bytes:
    """One record of WARC 1.1: a response with its payload, or a revisit without."""
    body = b"" if refers_to is not None else payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_uri(record_id)}",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {' '.join(url.split())}", f"WARC-Payload-Digest: sha1:{payload_digest}",
        f"WARC-Payload-Length: {size}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {_uri(refers_to)}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's fields; the inverse of ``record``."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    number = lambda name: int(fields[name].rpartition(":")[2].rstrip(">")) if name in fields else None
    return {
        "record_id": number("WARC-Record-ID"), "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To"),
        "payload_bytes": int(fields["WARC-Payload-Length"]),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "url": fields["WARC-Target-URI"],
        "payload": rest[:int(fields["Content-Length"])] if fields["WARC-Type"] == "response" else None,
    }


class BundleWriter:
    """Frames of one bundle, streamed to its file; memory holds one frame and the seek table."""

    def __init__(self, folder: str, frame: int = FRAME, level: int = LEVEL):
        fs, path = _filesystem(folder)
        fs.create_dir(path, recursive=True)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self._out = fs.open_output_stream(f"{path}/{self.name}", compression=None)
        self._packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self._frame, self.at, self.plain = frame, 0, 0
        self._open, self._rows, self._table = bytearray(), [], []

    def add(self, data: bytes, row: dict) -> list[dict]:
        """Index rows of the frames that this record closes."""
        self._rows.append(row | {"bundle": self.name, "frame": len(self._table), "offset": len(self._open), "length": len(data)})
        self._open += data
        self.plain += len(data)
        return self._flush() if len(self._open) >= self._frame else []

    def _flush(self) -> list[dict]:
        if not self._rows:
            return []
        packed = self._packer.compress(bytes(self._open))
        self._out.write(packed)
        rows = [r | {"frame_at": self.at, "frame_size": len(packed), "frame_plain": len(self._open)} for r in self._rows]
        self._table.append((len(packed), len(self._open)))
        self.at += len(packed)
        self._open, self._rows = bytearray(), []
        return rows

    def close(self) -> list[dict]:
        rows = self._flush()
        body = b"".join(struct.pack("<II", *sizes) for sizes in self._table)
        body += struct.pack("<IBI", len(self._table), 0, SEEKABLE_MAGIC)
        self._out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)
        self._out.close()
        return rows


def seek_table(file) -> list[tuple[int, int, int]]:
    """``(start, packed size, plain size)`` of each frame, from a bundle's footer."""
    size = file.size()
    file.seek(size - 9)
    count, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table at the end of the bundle")
    file.seek(size - 9 - 8 * count)
    sizes = struct.unpack(f"<{2 * count}I", file.read(8 * count))
    out, at = [], 0
    for packed, plain in zip(sizes[::2], sizes[1::2], strict=True):
        out.append((at, packed, plain))
        at += packed
    return out


def write_bundles(records: DataFrame, folder: str, frame: int = FRAME) -> DataFrame:
    """Writes ``records`` (record_id, url, payload, refers_to) as bundles below ``folder`` and
    returns their index, kept as a table in ``folder/index``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("bundle", pa.string()),
                            ("frame", pa.int32()), ("frame_at", pa.int64()), ("frame_size", pa.int64()),
                            ("frame_plain", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])
        bundle = None
        for batch in batches:
            rows = []
            for r in zip(*(batch.column(c) for c in ("record_id", "url", "payload", "refers_to")), strict=True):
                record_id, url, payload, refers_to = (x.as_py() for x in r)
                name, size = digest(payload), len(payload)
                bundle = bundle or BundleWriter(f"{folder}/bundles", frame)
                rows += bundle.add(record(record_id, url or "", payload, name, size, refers_to), {
                    "record_id": record_id, "record_type": "response" if refers_to is None else "revisit",
                    "refers_to": refers_to, "payload_bytes": size, "payload_digest": name})
                if bundle.plain >= BUNDLE:
                    rows += bundle.close()
                    bundle = None
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)
        if bundle:
            yield pa.RecordBatch.from_pylist(bundle.close(), schema)

    records.mapInArrow(run, INDEX).write.mode("errorifexists").parquet(f"{folder}/index")
    return records.sparkSession.read.parquet(f"{folder}/index")


def read_bundles(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Every record of ``index``, read back from its frame. Rows of a frame are grouped, so
    each frame is read and unpacked once; a filtered index reads only the frames it names.
    A response whose payload does not have its digest and length is an error. Without
    ``payloads`` that column is null."""
    frames = index.groupBy("bundle", "frame").agg(
        F.collect_list(F.struct("offset", "length")).alias("places"))  # bounded by a frame's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("url", pa.string()),
                            ("payload", pa.binary())])
        fs, path = _filesystem(f"{folder}/bundles")
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            wanted: dict[str, list] = {}
            for b, f, p in zip(*(batch.column(c) for c in ("bundle", "frame", "places")), strict=True):
                wanted.setdefault(b.as_py(), []).append((f.as_py(), p))
            for name, parts in wanted.items():
                with fs.open_input_file(f"{path}/{name}") as file:
                    table = seek_table(file)
                    for no, places in sorted(parts, key=lambda x: x[0]):
                        at, packed, plain = table[no]
                        file.seek(at)
                        data = unpacker.decompress(file.read(packed), max_output_size=plain)
                        rows = [parse(data[p["offset"]:p["offset"] + p["length"]]) for p in places.as_py()]
                        for r in rows:
                            body = r["payload"]
                            if body is not None and (digest(body), len(body)) != (r["payload_digest"], r["payload_bytes"]):
                                raise ValueError(f"record {r['record_id']} of {name} is damaged")
                            r["payload"] = body if payloads else None
                        yield pa.RecordBatch.from_pylist(rows, schema)

    return frames.mapInArrow(run, RECORD)


def prepared(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url",
             html_col: str = "html") -> DataFrame:
    """Records for ``write_bundles``: equal payloads of at least ``least`` bytes refer to that
    of smallest id. Null html is the empty payload; rows without id are left out, since a
    record needs an identifier; of repeated ids each row gives a record.

    Firsts are found on digests alone and joined back by digest, so payloads move once and
    a payload with very many copies is a skewed join that Spark splits.
    """
    rows = pages.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("record_id"), F.col(url_col).alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("key", F.sha2("payload", 256))
    first = rows.groupBy("key").agg(F.min("record_id").alias("first"))
    size = F.octet_length("payload").cast("long")
    return rows.join(first, "key").select(
        "record_id", "url", "payload",
        F.when((F.col("first") != F.col("record_id")) & (size >= least), F.col("first")).alias("refers_to"))


def archive(pages: DataFrame, folder: str, least: int = 0, frame: int = FRAME) -> DataFrame:
    """Writes ``pages`` to bundles below ``folder``; returns the index."""
    return write_bundles(prepared(pages, least), folder, frame)


def round_trip(spark: SparkSession, pages: DataFrame, least: int = 0) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` as read back from
    archives written to a fresh folder of the shared scratch space."""
    folder = scratch(spark, "warc")
    read = read_bundles(archive(pages, folder, least), folder, payloads=False)
    return read.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
