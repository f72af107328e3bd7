"""Plug-in sources as a Spark data source: ``spark.read.format("landed_items")``.

A reader is a function from one landed file, open as a binary stream, to raw records.
Files are the partitions and are read as a stream; a record that cannot be parsed or mapped
is skipped, not raised.
"""

from __future__ import annotations

import hashlib
import io
import json
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Reader = Callable[[io.RawIOBase], Iterator[dict]]
READERS: dict[str, Reader] = {}

SCHEMA = (
    "id string, source string, family string, url string, title string, author string,"
    " published_at timestamp, raw_text string"
)
NAMES = [field.split()[0] for field in SCHEMA.split(",")]
TYPES = [pa.timestamp("us", tz="UTC") if field.endswith(" timestamp") else pa.string() for field in SCHEMA.split(",")]
BATCH_CHARS = 2_000_000  # text that a task holds before it hands its rows on


def source_reader(name: str) -> Callable[[Reader], Reader]:
    def add(fn: Reader) -> Reader:
        READERS[name] = fn
        return fn

    return add


@source_reader("json_lines")
def json_lines(stream: io.RawIOBase) -> Iterator[dict]:
    """One record a line; blank lines and lines that are no JSON give none."""
    for line in io.TextIOWrapper(stream, encoding="utf-8", errors="replace"):
        try:
            yield json.loads(line)
        except ValueError:
            continue


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


class LandedFile(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class LandedItemsReader(DataSourceReader):
    def __init__(self, options: dict, reader: Reader) -> None:
        self.path = options["path"]
        self.source = options.get("source", "landed")
        self.family = options.get("family", "meta")
        self.reader = reader

    def partitions(self) -> list[LandedFile]:
        from pyarrow import fs

        files, base = _filesystem(self.path)
        found = files.get_file_info(fs.FileSelector(base, recursive=True))
        return [
            LandedFile(f.path) for f in found
            if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))
        ]

    def read(self, partition: LandedFile) -> Iterator[pa.RecordBatch]:
        """Batches cut by the length of their texts: cut by rows alone, a task would hold 10,000 whole pages."""
        held, chars = [], 0
        for row in self._rows(partition):
            held.append(row)
            chars += sum(len(value) for value in row if isinstance(value, str))
            if chars >= BATCH_CHARS or len(held) == 10_000:
                yield _batch(held)
                held, chars = [], 0
        if held:
            yield _batch(held)

    def _rows(self, partition: LandedFile) -> Iterator[tuple]:
        files, _ = _filesystem(self.path)
        with files.open_input_stream(partition.path) as stream:
            for record in self.reader(stream):
                try:
                    row = self._row(record)
                except (AttributeError, KeyError, TypeError, ValueError):
                    continue
                if row is not None:
                    yield row

    def _row(self, record: dict):
        title = (record.get("title") or "").strip()
        if not title:
            return None
        url, body = record.get("url"), record.get("body") or ""
        basis = (url or "").strip().lower() or " ".join(f"{title}\n{body}".split()).lower()
        stamp = record.get("published_at")
        at = datetime.fromisoformat(stamp.replace("Z", "+00:00")).astimezone(timezone.utc) if stamp else None
        return (hashlib.sha256(basis.encode("utf-8")).hexdigest(), self.source, self.family, url, title,
                record.get("author"), at, body)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], NAMES)


class LandedItems(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed_items"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LandedItemsReader:
        return LandedItemsReader(self.options, READERS[self.options.get("reader", "json_lines")])


def register_source(spark: SparkSession) -> None:
    spark.dataSource.register(LandedItems)
